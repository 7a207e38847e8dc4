"""Benchmark decontamination with one Aho-Corasick automaton.

The windows of all test items, normalised, go into one automaton; each text is normalised the same
way and scanned once. Where the automaton meets a window, the match's end gives the words, and the
words' places in the original text give the offsets.

Windows go to every task, so their size is looked at: those of at most ``WINDOW_BYTES`` make one
automaton. A larger benchmark is cut into groups of items of that size, one scan of the documents
each, and the scans' hits are put together per document.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import WORD_BYTES, map_slices, release

# Fixed value: what counts as a word once A-Z are lower case.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WINDOW = 10
# Bytes of items' texts in one automaton, at most; a window repeats a word up to ten times.
WINDOW_BYTES = 8 << 20


def _words(text: str | None) -> list[bytes]:
    return text.encode().translate(WORD_BYTES).split() if text else []


def _windows(items: list[tuple[object, str | None]], window: int) -> dict[str, tuple[int, list]]:
    """Window, with a space at both ends, to its number of words and the items that have it."""
    found: dict[str, tuple[int, list]] = {}
    for item_id, text in items:
        words = _words(text)
        size = min(window, len(words))
        for at in range(len(words) - size + 1 if size else 0):
            key = (b" " + b" ".join(words[at : at + size]) + b" ").decode("latin-1")
            found.setdefault(key, (size, []))[1].append(item_id)
    return found


def _finder(items: list[tuple[object, str | None]], window: int):
    """A function from a text to its number of words, hit words and items."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for key, (size, ids) in _windows(items, window).items():
        automaton.add_word(key, (size, frozenset(ids)))
    automaton.make_automaton()
    empty = len(automaton) == 0

    def find(text: str | None):
        words = _words(text)
        if empty or not words:
            return len(words), [], frozenset()
        # Bytes as latin-1: one character a byte, so places in it are places in the bytes.
        flat = (b" " + b" ".join(words) + b" ").decode("latin-1")
        matches = list(automaton.iter(flat))
        if not matches:
            return len(words), [], frozenset()
        ends = np.flatnonzero(np.frombuffer(flat.encode("latin-1"), np.uint8) == 0x20)[1:]
        change = np.zeros(len(words) + 1, np.int64)
        items_hit: set = set()
        for end, (size, ids) in matches:
            last = int(np.searchsorted(ends, end))  # the word that the space at ``end`` follows
            change[last - size + 1] += 1
            change[last + 1] -= 1
            items_hit |= ids
        return len(words), np.flatnonzero(np.cumsum(change[:-1]) > 0), items_hit

    return find


def _spans(text: str, hit: np.ndarray) -> list[dict[str, int]]:
    """Runs of hit words as ``begin, end`` in code points of the original text."""
    places = [m.span() for m in WORD.finditer(re.sub("[A-Z]+", lambda m: m.group().lower(), text))]
    cuts = np.flatnonzero(np.diff(hit) > 1)
    firsts, lasts = np.r_[hit[0], hit[cuts + 1]], np.r_[hit[cuts], hit[-1]]
    return [{"begin": places[a][0], "end": places[b][1]} for a, b in zip(firsts, lasts, strict=True)]


def _groups(benchmark: DataFrame) -> list[list[tuple[object, str | None]]]:
    """The items in groups of bounded size; each group goes through the driver by itself."""
    sized = benchmark.select("item_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))
    total = sized.agg(F.sum(F.col("size").cast("long"))).first()[0] or 0
    parts = -(-total // WINDOW_BYTES) or 1
    groups = []
    for part in range(parts):
        mine = sized.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        groups.append([(r["item_id"], r["text"]) for r in mine.select("item_id", "text").toLocalIterator()])
    return groups


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_hit, items, spans, contaminated`` for ``docs(doc_id, text)``.

    A window is ``window`` consecutive words of an item of ``benchmark(item_id, text)``; an item
    with fewer words, but some, is one window. Words inside any occurrence of a window are hit.
    ``items`` lists the items with an occurring window, as sorted strings; ``spans`` the runs of
    hit words as ``begin, end`` in code points of the original text.

    One row per row of ``docs``. A null or wordless text has no words and no hits; null or
    wordless items have no windows; repeated items and windows count once; an empty benchmark hits
    nothing. Null and repeated ``doc_id`` are passed through; other columns are not read.
    """
    rows = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_hit long, items array<string>, spans array<struct<begin:int,end:int>>"
    groups = _groups(benchmark)
    if len(groups) > 1:
        return _scan_in_groups(rows, groups, window, kind)

    def start(items=groups[0]):
        find = _finder(items, window)

        def work(doc_id, text):
            out = defaultdict(list, doc_id=doc_id)
            for t in text:
                n, hit, items = find(t)
                out["n_words"].append(n)
                out["n_hit"].append(len(hit))
                out["items"].append(sorted(map(str, items)))
                out["spans"].append(_spans(t, hit) if len(hit) else [])
            return out

        return work

    return map_slices(rows, start, schema).withColumn("contaminated", F.col("n_hit") > 0)


def _scan_in_groups(rows: DataFrame, groups: list, window: int, kind: str) -> DataFrame:
    """One scan per group of items. A scan passes the texts on with the words hit so far, so that
    words hit by several groups count once and nothing has to be joined."""
    hits = rows.select("doc_id", "text", F.lit(0).cast("long").alias("n_words"), F.array().cast("array<int>").alias("hit"), F.array().cast("array<string>").alias("items"))
    schema = f"doc_id {kind}, text string, n_words long, hit array<int>, items array<string>"
    for group in groups:

        def start(items=group):
            find = _finder(items, window)

            def work(doc_id, text, n_words, hit, items):
                out = defaultdict(list, doc_id=doc_id, text=text)
                for t, h, i in zip(text, hit, items, strict=True):
                    n, more, found = find(t)
                    out["n_words"].append(n)
                    out["hit"].append(sorted({*h, *map(int, more)}))
                    out["items"].append(sorted({*i, *map(str, found)}))
                return out

            return work

        hits = map_slices(hits, start, schema)

    def finish():
        def work(doc_id, text, n_words, hit, items):
            spans = [_spans(t, np.array(h)) if h else [] for t, h in zip(text, hit, strict=True)]
            return {"doc_id": doc_id, "n_words": n_words, "n_hit": [len(h) for h in hit], "items": items, "spans": spans}

        return work

    done = f"doc_id {kind}, n_words long, n_hit long, items array<string>, spans array<struct<begin:int,end:int>>"
    return map_slices(hits, finish, done).withColumn("contaminated", F.col("n_hit") > 0)


def is_contaminated(benchmark: DataFrame, window: int = WINDOW) -> Callable[[Column], Column]:
    """The verdict as a function of the text's column, for filters that keep a row's other columns."""

    def scan(items: list):
        @F.pandas_udf("boolean")
        def verdicts(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            find = _finder(items, window)
            for part in parts:
                yield pd.Series([len(find(t)[1]) > 0 for t in part], dtype=bool)
            release()

        return verdicts

    scans = [scan(group) for group in _groups(benchmark)]
    return lambda text: reduce(lambda a, b: a | b, [s(text) for s in scans])


def digests(found: DataFrame) -> DataFrame:
    """Counts and digests of what ``find_contamination`` returns."""
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )
