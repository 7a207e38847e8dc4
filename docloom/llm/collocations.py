"""Phrase collocations by Rabin-Karp fingerprints.

A text is cut into pieces and words. Prefix sums of a polynomial over the bytes give every word a
fingerprint by two look-ups, and prefix sums over the words' fingerprints every n-gram, all in
numpy for a few megabytes of texts at a time. Tasks send fingerprints with counts, summed before
the shuffle, and what reaches ``least`` there may be frequent: equal phrases have equal
fingerprints, so none is missed. Longer n-grams are counted only where their parts are frequent.

The last pass meets the texts again and materialises no other n-grams than those. In a task each
occurrence is compared with the words of the first one of its fingerprint; between tasks phrases
are grouped by their own text, with a pointer to the first document. So two phrases of one
fingerprint are never added up, and counts are exact.

What tells tasks which fingerprints are frequent is a bitmap of bounded size. A foreign
fingerprint that meets a set bit is counted in vain and drops out by its count.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from docloom.plans.shapes import keyed_join, top_k
from docloom.sources.tables import written

# What ends a piece, what ends a word, and the language of texts without one.
ENDS_PIECE, ENDS_WORD, NO_LANG = ".,;:!?\n\x0b\x0c\r", " \t", "und"
CUT = bytes(10 if chr(b) in ENDS_PIECE else 32 if chr(b) in ENDS_WORD else b for b in range(256))
# Bytes of texts that a task works on at once.
BLOCK = 512 << 10
# Odd multipliers of the polynomials over bytes and over words, modulo 2^64, and of the last mixing.
BYTE_BASE, WORD_BASE = 0x9DDFEA08EB382D69, 0xC3A5C85C97CB3127
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
# Bits of the bitmap: so many for each frequent fingerprint, and never more than 2^27 (16 MB).
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 1 << 20, 1 << 27


@cache
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``base`` and of its inverse modulo 2^64."""
    powers = np.full((2, size), 1, dtype=np.uint64)
    powers[0, 1:], powers[1, 1:] = base, pow(base, -1, 2**64)
    np.multiply.accumulate(powers, axis=1, out=powers)
    return powers[0], powers[1]


def _prefixes(base: int, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of the polynomial, and the factors that move a part's sum to the start."""
    size = 1 << max(12, len(values).bit_length())
    powers, inverse = _powers(base, size)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers[: len(values)], out=sums[1:])
    return sums, inverse


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, factor in zip((30, 27), MIX, strict=True):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _entries(text: str, most: int, block: int) -> Iterator[tuple[bytes, int]]:
    """A text in blocks: bytes, and how many of them are the block's own.

    A block ends with a piece if it can, else with a word, and then has the next ``most - 1``
    words of the piece behind its own, in which no n-gram of the block starts.
    """
    data = text.encode().lower().translate(CUT)
    following = re.compile(rb"(?: *[^ \n]+){1,%d}" % max(1, most - 1))
    at = 0
    while at < len(data) or not at:
        end, tail = len(data), b""
        if end - at > block:
            end = data.rfind(b"\n", at, at + block)
            if end <= at:
                end = data.rfind(b" ", at, at + block)
                if end <= at:
                    far = re.compile(rb"[ \n]").search(data, at + block)
                    end = far.start() if far else len(data)
                more = following.match(data, end)
                tail = more[0] if more else b""
        yield data[at:end] + tail, end - at
        at = max(end, 1)


class _Words:
    """The words of a few texts: their pieces, entries and fingerprints."""

    def __init__(self, entries: list, bits: int):
        self.bits = bits
        self.entries = entries
        sizes = np.array([len(e[2]) + 1 for e in entries])
        begins = np.cumsum(sizes) - sizes
        self.joined = b"\n".join(e[2] for e in entries) + b"\n"
        data = np.frombuffer(self.joined, dtype=np.uint8)
        gap = (data == 32) | (data == 10)
        change = np.diff(np.r_[True, gap].astype(np.int8))
        starts = np.flatnonzero(change == -1)
        ends = np.flatnonzero(change == 1)
        self.piece = np.cumsum(data == 10)[starts] if len(starts) else starts
        self.entry = np.searchsorted(begins, starts, "right") - 1
        own = np.array([e[3] for e in entries])
        self.own = starts - begins[self.entry] < own[self.entry]
        langs = [e[1] for e in entries]
        seeds = {x: int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest()) for x in set(langs)}
        self.seed = np.array([seeds[x] for x in langs], dtype=np.uint64)[self.entry]
        sums, back = _prefixes(BYTE_BASE, data.astype(np.uint64) + np.uint64(1))
        words = _mixed((sums[ends] - sums[starts]) * back[starts])
        self.sums, self.back = _prefixes(WORD_BASE, words)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints of the ``n`` words from each word on, and where they are a phrase."""
        size = max(0, len(self.piece) - n + 1)
        found = (self.sums[n : n + size] - self.sums[:size]) * self.back[:size]
        found = _mixed((found + np.uint64(n * MIX[0] % 2**64)) ^ self.seed[:size])
        return found >> np.uint64(64 - self.bits), self.own[:size] & (self.piece[n - 1 :] == self.piece[:size])


def _blocks(batches: Iterable[pa.RecordBatch], most: int, bits: int, block: int) -> Iterator[_Words]:
    held, size = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            for doc_id, lang, text in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns), strict=True):
                for data, own in _entries(text or "", most, block):
                    held.append((doc_id, NO_LANG if lang is None else lang, data, own))
                    size += len(data)
                    if size >= block:
                        yield _Words(held, bits)
                        held, size = [], 0
    if held:
        yield _Words(held, bits)


def _has(bitmap: np.ndarray, found: np.ndarray) -> np.ndarray:
    at = found & np.uint64(len(bitmap) * 64 - 1)
    return (bitmap[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _counted(docs: DataFrame, sizes: tuple[int, ...], least: int, bits: int, block: int, known=None, part: int = 0) -> DataFrame:
    """``fp``: fingerprints of phrases of ``sizes`` words that occur ``least`` times.

    With ``known``, the bitmap of frequent ones, only where all parts of ``part`` words are in it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words in _blocks(batches, max(sizes), bits, block):
            if known is not None:
                parts = _has(known.value, words.grams(part)[0])
            for n in sizes:
                found, ok = words.grams(n)
                if known is not None:
                    ok = reduce(np.logical_and, (parts[i : i + len(ok)] for i in range(n - part + 1)), ok)
                fp, count = np.unique(found[ok], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), pa.array(count)], names=["fp", "n"])

    sent = docs.mapInArrow(run, "fp long, n long")
    return written(sent.groupBy("fp").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("fp"), "fingerprints")


def _bitmap(frequent: DataFrame):
    """Broadcast bitmap of ``frequent(fp)``, at most ``MOST_BITS``: one bit for each remainder."""
    wanted = frequent.count() * BITS_EACH
    size = min(MOST_BITS, max(LEAST_BITS, 1 << wanted.bit_length()))
    at = F.col("fp").bitwiseAND(F.lit(size - 1))
    words = (
        frequent.select(F.shiftright(at, 6).alias("word"), F.expr(f"shiftleft(1L, cast(fp & {size - 1} & 63 as int))").alias("bit"))
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bits"))
        .toArrow()
    )
    bitmap = np.zeros(size // 64, dtype=np.uint64)
    bitmap[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return frequent.sparkSession.sparkContext.broadcast(bitmap)


def _phrases(words: _Words, n: int, bitmap: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the phrases of ``n`` words that the bitmap has, each different one once, and counts.

    Occurrences that have other words, or another language, than the first of their fingerprint
    stand for themselves.
    """
    found, ok = words.grams(n)
    at = np.flatnonzero(ok & _has(bitmap, found))
    _, first, group = np.unique(found[at], return_index=True, return_inverse=True)
    shown = at[first]
    same = words.seed[at] == words.seed[shown][group]
    for i in range(n):
        same &= ids[at + i] == ids[shown + i][group]
    other = at[~same]
    counts = np.bincount(group[same], minlength=len(shown))
    return np.r_[shown, other], np.r_[counts, np.ones(len(other), dtype=np.int64)]


def _materialised(docs: DataFrame, known, most: int, bits: int, block: int) -> DataFrame:
    """``lang, size, phrase, n, first``: phrases that the bitmap has, with true counts and a pointer.

    A row of size 0 has the number of words of a language.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = StructType.fromDDL(f"lang string, size int, phrase string, n long, first {kind}")
    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words in _blocks(batches, most, bits, block):
            texts = words.joined.split()
            number = {w: i for i, w in enumerate(dict.fromkeys(texts))}
            ids = np.fromiter(map(number.__getitem__, texts), dtype=np.int64, count=len(texts))
            doc_ids, langs = (pa.array([e[i] for e in words.entries], type=t) for i, t in ((0, arrow[4].type), (1, arrow[0].type)))

            def batch(size: int, entries: np.ndarray, phrases: list, counts: np.ndarray, docs: pa.Array) -> pa.RecordBatch:
                spelled = pa.array(phrases, type=pa.binary()).cast(pa.string())
                sizes = pa.array(np.full(len(counts), size, dtype=np.int32))
                return pa.RecordBatch.from_arrays([langs.take(pa.array(entries)), sizes, spelled, pa.array(counts), docs], schema=arrow)

            entries = np.arange(len(words.entries))
            counts = np.bincount(words.entry[words.own], minlength=len(entries))
            yield batch(0, entries, [b""] * len(entries), counts, pa.nulls(len(entries), type=arrow[4].type))
            for n in range(1, most + 1):
                starts, counts = _phrases(words, n, known.value, ids)
                phrases = [b" ".join(texts[w : w + n]) for w in starts.tolist()]
                yield batch(n, words.entry[starts], phrases, counts, doc_ids.take(pa.array(words.entry[starts])))

    # Sums and minima of numbers, which Spark keeps in a hash table without sorting phrases.
    return docs.mapInArrow(run, fields).groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n"), F.min("first").alias("first"))


def count_phrases(docs: DataFrame, most: int = 5, least: int = 100, bits: int = 64, block: int = BLOCK) -> DataFrame:
    """``lang, size, phrase, n, first``: phrases of 1 to ``most`` words that occur ``least`` times.

    Rows of size 0 have the number of all words of a language. ``bits`` of the fingerprints are
    kept; fewer make more of them meet and change no result.
    """
    rows = docs.select("doc_id", "lang", "text")
    frequent = _counted(rows, (1, 2)[:most], least, bits, block)
    for sizes in ((3,), tuple(range(4, most + 1))):
        sizes = tuple(n for n in sizes if n <= most)
        if sizes:
            known = _bitmap(frequent)
            # All n-grams of a frequent phrase are frequent, so those of one size tell enough.
            frequent = frequent.unionByName(_counted(rows, sizes, least, bits, block, known, min(sizes) - 1))
            known.unpersist()
    counted = _materialised(rows, _bitmap(frequent), most, bits, block)
    return written(counted.where((F.col("size") == 0) | (F.col("n") >= least)), "phrases")


def best_cut(phrases: DataFrame) -> DataFrame:
    """Phrases of two words or more with their lowest-scoring cut: ``lang, phrase, size, a, l, r, n, score, first``.

    The score is ``1000 a n div (l r)``: products are decimals of 38 digits, so exact for counts
    below 10^17. Cuts of equal score, rounded down, give the one with the shortest first part.
    """
    exact = "decimal(17,0)"
    words = F.split("phrase", " ")
    part = phrases.where(F.col("size") > 0).select("lang", F.col("phrase").alias("part"), F.col("n").alias("count"))
    cuts = (
        phrases.where(F.col("size") > 1)
        .withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
        .select(
            "lang", "phrase", "size", F.col("n").alias("a"), "first", "k",
            F.array_join(F.slice(words, F.lit(1), F.col("k")), " ").alias("left_part"),
            F.array_join(F.slice(words, F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("right_part"),
        )
    )
    for side, name in (("left_part", "l"), ("right_part", "r")):
        cuts = cuts.join(part.withColumnsRenamed({"part": side, "count": name}), ["lang", side])
    # Few languages, or else a join that cuts out the frequent ones.
    totals = phrases.where(F.col("size") == 0).select("lang", F.col("n").alias("total"), F.col("n").alias("rows"))
    over = F.lit(1000).cast("decimal(4,0)") * F.col("a").cast(exact) * F.col("total").cast(exact)
    scored = (
        keyed_join(cuts, totals, "lang", "rows")
        .withColumns({"over": over, "under": F.col("l").cast(exact) * F.col("r").cast(exact)})
        .withColumn("score", F.expr("over div under"))
    )
    best = scored.groupBy("lang", "phrase", "size", "a", F.col("total").alias("n")).agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut"), F.any_value("first").alias("first")
    )
    return best.select("lang", "phrase", "size", "a", "cut.l", "cut.r", "n", "cut.score", "first")


def _contained(phrases: DataFrame) -> DataFrame:
    """``lang, phrase, longest``: parts of longer phrases, with the count of the commonest of these."""
    words = F.split("phrase", " ")
    longer = phrases.where(F.col("size") > 2).withColumn("words", words)
    sizes = longer.withColumn("part", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
    parts = sizes.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("part") + 1)))
    named = parts.select("lang", F.array_join(F.slice("words", F.col("at"), F.col("part")), " ").alias("phrase"), "n")
    return named.groupBy("lang", "phrase").agg(F.max("n").alias("longest"))


def collocations(docs: DataFrame, most: int = 5, least: int = 100, share: int = 100, top: int = 2000, bits: int = 64) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score, first`` for ``docs(doc_id, lang, text)``.

    A candidate is a phrase of 2 to ``most`` words with ``a >= least`` occurrences inside pieces of
    texts of a language. It goes if a longer candidate that holds its words in a row occurs at
    least ``share`` percent as often. The ``top`` of each language are ranked by score, ``a`` and
    phrase. ``l`` and ``r`` are the counts of the parts of its lowest-scoring cut, ``n`` all words
    of the language, ``first`` the smallest ``doc_id`` of a document with it.

    A null text is empty; a null language is ``und``, together with texts that say so; a null id
    is nowhere the smallest. Repeated rows count each. Texts without words give nothing; no rows give
    none. Other columns are not read.
    """
    phrases = count_phrases(docs, most, least, bits)
    inside = _contained(phrases)
    kept = best_cut(phrases).join(inside, ["lang", "phrase"], "left").where(
        F.col("longest").isNull() | (100 * F.col("longest") < share * F.col("a"))
    )
    ranked = top_k(kept.drop("size", "longest"), ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], top)
    return ranked.withColumn("rank", F.col("rank").cast("long")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "first")
