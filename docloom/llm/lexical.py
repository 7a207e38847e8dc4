"""Ranked lexical search by dense blocked matrix multiplication.

The terms of all items are numbered. Each text is read once and left as the numbers and counts of
those terms only. Tiles of documents are then made dense with the impact of each term, tiles of
items dense with its weight, both over the terms that the documents of the tile hold, and
multiplied in float64. Weights and impacts are whole numbers and a tile of terms is so narrow that
its sums stay below 2^53, so every product is exact; tiles of terms are added as 64-bit integers.
Each task keeps the first ``k`` documents of each item, and these meet in one ranking per item.

The numbered terms go to every task, so their size is looked at: items are dealt into groups of
about ``GROUP_BYTES`` of terms and ``GROUP_ITEMS`` items, one after another through the driver, and
each group reads the documents once. An item is never cut, so a group is as large as its largest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from docloom.llm.common import WORD_BYTES, map_slices
from docloom.plans.shapes import top_k
from docloom.sources.tables import written

# Fixed value: what a term is once A-Z are lower case.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Most items, and bytes of their terms, that the driver and a task hold at once.
GROUP_ITEMS, GROUP_BYTES = 4096, 8 << 20
# Sides of a tile, at most.
DOCS, TERMS, ITEMS = 512, 4096, 256
# An impact is below this: 10^9 tf div (1000 tf + 8 m).
MOST_IMPACT = 10**6


def item_terms(items: DataFrame) -> DataFrame:
    """``item_id, term``: the different terms of each item."""
    lower = F.translate("text", UPPER, LOWER)
    return items.select("item_id", F.explode(F.regexp_extract_all(lower, F.lit(TERM), 0)).alias("term")).distinct()


def _compact(docs: DataFrame, vocabulary: list[bytes], kind: str) -> DataFrame:
    """``doc_id, n, terms, tfs``: how many terms a text has, which of the vocabulary, how often each."""

    def start():
        number = {term: i for i, term in enumerate(vocabulary)}.get

        def work(doc_id, text):
            out = {"doc_id": doc_id, "n": [], "terms": [], "tfs": []}
            for t in text:
                words = t.encode().translate(WORD_BYTES).split() if t else []
                found = np.fromiter(map(number, words, repeat(-1)), dtype=np.int32, count=len(words))
                terms, tfs = np.unique(found[found >= 0], return_counts=True)
                out["n"].append(len(words))
                out["terms"].append(terms)
                out["tfs"].append(tfs)
            return out

        return work

    return map_slices(docs.select("doc_id", "text"), start, f"doc_id {kind}, n long, terms array<int>, tfs array<long>")


def _weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class _Best:
    """The first ``k`` documents of each item so far: by score, falling, then by id; null ids last."""

    def __init__(self, items: int, k: int):
        self.score = np.zeros((items, k), dtype=np.int64)
        self.none = np.ones((items, k), dtype=bool)
        self.doc = np.zeros((items, k), dtype=np.int64)

    def add(self, scores: np.ndarray, none: np.ndarray, doc: np.ndarray) -> None:
        """``scores`` by item and document; the documents come in the order of their ids."""
        k = self.score.shape[1]
        # A score as high as the k-th may still come first by its id.
        rows = np.flatnonzero(scores.max(axis=1) >= np.maximum(self.score[:, -1], 1))
        at = np.argsort(-scores[rows], axis=1, kind="stable")[:, :k]
        score = np.concatenate([self.score[rows], np.take_along_axis(scores[rows], at, axis=1)], axis=1)
        nones = np.concatenate([self.none[rows], none[at]], axis=1)
        docs = np.concatenate([self.doc[rows], doc[at]], axis=1)
        order = np.lexsort((docs, nones, -score), axis=1)[:, :k]
        for mine, both in ((self.score, score), (self.none, nones), (self.doc, docs)):
            mine[rows] = np.take_along_axis(both, order, axis=1)


def _scores(rows, terms, impacts, n_rows: int, model: dict) -> np.ndarray:
    """Scores of a tile of documents, by item: ``impacts`` stand at ``rows`` and ``terms``."""
    total = np.zeros((model["n_items"], n_rows), dtype=np.int64)
    columns = np.unique(terms)
    for at in range(0, len(columns), model["width"]):
        mine = columns[at : at + model["width"]]
        column = np.full(model["n_terms"], -1, dtype=np.int64)
        column[mine] = np.arange(len(mine))
        here = column[terms] >= 0
        dense = np.zeros((len(mine), n_rows))
        dense[column[terms[here]], rows[here]] = impacts[here]
        for first in range(0, model["n_items"], ITEMS):
            cut = slice(*np.searchsorted(model["items"], (first, first + ITEMS)))
            there = column[model["terms"][cut]]
            held = there >= 0
            weights = np.zeros((min(ITEMS, model["n_items"] - first), len(mine)))
            weights[model["items"][cut][held] - first, there[held]] = model["weights"][cut][held]
            total[first : first + ITEMS] += (weights @ dense).astype(np.int64)
    return total


def _ranked(batches: Iterator[pa.RecordBatch], model: dict, k: int) -> _Best:
    best = _Best(model["n_items"], k)
    for batch in batches:
        for at in range(0, batch.num_rows, DOCS):
            tile = batch.slice(at, DOCS)
            doc, n, terms, tfs = tile.columns
            none = doc.is_null().to_numpy(zero_copy_only=False)
            ids = doc.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            order = np.lexsort((ids, none))
            place = np.empty(len(order), dtype=np.int64)
            place[order] = np.arange(len(order))
            lengths = terms.value_lengths().to_numpy(zero_copy_only=False)
            if not lengths.sum():
                continue
            rows = np.repeat(place, lengths)
            # Python's integers: the product of a length and the number of documents is of any size.
            m = np.array([10 + 90 * x * model["n_docs"] // model["n_all"] for x in n.to_pylist()], dtype=np.int64)
            tf = tfs.flatten().to_numpy()
            impacts = 10**9 * tf // (1000 * tf + 8 * np.repeat(m, lengths))
            best.add(_scores(rows, terms.flatten().to_numpy(), impacts, len(ids), model), none[order], ids[order])
    return best


def _rank_group(docs: DataFrame, pairs: list, kinds: tuple[str, str], k: int) -> DataFrame:
    """``item_id, doc_id, score``: each task's first ``k`` documents of each item of a group."""
    ids = sorted({p["item_id"] for p in pairs}, key=lambda i: (i is None, i))
    vocabulary = sorted({p["term"].encode() for p in pairs})
    item, term = ({v: i for i, v in enumerate(values)} for values in (ids, vocabulary))
    compact = written(_compact(docs, vocabulary, kinds[1]), "lexical-terms")
    sums = compact.agg(F.sum(F.when(F.col("n") > 0, 1).otherwise(0)).alias("docs"), F.sum("n").alias("words")).first()
    counts = compact.select(F.explode("terms").alias("term")).groupBy("term").count()
    n_docs = sums["docs"] or 0
    # At most as many rows as the group has terms.
    weight = {r["term"]: _weight(n_docs, r["count"]) for r in counts.collect()}
    found = sorted((item[p["item_id"]], t) for p in pairs if (t := term[p["term"].encode()]) in weight)
    highest = max(weight.values(), default=0)
    model = {
        "n_docs": n_docs,
        "n_all": sums["words"],
        "n_items": len(ids),
        "n_terms": len(vocabulary),
        "items": np.array([i for i, _ in found], dtype=np.int64),
        "terms": np.array([t for _, t in found], dtype=np.int64),
        "weights": np.array([weight[t] for _, t in found], dtype=np.float64),
        # No sum over a tile of so many terms reaches 2^53.
        "width": max(1, min(TERMS, (2**53 - 1) // (MOST_IMPACT * max(1, highest)))),
    }
    fields = StructType.fromDDL(f"item_id {kinds[0]}, doc_id {kinds[1]}, score long")
    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _ranked(batches, model, k)
        at, place = np.nonzero(best.score > 0)
        doc = pa.array(best.doc[at, place], mask=best.none[at, place])
        named = pa.array([ids[i] for i in at], type=arrow.field("item_id").type)
        yield pa.RecordBatch.from_arrays([named, doc.cast(arrow.field("doc_id").type), pa.array(best.score[at, place])], schema=arrow)

    return compact.mapInArrow(run, fields)


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best of ``docs(doc_id, text)`` for each of ``items(item_id, text)``.

    A document scores the sum over an item's terms, once each, of weight times impact; the weight
    falls with the documents holding the term, the impact rises with its count and falls with the
    document's length. Documents of score 0 are left out; equal scores are ranked by ``doc_id``.

    Rows of ``items`` that share an id, null included, are one item with the terms of all; an item
    whose terms no document has gives no rows. Each row of ``docs`` is a document, so repeated ids
    may be ranked twice; a null id comes last among equal scores; null and termless texts match
    nothing and are not counted. ``doc_id`` is an integer. Other columns are not read. No rows on
    either side give none.
    """
    kinds = tuple(df.schema[c].dataType.simpleString() for df, c in ((items, "item_id"), (docs, "doc_id")))
    pairs = written(item_terms(items), "item-terms")
    size = pairs.agg(
        F.countDistinct(F.struct("item_id")).alias("items"), F.sum(F.octet_length("term").cast("long") + 16).alias("bytes")
    ).first()
    groups = max(1, -(-(size["items"] or 0) // GROUP_ITEMS), -(-(size["bytes"] or 0) // GROUP_BYTES))
    parts = []
    for group in range(groups):
        mine = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == group).collect()
        if groups == 1:
            parts.append(_rank_group(docs, mine, kinds, k))
        elif mine:  # what a group's tasks hold is let go before the next
            parts.append(written(_rank_group(docs, mine, kinds, k), "lexical-group"))
    ranked = top_k(reduce(DataFrame.unionByName, parts), ["item_id"], [F.desc("score"), F.asc_nulls_last("doc_id")], k)
    return ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
