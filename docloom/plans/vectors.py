"""Exact nearest vectors: each task keeps its own best k per query."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Largest matrix of scores a task makes at once, in bytes; about four of its size are alive.
SCORE_BYTES = 8 << 20


def _unit(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norms = np.sqrt((matrix * matrix).sum(axis=1))
    valid = np.isfinite(norms) & (norms > 0)
    return matrix / np.where(valid, norms, 1.0)[:, None], valid


class _Best:
    """The k best (score, id) seen so far for each of a fixed set of queries."""

    def __init__(self, qids: list, vectors: list, k: int):
        unit, valid = _unit(np.asarray(vectors, dtype=np.float64).reshape(len(qids), -1))
        self.qids = np.asarray([q for q, ok in zip(qids, valid) if ok], dtype=object)
        self.unit, self.k = unit[valid].T, k
        # Of all queries together, by query, then best first.
        self.query = np.empty(0, dtype=np.int64)
        self.ids = np.empty(0, dtype=np.int64)
        self.scores = np.empty(0)

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        rows = max(1, SCORE_BYTES // (8 * max(1, len(self.qids))))
        for at in range(0, len(ids), rows):
            self._add(ids[at : at + rows], vectors[at : at + rows])

    def _add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        unit, valid = _unit(vectors.astype(np.float64))
        ids = ids[valid]
        if not len(ids) or not len(self.qids):
            return
        # Rounded here and nowhere later, so that ties mean the same in every task.
        scores = unit[valid] @ self.unit * 1e6
        scores = np.trunc(scores + np.copysign(0.5, scores)) / 1e6
        # A query's k-th best of this block, or of those seen, is the least that can still count.
        least = np.full(len(self.qids), -np.inf)
        if len(ids) >= self.k:
            least = np.partition(scores, len(ids) - self.k, axis=0)[len(ids) - self.k]
        seen = np.bincount(self.query, minlength=len(self.qids))
        full = np.flatnonzero(seen >= self.k)
        least[full] = np.maximum(least[full], self.scores[np.cumsum(seen)[full] - 1])
        row, query = np.nonzero(scores >= least)
        query = np.concatenate([self.query, query])
        all_ids = np.concatenate([self.ids, ids[row]])
        values = np.concatenate([self.scores, scores[row, query[len(self.query) :]]])
        order = np.lexsort((all_ids, -values, query))
        query = query[order]
        starts = np.searchsorted(query, np.arange(len(self.qids)))
        best = np.arange(len(query)) - starts[query] < self.k
        self.query, self.ids, self.scores = query[best], all_ids[order][best], values[order][best]

    def frame(self) -> pd.DataFrame:
        return pd.DataFrame({"qid": self.qids[self.query], "vec_id": self.ids, "score": self.scores})


def _schema(qid_type: str) -> str:
    return f"qid {qid_type}, vec_id bigint, score double"


def nearest_in_partitions(embeddings: DataFrame, queries: list, k: int, qid_type: str) -> DataFrame:
    """Candidates for few queries: one pass over the vectors, queries broadcast."""
    spark = embeddings.sparkSession
    usable = [q for q in queries if q["embedding"]]
    by_length: dict[int, tuple[list, list]] = {}
    for q in usable:
        qids, vectors = by_length.setdefault(len(q["embedding"]), ([], []))
        qids.append(q["qid"])
        vectors.append(q["embedding"])
    shared = spark.sparkContext.broadcast(by_length)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = {n: _Best(qids, vectors, k) for n, (qids, vectors) in shared.value.items()}
        for batch in batches:
            lengths = batch["embedding"].map(len)
            for n, kept in best.items():
                part = batch[lengths == n]
                if len(part):
                    kept.add(part["vec_id"].to_numpy(), np.stack(part["embedding"].to_numpy()))
        for kept in best.values():
            yield kept.frame()

    return (
        embeddings.select("vec_id", "embedding")
        .where(F.col("embedding").isNotNull())
        .mapInPandas(scan, _schema(qid_type))
    )

