"""A linear classifier on hashed words, trained by passes over the labelled documents.

A document is the set of its words' hashes, each of the same weight and together of length 1. A
pass sums the gradient of the logistic loss task by task; the weights, ``2^15`` a model by default,
are all that goes to tasks and comes back, whatever the number of documents. Penalties are compared
by folds inside the training rows, and all models of all folds are trained in the same passes; the
threshold is the one with the best F1 on the rows that each fold leaves out.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import tokens
from docloom.sources.tables import written

# Hashes, penalties compared, folds inside the training rows, and passes.
SIZE, PENALTIES, FOLDS, STEPS = 1 << 15, (1e-4, 1e-3), 3, 30
# Documents whose margins are made at once, and partial gradients that reach the driver.
SLICE, PARTS = 512, 8
# Thresholds are compared on a grid of this many.
GRID = 100


@dataclass
class LinearModel:
    weights: np.ndarray  # of hashes, then the constant
    penalty: float
    threshold: float
    fold_f1: float  # of the chosen penalty and threshold, on the rows that folds left out


def hashed_words(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """``doc_id, at``: the different hashes of a document's words; map-only. Empty texts have none."""
    hashes = F.transform(tokens("text"), lambda t: F.pmod(F.xxhash64(t), F.lit(size)).cast("int"))
    return docs.select("doc_id", F.array_sort(F.array_distinct(hashes)).alias("at"))


def _margins(weights: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """[models, documents] for documents whose hashes follow each other in ``at``."""
    owner = np.repeat(np.arange(len(lengths)), lengths)
    scale = 1 / np.sqrt(np.maximum(lengths, 1))
    sums = np.stack([np.bincount(owner, w[at], len(lengths)) for w in weights])
    return sums * scale + weights[:, -1:]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for first in range(0, batch.num_rows, SLICE):
            part = batch.slice(first, SLICE)
            at = part.column("at")
            yield part, at.flatten().to_numpy(), at.value_lengths().to_numpy()


def _gradient(rows: DataFrame, weights: np.ndarray, fold_of: np.ndarray) -> np.ndarray:
    """Sum of the loss's gradients, a row for each model, over the rows it is trained on."""
    sent = rows.sparkSession.sparkContext.broadcast(weights)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = sent.value
        total = np.zeros(mine.shape)
        for part, at, lengths in _slices(batches):
            y, fold = part.column("y").to_numpy(), part.column("fold").to_numpy()
            wrong = 1 / (1 + np.exp(-np.clip(_margins(mine, at, lengths), -50, 50))) - y
            wrong *= fold_of[:, None] != fold[None, :]
            scale = np.repeat(1 / np.sqrt(np.maximum(lengths, 1)), lengths)
            for m, each in enumerate(wrong):
                total[m, :-1] += np.bincount(at, np.repeat(each, lengths) * scale, mine.shape[1] - 1)
            total[:, -1] += wrong.sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["sums"])

    def added(parts: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"sums": [np.sum([np.frombuffer(s) for s in parts["sums"]], axis=0).tobytes()]})

    partial = rows.mapInArrow(sums, "sums binary").withColumn("part", F.pmod(F.spark_partition_id(), F.lit(PARTS)))
    found = partial.groupBy("part").applyInPandas(lambda p: added(p), "sums binary").collect()
    sent.unpersist()
    return np.sum([np.frombuffer(r["sums"]) for r in found], axis=0).reshape(weights.shape) if found else np.zeros(weights.shape)


def _threshold(counts: DataFrame) -> tuple[float, float]:
    """The lowest of the grid's thresholds with the highest F1, and that, from ``bin, y, n``."""
    table = np.zeros((2, GRID + 1))
    for r in counts.collect():  # at most two rows for each of the grid's
        table[r["y"], r["bin"]] += r["n"]
    above = table[:, ::-1].cumsum(axis=1)[:, ::-1]
    f1 = 2 * above[1] / np.maximum(1, above[0] + above[1] + table[1].sum())
    best = int(f1.argmax())
    return best / GRID, float(f1[best])


def train_linear(
    words: DataFrame,
    labels: DataFrame,
    target: str,
    holdout: int | None = 5,
    penalties: Sequence[float] = PENALTIES,
    folds: int = FOLDS,
    steps: int = STEPS,
    size: int = SIZE,
) -> LinearModel:
    """Logistic regression with an L2 penalty for a 0/1 target, from ``hashed_words``.

    Documents with ``doc_id % holdout = 0`` are left out of everything, for an honest evaluation;
    ``holdout=None`` trains on all labels. Rows without a label are not used. Without training
    rows all weights are 0 and nothing reaches the threshold.
    """
    known = labels.where(F.col(target).isNotNull())
    known = known if holdout is None else known.where(F.col("doc_id") % holdout != 0)
    rows = words.join(known.select("doc_id", F.col(target).cast("int").alias("y")), "doc_id")
    rows = written(rows.select("at", "y", F.pmod(F.xxhash64("doc_id"), F.lit(folds)).cast("int").alias("fold")), "labelled-words")
    sizes = {r["fold"]: r["count"] for r in rows.groupBy("fold").count().collect()}
    total = sum(sizes.values())
    if not total:
        return LinearModel(np.zeros(size + 1), penalties[0], 1.1, 0.0)
    # A model for each penalty and fold, and one of each penalty on all rows: fold -1.
    grid = [(p, f) for p in penalties for f in (*range(folds), -1)]
    penalty, fold_of = (np.array(x) for x in zip(*grid, strict=True))
    n = np.array([total - sizes.get(f, 0) for f in fold_of.tolist()])[:, None]
    weights = np.zeros((len(grid), size + 1))
    ahead = weights.copy()
    # No curvature of the mean loss is above 1/2: vectors have length 1, the constant is another 1.
    rate = 1 / (0.5 + penalty[:, None])
    for step in range(steps):
        gradient = _gradient(rows, ahead, fold_of) / np.maximum(n, 1)
        gradient[:, :-1] += penalty[:, None] * ahead[:, :-1]
        before, weights = weights, ahead - rate * gradient
        ahead = weights + step / (step + 3) * (weights - before)
    chosen = (-1.0, 0.0, 0)
    for i, p in enumerate(penalties):
        own = weights[i * (folds + 1) : i * (folds + 1) + folds]
        left_out = predict_linear(rows.withColumn("doc_id", F.lit(0).cast("long")), own, by_fold=True)
        threshold, f1 = _threshold(left_out.groupBy(F.floor(F.col("score") * GRID).cast("int").alias("bin"), "y").agg(F.count("*").alias("n")))
        if f1 > chosen[0]:
            chosen = (f1, threshold, i)
    f1, threshold, i = chosen
    return LinearModel(weights[i * (folds + 1) + folds], penalties[i], threshold, f1)


def predict_linear(words: DataFrame, weights: np.ndarray, by_fold: bool = False) -> DataFrame:
    """``doc_id, score``, the chance of the label; with ``by_fold`` also ``y``, each row scored by the
    model of its fold."""
    sent = words.sparkSession.sparkContext.broadcast(np.atleast_2d(weights))

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, at, lengths in _slices(batches):
            margins = _margins(sent.value, at, lengths)
            fold = part.column("fold").to_numpy() if by_fold else np.zeros(len(lengths), dtype=int)
            chance = 1 / (1 + np.exp(-np.clip(margins[fold, np.arange(len(lengths))], -50, 50)))
            columns = {"doc_id": part.column("doc_id"), "score": pa.array(chance)}
            yield pa.RecordBatch.from_pydict(columns | ({"y": part.column("y")} if by_fold else {}))

    return words.mapInArrow(scores, "doc_id bigint, score double" + (", y int" if by_fold else ""))


def score_linear(model: LinearModel, words: DataFrame) -> DataFrame:
    """``doc_id, pred, score``: 1 where the chance reaches the model's threshold; one row per row."""
    return predict_linear(words, model.weights).select("doc_id", (F.col("score") >= model.threshold).cast("int").alias("pred"), "score")
