"""The linear classifier against one in numpy on all rows at once."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from docloom.operators import linear

SIZE = 64


def labelled(spark, n=240):
    rng = random.Random(5)
    rows = []
    for i in range(n):
        y = rng.random() < 0.3
        words = [f"w{rng.randrange(40)}" for _ in range(rng.randrange(1, 12))] + (["bad"] * 2 if y and rng.random() < 0.9 else [])
        rows.append((i, " ".join(words), int(y)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string").repartition(5)
    return docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, toxic int")


def plain(rows, penalty, steps):
    """Accelerated descent on dense rows."""
    x = np.zeros((len(rows), SIZE + 1))
    for i, r in enumerate(rows):
        x[i, r["at"]] = 1 / np.sqrt(max(1, len(r["at"])))
    x[:, -1] = 1
    y = np.array([r["y"] for r in rows])
    w = ahead = np.zeros(SIZE + 1)
    for step in range(steps):
        g = x.T @ (1 / (1 + np.exp(-x @ ahead)) - y) / len(rows)
        g[:-1] += penalty * ahead[:-1]
        before, w = w, ahead - g / (0.5 + penalty)
        ahead = w + step / (step + 3) * (w - before)
    return w


def test_same_weights_as_on_all_rows_at_once(spark):
    docs, labels = labelled(spark)
    words = linear.hashed_words(docs, SIZE)
    model = linear.train_linear(words, labels, "toxic", penalties=(1e-2,), steps=6, size=SIZE)
    rows = words.join(labels.withColumnRenamed("toxic", "y"), "doc_id").where("doc_id % 5 <> 0").collect()
    assert np.allclose(model.weights, plain(rows, 1e-2, 6))
    scores = {r.doc_id: r.score for r in linear.score_linear(model, words).collect()}
    r = rows[0]
    at = np.array(r["at"])
    assert np.isclose(scores[r["doc_id"]], 1 / (1 + np.exp(-(model.weights[at].sum() / np.sqrt(len(at)) + model.weights[-1]))))


def test_held_out_rows_change_nothing(spark):
    docs, labels = labelled(spark, 100)
    words = linear.hashed_words(docs, SIZE)
    turned = labels.withColumn("toxic", F.when(F.col("doc_id") % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (linear.train_linear(words, x, "toxic", steps=3, size=SIZE) for x in (labels, turned))
    assert np.allclose(a.weights, b.weights) and a.threshold == b.threshold and a.penalty == b.penalty


def test_telling_words_are_learned(spark):
    docs, labels = labelled(spark)
    words = linear.hashed_words(docs)
    model = linear.train_linear(words, labels, "toxic", steps=20)
    assert model.fold_f1 > 0.8
    found = linear.score_linear(model, words).where("doc_id % 5 = 0").join(labels, "doc_id").collect()
    right = sum(r.pred == r.toxic for r in found)
    assert right / len(found) > 0.85


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a a b"), (None, "a")], "doc_id bigint, text string")
    words = linear.hashed_words(docs, SIZE)
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    model = linear.train_linear(words, none, "toxic", steps=2, size=SIZE)
    assert [(r.pred, r.score) for r in linear.score_linear(model, words).collect()] == [(0, 0.5)] * 4
    some = spark.createDataFrame([(1, 0), (2, 1), (3, 1), (5, None)], "doc_id bigint, toxic int")
    assert linear.score_linear(linear.train_linear(words, some, "toxic", steps=2, size=SIZE), words).count() == 4
    assert linear.score_linear(model, words.limit(0)).count() == 0
