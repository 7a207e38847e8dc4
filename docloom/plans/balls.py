"""Exact nearest vectors for many queries: vectors in balls, skipped by the triangle inequality.

Every vector belongs to the ball of its nearest centre. A query at distance d of a centre is at
least d - r from all of a ball of radius r, so once ``k`` neighbours are known, only balls that may
hold a nearer one are met. Queries and vectors stay tables: a query is a row for each ball it meets,
and queries and vectors of a ball meet in cells of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.plans.shapes import top_k
from docloom.plans.vectors import _Best, _unit
from docloom.sources.tables import written

# Centres, and vectors that they are chosen from, at most.
BALLS, SAMPLE, SAMPLE_BYTES = 64, 2048, 32 << 20
# Bytes of vectors in one side of a cell, about.
CELL_BYTES = 4 << 20
# Cosines nearer than this may round alike, so nothing is left out for less.
SLACK = 2e-6


def _stacked(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64)


def _centres(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Centres for each length of vectors: far from each other, among a bounded sample.

    Lengths that the sample hasn't got have one centre, the origin, that rules nothing out.
    """
    size = vectors.agg(F.max(F.size("embedding"))).first()[0] or 1
    rows = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * size)))
    sample = vectors.select("embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(rows).toPandas()
    found: dict[int, np.ndarray] = {}
    for length, part in sample.groupby(sample["embedding"].map(len)):
        unit, valid = _unit(_stacked(part["embedding"]))
        unit = unit[valid]
        if not len(unit):
            continue
        chosen = [0]
        away = np.linalg.norm(unit - unit[0], axis=1)
        while len(chosen) < min(BALLS, len(unit)) and away.max() > 0:
            chosen.append(int(away.argmax()))
            away = np.minimum(away, np.linalg.norm(unit - unit[chosen[-1]], axis=1))
        found[int(length)] = unit[chosen]
    return found


def _distances(unit: np.ndarray, centres: np.ndarray | None) -> np.ndarray:
    centres = np.zeros((1, unit.shape[1])) if centres is None else centres
    squares = (unit * unit).sum(axis=1)[:, None] + (centres * centres).sum(axis=1) - 2 * unit @ centres.T
    return np.sqrt(np.maximum(squares, 0.0))


def _by_length(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, pd.DataFrame, np.ndarray]]:
    """Rows with a direction, by the length of their vector, and their unit vectors."""
    for batch in batches:
        for length, part in batch.groupby(batch["embedding"].map(len)):
            unit, valid = _unit(_stacked(part["embedding"]))
            if valid.any():
                yield int(length), part[valid], unit[valid]


def nearest_in_balls(embeddings: DataFrame, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """``qid, vec_id, score``, each query's nearest with some more, and ``qid, length, ball``, what was met.

    Both sides are ``id, embedding``; zero vectors, and those of other lengths, have no score. The
    vectors with their balls, the balls, and the queries' balls become scratch tables.
    """
    spark = embeddings.sparkSession
    usable = (F.size("embedding") > 0) & F.col("embedding").isNotNull()
    vectors = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(usable)
    asked = queries.select("qid", F.col("embedding").cast("array<double>").alias("embedding")).where(usable)
    centres = spark.sparkContext.broadcast(_centres(vectors))
    qid = queries.schema["qid"].dataType.simpleString()

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for length, part, unit in _by_length(batches):
            away = _distances(unit, centres.value.get(length))
            ball = away.argmin(axis=1)
            yield pd.DataFrame(
                {"vec_id": part["vec_id"], "length": length, "ball": ball, "away": away[np.arange(len(ball)), ball], "embedding": list(unit)}
            )

    dealt = written(vectors.mapInPandas(placed, "vec_id bigint, length int, ball int, away double, embedding array<double>"), "ball-vectors")
    balls = written(dealt.groupBy("length", "ball").agg(F.max("away").alias("radius"), F.count("*").alias("n")), "balls")

    def reached(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for length, part, unit in _by_length(batches):
            away = _distances(unit, centres.value.get(length))
            at, ball = np.indices(away.shape).reshape(2, -1)
            yield pd.DataFrame({"qid": part["qid"].to_numpy()[at], "length": length, "ball": ball, "away": away.reshape(-1), "embedding": list(unit[at])})

    # A row for each centre, of which there are at most BALLS a length; those of empty balls go.
    pairs = asked.mapInPandas(reached, f"qid {qid}, length int, ball int, away double, embedding array<double>")
    gap = F.greatest(F.col("away") - F.col("radius"), F.lit(0.0))
    # No cosine in the ball is higher; the distances themselves are rounded a little.
    pairs = pairs.join(F.broadcast(balls), ["length", "ball"]).withColumn("bound", 1 - F.pow(gap, F.lit(2)) / 2 + F.lit(1e-9))
    first = top_k(pairs, ["qid"], [F.desc("bound"), F.asc("away"), F.asc("ball")], 1, rank="_order").drop("_order")
    first = written(first, "first-balls")
    near = written(_met(dealt, first, balls, k, qid), "first-hits")
    # The k-th of the first ball's; a query that found fewer there asks all others.
    least = top_k(near, ["qid"], [F.desc("score"), F.asc("vec_id")], k).where(F.col("rank") == k).select("qid", F.col("score").alias("least"))
    rest = (
        pairs.join(first.select("qid", "length", "ball"), ["qid", "length", "ball"], "left_anti")
        .join(least, "qid", "left")
        .where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - SLACK))
    )
    rest = written(rest.drop("least"), "other-balls")
    met = first.select("qid", "length", "ball").unionByName(rest.select("qid", "length", "ball"))
    return near.unionByName(_met(dealt, rest, balls, k, qid)), met


def _met(dealt: DataFrame, pairs: DataFrame, balls: DataFrame, k: int, qid: str) -> DataFrame:
    """The ``k`` nearest of each query and cell, for queries and vectors that share a ball."""
    key = ["length", "ball"]
    counts = balls.select(*key, F.col("n").alias("_nv")).join(pairs.groupBy(*key).agg(F.count("*").alias("_nq")), key)
    rows = F.greatest(F.lit(1), F.lit(CELL_BYTES) / (8 * F.col("length")))
    # At most a row for each ball.
    counts = counts.select(*key, F.ceil(F.col("_nv") / rows).alias("_i_all"), F.ceil(F.col("_nq") / rows).alias("_j_all"))

    def cells(side: DataFrame, name: str, here: str, there: str) -> DataFrame:
        every: Column = F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{there}_all") - 1))
        cut = side.join(F.broadcast(counts), key).withColumn(here, F.pmod(F.xxhash64(name), F.col(f"{here}_all")))
        return cut.withColumn(there, every).select(*key, "_i", "_j", name, "embedding").groupBy(*key, "_i", "_j")

    def meet(mine: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(mine) or not len(asked):
            return pd.DataFrame({"qid": [], "vec_id": [], "score": []})
        best = _Best(asked["qid"].tolist(), asked["embedding"].tolist(), k)
        best.add(mine["vec_id"].to_numpy(), _stacked(mine["embedding"]))
        return best.frame()

    both = cells(dealt, "vec_id", "_i", "_j").cogroup(cells(pairs, "qid", "_j", "_i"))
    return both.applyInPandas(meet, f"qid {qid}, vec_id bigint, score double")
