"""A training corpus from raw documents: five stages, each written and read again by the next.

Stages take ``(spark, docs, sf_dir)``. All but the last return the columns of ``docs``, those with
other names too. Decisions name documents by ``doc_id``: rows that repeat an id stay or go
together where a decision is joined back, and a row without an id, which no joined decision can
name, stays there.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import decontaminate, neardup, pieces, quality, toxicity
from docloom.sources.tables import written

MODEL = "piece_bpe_32k.model"


def _without(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """The documents that are not among those that ``judged`` doesn't keep."""
    gone = judged.where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")


def keep_sound(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return _without(docs, quality.judge(docs))


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.3 or more go."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(~toxicity.is_toxic(model)(F.col("text")))


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the smallest ``doc_id`` stays."""
    return _without(docs, neardup.near_duplicates(docs))


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with words inside benchmark windows go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return docs.where(~decontaminate.is_contaminated(benchmark)(F.col("text")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, ids`` of what is left, decoded again, with counts and digests."""
    model = pieces.read_model(public_tokenizers.path(MODEL))
    return pieces.digests(pieces.decode(pieces.encode(docs, model), model))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_sound),
    ("toxicity", keep_civil),
    ("near_duplicates", keep_distinct),
    ("decontamination", keep_clean),
    ("pieces", encode),
]

# No SQL: quality and toxicity are estimated, and pieces come from a library's model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
