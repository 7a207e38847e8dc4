"""A search index in segments: documents are added, changed and deleted without a rebuild.

A segment is a folder of postings and a folder of tombstones. A tombstone says that what earlier
segments hold of a document is gone; postings of its own segment stay, so a changed document is a
tombstone and new postings. Segments are written once and never touched. Merging writes what is
alive as a new index, after which readers may be pointed to it and the old folder dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.plans.shapes import BROADCAST_BYTES, is_small
from docloom.sources.tables import write_postings, written

# Tombstones up to this many go to every task.
FEW_TOMBSTONES = 1_000_000


def write_segment(path: str, number: int, postings: DataFrame, gone: DataFrame | None = None) -> None:
    """Segment ``number``, higher than those there are: ``postings`` of new and changed documents, and
    the ``doc_id`` of documents ``gone``: deleted, or changed and so among the postings again.

    A segment that is there is an error, so a repeated job cannot mix two versions of one.
    """
    spark = postings.sparkSession
    ids = spark.createDataFrame([], "doc_id bigint") if gone is None else gone.select(F.col("doc_id").cast("bigint").alias("doc_id"))
    # Tombstones first: a reader must not see a changed document twice.
    ids.where("doc_id is not null").distinct().write.mode("errorifexists").parquet(f"{path}/tombstones/segment={number}")
    write_postings(postings, f"{path}/postings/segment={number}", mode="errorifexists")


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """The live postings of an index, with the columns they were written with.

    Tombstones are few beside postings and go to the tasks while they are; more of them, or wider,
    take a shuffle by document. Filters on the term reach the scan of each segment.
    """
    postings = spark.read.parquet(f"{path}/postings")
    stones = spark.read.parquet(f"{path}/tombstones").groupBy("doc_id").agg(F.max("segment").alias("_gone"))
    stones = written(stones, "tombstones")
    small = is_small(stones, FEW_TOMBSTONES, BROADCAST_BYTES)
    met = postings.join(F.broadcast(stones) if small else stones, "doc_id", "left")
    kept = met.where(F.col("_gone").isNull() | (F.col("segment") >= F.col("_gone")))
    return kept.select(*[c for c in postings.columns if c != "segment"])


def merge_segments(spark: SparkSession, path: str, out: str) -> None:
    """What is alive in the index at ``path``, as one segment of a new index at ``out``."""
    write_segment(out, 0, read_segments(spark, path))
