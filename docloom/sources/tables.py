"""Parquet sources, the postings sink and scratch tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local_scratch: list[str] = []
# Only a scan of fewer tasks than this is ever dealt out again.
SPREAD_TASKS = 16


def read_table(spark: SparkSession, folder: str, name: str, spread: bool = False) -> DataFrame:
    """A parquet table.

    ``spread`` deals a table out to all cores that its scan would leave to fewer tasks, as a table
    of one row group is. A scan has a task for each 128 MB at least, so no large table is moved.
    """
    table = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return table.repartition(cores) if spread and table.rdd.getNumPartitions() < min(cores, SPREAD_TASKS) else table


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    A folder on this machine is made only where the setting is missing and the session is local.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local_scratch:
        _local_scratch.append(tempfile.mkdtemp(prefix="docloom-"))
    return _local_scratch[0]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a scratch table and read it back: computed once, survives executor loss."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_bucketed(df: DataFrame, key: str, path: str, name: str | None = None, buckets: int | None = None) -> DataFrame:
    """``df`` as a table at ``path`` in buckets of ``key``, sorted by it: joins on the key shuffle the
    other side only. ``name`` is the table's in the session's catalog, one of its own by default;
    ``buckets`` are as many as shuffle partitions, so that both sides agree without more ado."""
    spark = df.sparkSession
    name = name or f"bucketed_{uuid.uuid4().hex}"
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    (
        df.repartition(buckets, key)
        .write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path).mode("errorifexists").saveAsTable(name)
    )
    return spark.table(name)


def write_postings(postings: DataFrame, path: str, partitions: int | None = None, mode: str = "overwrite") -> None:
    """Sink for a search index.

    Ranges over (term, doc_id) keep a term's rows together, so row groups are skipped by term,
    and still cut a very frequent term into several files.
    """
    keys = [F.col("term"), F.col("doc_id")]
    ranged = (
        postings.repartitionByRange(partitions, *keys)
        if partitions
        else postings.repartitionByRange(*keys)
    )
    ranged.sortWithinPartitions(*keys).write.mode(mode).parquet(path)


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
