"""Plan shapes that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.sources.tables import written

# At most this many keys are called heavy, so at most this many rows are ever broadcast.
HEAVY_KEYS = 10_000
# What is broadcast is at most this large, too.
BROADCAST_BYTES = 32 << 20
# Rows that a task sorts, about, where there are many.
TASK_ROWS = 2_000_000
# Order values that fall in one block of a long sequence.
BLOCK = 4096


def tasks_for(spark: SparkSession, rows: int) -> int | None:
    """How many tasks get TASK_ROWS of so many rows, or None where the session's own get no more.

    Partitions that the session merges by their bytes are as many as cores, whatever the rows, and
    a task's sort grows with them. A number that is asked for is never merged."""
    usual = min(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    tasks = -(-rows // TASK_ROWS)
    return tasks if tasks > usual else None


def top_k(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank", rows: int = 0
) -> DataFrame:
    """Rank the rows of each group and keep the first ``k``.

    Up to the session's group-limit threshold Spark prunes before the shuffle, so a group never
    arrives whole in one task. Beyond it, each group is first cut in slices that are pruned alone.

    Pruning sorts what a task has. Where ``rows`` says that this is much and groups are small, the
    rows are dealt out by group first, to tasks of bounded size.
    """
    spark = df.sparkSession
    tasks = tasks_for(spark, rows)
    df = df if tasks is None else df.repartition(tasks, *keys)
    limit = int(spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if k > limit:
        sliced = df.withColumn("_slice", F.pmod(F.xxhash64(*df.columns), F.lit(256)))
        window = Window.partitionBy(*keys, "_slice").orderBy(*order)
        df = (
            sliced.withColumn(rank, F.row_number().over(window))
            .where(F.col(rank) <= k)
            .drop("_slice", rank)
        )
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def keyed_join(
    left: DataFrame, right: DataFrame, key: str, rows: str, settled: bool = False
) -> DataFrame:
    """Inner join to a ``right`` that has one row per key and in ``rows`` how often left has it.

    Keys holding at least 1/HEAVY_KEYS of the left rows (there can be no more than HEAVY_KEYS of
    them, whatever the size of the data) are joined by broadcast and never shuffled. Every other
    key is too small to unbalance the shuffled join that takes the rest, in tasks of bounded size.

    ``right`` becomes a scratch table, unless it is ``settled`` as one already, and is counted.
    """
    right = right if settled else written(right, "keys")
    size = right.agg(
        F.count("*").alias("keys"), F.sum(rows).alias("total"), F.max(rows).alias("largest")
    ).first()
    if size["keys"] <= HEAVY_KEYS and is_small(right, HEAVY_KEYS, BROADCAST_BYTES):
        return left.join(F.broadcast(right.drop(rows)), key)
    limit = -(-(size["total"] or 0) // HEAVY_KEYS)
    tasks = tasks_for(left.sparkSession, size["total"] or 0)

    def shuffled(some: DataFrame, keys: DataFrame) -> DataFrame:
        """Neither side has a heavy key."""
        return some.join(keys, key) if tasks is None else some.repartition(tasks, key).join(keys.repartition(tasks, key), key)

    if (size["largest"] or 0) < limit:
        return shuffled(left, right.drop(rows))
    heavy = right.where(F.col(rows) >= limit).drop(rows)
    if not is_small(heavy, HEAVY_KEYS, BROADCAST_BYTES):
        # Rows too wide to broadcast: Spark's skew join has to split the heavy keys.
        return left.join(right.drop(rows), key)
    light = right.where(F.col(rows) < limit).drop(rows)
    by_broadcast = left.join(F.broadcast(heavy), key)
    rest = left.join(F.broadcast(heavy.select(key)), key, "left_anti")
    return by_broadcast.unionByName(shuffled(rest, light))


def block_of(order: str, block: int = BLOCK) -> Column:
    """First order value of the block that holds this one."""
    return F.col(order) - F.pmod(F.col(order), F.lit(block))


def with_preceding(
    df: DataFrame, key: str, order: str, value: str, k: int, out: str, block: int = BLOCK
) -> DataFrame:
    """Add the array ``out``: ``value`` of up to ``k`` preceding rows of the same key, in order.

    (``key``, ``order``) is unique. A key may hold any share of the rows, so the window runs per
    (key, block of order values), and rows near a block's start also get the tail of the blocks
    before. Only (key, block) pairs, without values, are ever windowed per key; the pairs become
    a scratch table.
    """

    def last_k(values: Column) -> Column:
        return F.slice(values, F.greatest(F.size(values) - k + 1, F.lit(1)), F.lit(k))

    cut = df.withColumn("_block", block_of(order, block))
    in_block = Window.partitionBy(key, "_block").orderBy(order)
    near = cut.withColumn("_near", F.collect_list(value).over(in_block.rowsBetween(-k, -1)))

    # Which blocks of a key come before which: no rows for keys of one block.
    earlier = Window.partitionBy(key).orderBy("_block").rowsBetween(-k, -1)
    sources = written(
        cut.select(key, "_block")
        .distinct()
        .withColumn("_froms", F.collect_list("_block").over(earlier))
        .select(key, "_block", F.explode("_froms").alias("_from")),
        "blocks",
    )
    if sources.isEmpty():
        return near.withColumnRenamed("_near", out).drop("_block")

    used = sources.select(key, F.col("_from").alias("_block")).distinct()
    ends = top_k(
        cut.select(key, "_block", order, value).join(used, [key, "_block"], "left_semi"),
        [key, "_block"],
        [F.col(order).desc()],
        k,
    )
    tails = ends.groupBy(key, F.col("_block").alias("_from")).agg(
        F.array_sort(F.collect_list(F.struct(order, F.col(value).alias("_value")))).alias("_tail")
    )
    carried = (
        sources.join(tails, [key, "_from"])
        .groupBy(key, "_block")
        .agg(F.array_sort(F.collect_list(F.struct("_from", "_tail"))).alias("_tails"))
        .select(key, "_block", F.flatten(F.col("_tails._tail"))["_value"].alias("_far"))
    )
    return (
        near.join(carried, [key, "_block"], "left")
        .withColumn(out, last_k(F.concat(F.coalesce("_far", F.slice("_near", 1, 0)), F.col("_near"))))
        .drop("_block", "_near", "_far")
    )


def grid_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    cell: int = 10_000,
    counts: DataFrame | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Inner join of two sides that may both hold a key many times.

    A key's left rows are cut in slices of about ``cell``, its right rows too, and each pair of
    slices meets in a group of its own. So no group holds more than a cell by a cell of a key,
    and keys that only one side has are never shuffled to the join.

    ``counts`` (key, left rows ``_nl``, right rows ``_nr``, NULL for none) may be given, with
    columns to ``carry`` into the result. The counts become a scratch table. Both sides are read
    more than once.
    """
    if counts is None:
        counts = left.groupBy(key).agg(F.count("*").alias("_nl")).join(
            right.groupBy(key).agg(F.count("*").alias("_nr")), key, "full_outer"
        )
    counts = written(counts, "key-counts")
    sides = []
    for side, mine, theirs, here, there, extra in (
        (left, "_nl", "_nr", "_i", "_j", list(carry)),
        (right, "_nr", "_nl", "_j", "_i", []),
    ):
        # The number of slices on this side and on the other.
        known = counts.where(F.col(mine).isNotNull()).select(
            key,
            F.col(mine).alias("_rows"),
            F.ceil(F.col(mine) / cell).alias("_here"),
            F.ceil(F.col(theirs) / cell).alias("_there"),
            *extra,
        )
        sides.append(
            keyed_join(side, known, key, "_rows", settled=True)
            .where(F.col("_there").isNotNull())
            .withColumn(here, F.pmod(F.xxhash64(*side.columns), F.col("_here")))
            .withColumn(there, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_there") - 1)))
            .drop("_here", "_there")
        )
    return sides[0].join(sides[1], [key, "_i", "_j"]).drop("_i", "_j")


def size_in_bytes(df: DataFrame) -> Column:
    """Aggregate: about how many bytes the rows take, by their JSON form."""
    return F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*df.columns)))), F.lit(0))


def is_small(df: DataFrame, rows: int, size: int) -> bool:
    """Whether ``df`` has at most that many rows and bytes, so that it may be broadcast. Looks at
    no more than one row beyond the limit; runs a job."""
    seen = df.limit(rows + 1).agg(F.count("*").alias("rows"), size_in_bytes(df).alias("size")).first()
    return seen["rows"] <= rows and seen["size"] <= size


def few_rows(df: DataFrame, limit: int) -> list | None:
    """The rows of ``df`` if there are at most ``limit``, else None. Runs a job."""
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None
