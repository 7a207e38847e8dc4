"""Sharding by a permutation-filled lookup table.

Every shard has a preference order over the slots of a table of prime size: from an offset of its
own it steps by a skip of its own, which visits every slot since the size is prime. Shards take
turns claiming their next free slot until the table is full. A document's key hashes to a slot, and
the slot names the shard. The table depends on the shards' names alone; taking a shard away moves
its documents and few others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A prime; the table has that many rows whatever the data, so it can be broadcast.
SLOTS = 65_537


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill_table(shards: Sequence[str], slots: int = SLOTS, turns: Sequence[int] | None = None) -> list[int]:
    """For each slot, the position of its shard in ``shards``.

    ``turns`` gives a shard more than one claim in each round. Shards are asked in the order of
    their names, so the order in which they are given changes nothing.
    """
    if not _is_prime(slots):
        raise ValueError("the number of slots must be prime")
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("give different shards, at least one, and no more than slots")
    turns = list(turns or [1] * len(shards))
    if len(turns) != len(shards) or min(turns) < 1:
        raise ValueError("every shard needs at least one turn")
    walk = []
    for name in shards:
        digest = hashlib.sha256(name.encode()).digest()
        offset, skip = int.from_bytes(digest[:8]) % slots, int.from_bytes(digest[8:16]) % (slots - 1) + 1
        walk.append([offset, skip])
    table, left = [-1] * slots, slots
    order = sorted(range(len(shards)), key=lambda i: shards[i])
    while left:
        for i in order:
            for _ in range(turns[i]):
                if not left:
                    break
                at, skip = walk[i]
                while table[at] >= 0:
                    at = (at + skip) % slots
                table[at] = i
                walk[i][0] = (at + skip) % slots
                left -= 1
    return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """First 15 hex digits of the MD5 of the key as text, modulo the size. A null key is ''."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def table_frame(spark: SparkSession, shards: Sequence[str], slots: int = SLOTS, turns: Sequence[int] | None = None) -> DataFrame:
    """``slot, shard``: ``slots`` rows."""
    rows = [(slot, shards[i]) for slot, i in enumerate(fill_table(shards, slots, turns))]
    return spark.createDataFrame(rows, "slot int, shard string")


def place(df: DataFrame, key: Column, shards: Sequence[str], slots: int = SLOTS, turns: Sequence[int] | None = None) -> DataFrame:
    """``df`` with the columns ``slot`` and ``shard``, which replace its own of that name.

    Rows with equal keys are in one shard, repeated rows too; null keys are placed like ''. The
    table has ``slots`` rows, a parameter, and is broadcast; ``df`` is not shuffled.
    """
    clear = df.drop("slot", "shard").withColumn("slot", slot_of(key, slots))
    table = table_frame(df.sparkSession, shards, slots, turns)
    return clear.join(F.broadcast(table), "slot", "left")


def write_shards(placed: DataFrame, path: str, files: int = 8) -> None:
    """Write a folder per shard. A shard, however large, is dealt to ``files`` tasks."""
    spread = F.pmod(F.xxhash64(*placed.columns), F.lit(files))
    placed.repartition("shard", spread).write.partitionBy("shard").parquet(path)
