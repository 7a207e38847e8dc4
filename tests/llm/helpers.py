"""Inputs and plain versions that several tests use."""

from __future__ import annotations

import duckdb

SMALL = "/root/testdata/sf0.001"

# Columns whose names the operators use inside; they must not get in the way.
CLASH = "kept string, score string, node string, comp string, shard int, slot string, key string, n string, ids string, bands int"
_CLASH = (None, "x", "y", None, 1, "s", "k", "n", "i", 7)


def odd_texts() -> list[str | None]:
    long = " ".join(f"word{i % 977} Ünï{i % 31}" for i in range(30_000))
    return [
        None, "", " ", "\n\t\r\n", "a", "A a a", "é́ ▁x  ▁▁ y ", "\x00\x01 z\x1cq w 　end", "😀👍🏽 <s> </s> <|endoftext|>",
        "one two three four five six seven eight nine ten eleven twelve", "ONE two three four five six seven eight nine ten eleven twelve",
        "same line\nsame line\nother\nsame line", "x" * 5_000, "a " * 5_000, long,
    ]


def odd_docs(spark):
    """Null, repeated and clashing rows; ids are not dense."""
    rows = [(i * 7, t, "en", "s") for i, t in enumerate(odd_texts())]
    rows += [rows[9], (None, "no id at all here", None, None), (None, None, "de", None), (1000, rows[9][1], None, "s")]
    return spark.createDataFrame([(*r, *_CLASH) for r in rows], f"doc_id long, text string, lang string, source string, {CLASH}")


def table(name: str, folder: str = SMALL, columns: str = "*") -> list[tuple]:
    return duckdb.connect().sql(f"select {columns} from '{folder}/{name}.parquet'").fetchall()
