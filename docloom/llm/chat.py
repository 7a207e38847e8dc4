"""Chat formatting by relational expressions only.

A conversation's turns are collected as structs, sorted and cut into blocks of adjacent turns of
one role. A block is its role's opening mark, its texts with ``[SEP]`` between them, and its
closing mark. Texts and unknown roles are escaped, so a control string in the output is always a
mark: a backslash goes behind the first character of every control string, and backslashes are
doubled. What assistants said is under the loss mask, text by text, marks excluded.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN, SEP = "<s>", "[SEP]"
# Opening and closing marks of the known roles; any other role is spelled out.
MARKS = {
    "user": ("[INST] ", " [/INST]"),
    "assistant": (" ", "</s>"),
    "system": ("<<SYS>>\n", "\n<</SYS>>\n\n"),
}
OTHER = ("[ROLE]", "[/ROLE] ", "[/END]")
# No text may hold these unescaped.
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "[/END]", "[SEP]"]


def _within(strings: list[str]) -> str:
    """Matches the empty place behind the first character of any of the strings."""
    return "|".join(f"(?<={re.escape(s[0])})(?={re.escape(s[1:])})" for s in strings)


def escaped(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, _within(CONTROL), r"\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _opening(role: Column) -> Column:
    out = F.concat(F.lit(OTHER[0]), escaped(role), F.lit(OTHER[1]))
    for name, (mark, _) in MARKS.items():
        out = F.when(role == name, F.lit(mark)).otherwise(out)
    return out


def _closing(role: Column) -> Column:
    out = F.lit(OTHER[2])
    for name, (_, mark) in MARKS.items():
        out = F.when(role == name, F.lit(mark)).otherwise(out)
    return out


def format_chat(turns: DataFrame, learned: str = "assistant") -> DataFrame:
    """``conv_id, formatted, loss`` for ``turns(conv_id, turn, role, text)``.

    ``loss`` lists ``struct(start, length)`` in code points of ``formatted``: the escaped texts of
    the ``learned`` role, one entry per turn, in order.

    Turns are in order of ``turn`` (nulls first), then role, then text, so ties and repeated rows
    have a defined place and are all kept. A null role or text is an empty one. A null ``conv_id``
    is a conversation of its own. No turns, no rows; other columns are not read. A conversation
    is one row, so it must fit in one: Spark's limit is 2 GB.
    """
    said = F.struct(
        F.col("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        escaped(F.coalesce("text", F.lit(""))).alias("text"),
    )
    collected = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(said)).alias("turns"))
    # Where a block begins: the first turn, and each whose role is not that of the turn before.
    spots = F.sequence(F.lit(1), F.size("turns"))
    begins = F.filter(
        spots,
        lambda i: (i == 1)
        | (F.element_at("turns", i)["role"] != F.element_at("turns", F.greatest(i - 1, F.lit(1)))["role"]),
    )
    ends = F.concat(F.slice("begins", F.lit(2), F.size("begins")), F.array(F.size("turns") + 1))
    blocks = F.transform(
        F.arrays_zip("begins", "ends"),
        lambda b: F.struct(
            F.element_at("turns", b["begins"])["role"].alias("role"),
            F.transform(F.slice("turns", b["begins"], b["ends"] - b["begins"]), lambda t: t["text"]).alias("texts"),
        ),
    )
    marked = F.transform(
        "blocks",
        lambda b: F.struct(
            (b["role"] == learned).alias("learned"),
            b["texts"].alias("texts"),
            _opening(b["role"]).alias("opening"),
            _closing(b["role"]).alias("closing"),
        ),
    )
    formatted = F.concat(
        F.lit(BEGIN),
        F.array_join(
            F.transform("marked", lambda b: F.concat(b["opening"], F.array_join(b["texts"], SEP), b["closing"])), ""
        ),
    )
    # The pieces in order: text or not, under the loss or not, and how long.
    pieces = F.flatten(
        F.transform(
            "marked",
            lambda b: F.concat(
                F.array(F.struct(F.lit(False).alias("learned"), F.length(b["opening"]).alias("length"))),
                F.flatten(
                    F.transform(
                        b["texts"],
                        lambda t, i: F.array(
                            F.struct(F.lit(False).alias("learned"), F.when(i == 0, 0).otherwise(len(SEP)).alias("length")),
                            F.struct(b["learned"].alias("learned"), F.length(t).alias("length")),
                        ),
                    )
                ),
                F.array(F.struct(F.lit(False).alias("learned"), F.length(b["closing"]).alias("length"))),
            ),
        )
    )
    none = F.array().cast("array<struct<start:int,length:int>>")
    spans = F.aggregate(
        "pieces",
        F.struct(F.lit(len(BEGIN)).alias("at"), none.alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + p["length"]).alias("at"),
            F.when(
                p["learned"],
                F.concat(acc["spans"], F.array(F.struct(acc["at"].alias("start"), p["length"].alias("length")))),
            )
            .otherwise(acc["spans"])
            .alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return (
        collected.withColumn("begins", begins)
        .withColumn("ends", ends)
        .withColumn("blocks", blocks)
        .withColumn("marked", marked)
        .withColumn("pieces", pieces)
        .select("conv_id", formatted.alias("formatted"), spans.alias("loss"))
    )


def _block_pattern() -> str:
    known = [f"{re.escape(a)}.*?{re.escape(b)}" for a, b in MARKS.values()]
    other = f"{re.escape(OTHER[0])}.*?{re.escape(OTHER[1])}.*?{re.escape(OTHER[2])}"
    return "(?s)" + "|".join([*known, other])


def _between(block: Column, opening: Column, closing: str) -> Column:
    return F.substring(block, F.length(opening) + 1, F.length(block) - F.length(opening) - len(closing))


def read_chat(formatted: DataFrame) -> DataFrame:
    """``conv_id, turns, learned`` read back from ``conv_id, formatted, loss``.

    ``turns`` is an array of ``struct(role, text)``, ``learned`` the texts under the loss mask.
    """
    rest = F.substring("formatted", len(BEGIN) + 1, F.length("formatted"))
    blocks = F.regexp_extract_all(rest, F.lit(_block_pattern()), F.lit(0))

    def told(block: Column) -> Column:
        spelled = F.concat(F.substring_index(block, OTHER[1], 1), F.lit(OTHER[1]))
        role = unescaped(_between(spelled, F.lit(OTHER[0]), OTHER[1]))
        body = _between(block, spelled, OTHER[2])
        for name, (opening, closing) in MARKS.items():
            mine = F.startswith(block, F.lit(opening))
            role = F.when(mine, F.lit(name)).otherwise(role)
            body = F.when(mine, _between(block, F.lit(opening), closing)).otherwise(body)
        return F.transform(
            F.split(body, re.escape(SEP), -1),
            lambda t: F.struct(role.alias("role"), unescaped(t).alias("text")),
        )

    return formatted.select(
        "conv_id",
        F.flatten(F.transform(blocks, told)).alias("turns"),
        F.transform(
            "loss", lambda s: unescaped(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))
        ).alias("learned"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def digests(read: DataFrame) -> DataFrame:
    """Counts and digests of what ``read_chat`` returns."""
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join("learned", "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned.cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
