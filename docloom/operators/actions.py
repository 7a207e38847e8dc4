"""Organisation actions: propose, gate behind confirmation, apply, summarise.

A proposal is ``action_id, doc_id, kind, target, destructive, reason``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import normalised
from docloom.plans.shapes import keyed_join
from docloom.sources.tables import written

# The statuses whose actions may run.
RUNNABLE = ("auto", "approved")


def _proposal(kind: str, target: Column, reason: Column, destructive: bool = False) -> list[Column]:
    target = target.cast("string")
    named = F.concat(F.lit(kind + ":"), F.col("doc_id").cast("string"), F.lit(":"), target)
    return [
        F.sha2(named, 256).alias("action_id"),
        F.col("doc_id"),
        F.lit(kind).alias("kind"),
        target.alias("target"),
        F.lit(destructive).alias("destructive"),
        reason.alias("reason"),
    ]


def propose_moves(docs: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """One ``move`` to the space named like the class, where the document is not there yet.

    Documents that carry their ``cls`` need no ``classes``; for others they are joined.
    """
    placed = docs.select("doc_id", "source", *([] if classes is not None else ["cls"]))
    if classes is not None:
        placed = placed.join(classes.select("doc_id", "cls"), "doc_id")
    # A class that is an expression would be evaluated again for each use below: a generator's
    # output is a value that the optimizer doesn't put back into them.
    placed = placed.select("doc_id", "source", F.explode(F.array("cls")).alias("cls"))
    return (
        placed.where(~F.col("source").eqNullSafe(F.col("cls")) & F.col("cls").isNotNull())
        .select(*_proposal("move", F.col("cls"), F.concat(F.lit("class "), F.col("cls"))))
    )


def propose_tags(keywords: DataFrame) -> DataFrame:
    """One ``tag`` per document: its top keyword."""
    return keywords.where(F.col("rank") == 1).select(
        *_proposal("tag", F.col("term"), F.lit("top keyword"))
    )


def propose_dedup(docs: DataFrame) -> DataFrame:
    """``delete`` every copy of a normalised text but the lowest ``doc_id``.

    The group minimum is combined before the shuffle, and the largest groups of copies get it by
    broadcast, so a text copied over a third of the documents is spread like any other. Writes
    the hashes as a scratch table, so that the texts are read once.
    """
    hashed = written(
        docs.select("doc_id", normalised("text").alias("_text"))
        .where(F.col("_text") != "  ")
        .select("doc_id", F.sha2("_text", 256).alias("_hash")),
        "text-hashes",
    )
    groups = hashed.groupBy("_hash").agg(
        F.min("doc_id").alias("_kept"), F.count("*").alias("_copies")
    )
    return (
        keyed_join(hashed, groups.where("_copies > 1"), "_hash", "_copies")
        .where("doc_id <> _kept")
        .select(*_proposal("delete", F.col("_kept"), F.lit("same text"), destructive=True))
    )


def gate_actions(proposals: DataFrame, confirmations: DataFrame) -> DataFrame:
    """Proposals with ``status``: auto, approved, rejected or pending."""
    verdicts = confirmations.groupBy("action_id").agg(
        F.bool_or(~F.col("approved")).alias("_refused"),
        F.bool_or(F.col("approved").isNull()).alias("_open"),
    )
    status = (
        F.when(~F.col("destructive"), "auto")
        .when(F.col("_refused"), "rejected")
        .when(F.col("_open").isNull() | F.col("_open"), "pending")
        .otherwise("approved")
    )
    return (
        proposals.join(verdicts, "action_id", "left")
        .withColumn("status", status)
        .drop("_refused", "_open")
    )


def apply_actions(docs: DataFrame, gated: DataFrame) -> DataFrame:
    """The documents after the runnable actions, with ``tags``; the input is left alone.

    Delete beats move; of several moves the smallest ``action_id`` counts. All actions of a
    document become one row first, so the documents are joined once. Documents in buckets of
    ``doc_id`` (``sources.tables.write_bucketed``) are not moved for it, only the actions are.
    """
    runnable = gated.where(F.col("status").isin(*RUNNABLE))
    # Equal tags of a document merge before they are gathered.
    single = runnable.groupBy("doc_id", "kind", "target").agg(F.min("action_id").alias("action_id"))
    per_doc = single.groupBy("doc_id").agg(
        F.bool_or(F.col("kind") == "delete").alias("_delete"),
        F.min(F.when(F.col("kind") == "move", F.struct("action_id", "target"))).alias("_move"),
        F.array_join(
            F.sort_array(F.collect_list(F.when(F.col("kind") == "tag", F.col("target")))), ","
        ).alias("_tags"),
    )
    return (
        docs.join(per_doc, "doc_id", "left")
        .where(~F.coalesce("_delete", F.lit(False)))
        .withColumn("source", F.coalesce(F.col("_move.target"), F.col("source")))
        .withColumn("tags", F.coalesce("_tags", F.lit("")))
        .drop("_delete", "_move", "_tags")
    )


def action_summary(gated: DataFrame) -> DataFrame:
    """``kind, status, n``."""
    return gated.groupBy("kind", "status").agg(F.count("*").alias("n"))
