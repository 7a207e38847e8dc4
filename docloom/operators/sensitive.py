"""Sensitive content: spans, labels, masking, external-use decisions and their audit."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.spans import HIGH, PATTERNS, all_found, found, masked_text, masked_value


def find_sensitive_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, kind, ord, value_hash, value_masked``; one scan, and no raw value leaves it."""

    def numbered(kind: str) -> Column:
        return F.transform(
            found("text", kind),
            lambda value, i: F.struct(
                F.lit(kind).alias("kind"), i.cast("long").alias("ord"), value.alias("value")
            ),
        )

    # One array of (kind, ord, value) per document, so the text is read once for all kinds.
    spans = F.concat(*[numbered(kind) for kind in PATTERNS])
    return docs.select("doc_id", F.inline(spans)).select(
        "doc_id",
        "kind",
        "ord",
        F.sha2("value", 256).alias("value_hash"),
        masked_value(F.col("value")).alias("value_masked"),
    )


def _level_from_counts(counts: Column) -> Column:
    high = reduce(lambda a, b: a + b, [counts[kind] for kind in HIGH])
    any_kind = reduce(lambda a, b: a + b, [counts[kind] for kind in PATTERNS])
    return F.when(high > 0, "high").when(any_kind > 0, "medium").otherwise("none")


def sensitivity_label(docs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """``doc_id, n_spans, kinds, level`` for every document, from its own row, and ``carry``."""
    spans = docs.withColumn("_spans", all_found("text"))
    counts = F.struct(*[F.size(F.col("_spans")[kind]).alias(kind) for kind in PATTERNS])
    kinds = F.concat_ws(
        ",", *[F.when(F.col("_counts")[kind] > 0, F.lit(kind)) for kind in sorted(PATTERNS)]
    )
    n_spans = reduce(lambda a, b: a + b, [F.col("_counts")[kind] for kind in PATTERNS])
    return spans.withColumn("_counts", counts).select(
        *[c for c in docs.columns if c != "text"],
        n_spans.cast("long").alias("n_spans"),
        kinds.alias("kinds"),
        _level_from_counts(F.col("_counts")).alias("level"),
    ).select("doc_id", *carry, "n_spans", "kinds", "level")


def mask_sensitive(df: DataFrame, col: str) -> DataFrame:
    """``df`` with every span in ``col`` replaced by ``[KIND]``."""
    return df.withColumn(col, masked_text(col))


def decided(labelled: DataFrame, confirmations: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Join each labelled document with the verdict of its confirmations.

    All confirmations of a document count, and they are combined before the join.
    """
    verdicts = confirmations.groupBy("doc_id").agg(
        F.bool_and(F.coalesce("approved", F.lit(False))).alias("_approved")
    )
    decision = (
        F.when(F.col("level") == "none", "eligible")
        .when(F.col("_approved"), "eligible_confirmed")
        .otherwise("held")
    )
    return labelled.join(verdicts, "doc_id", "left").select(
        "doc_id", *carry, "level", decision.alias("decision")
    )


def route_external(docs: DataFrame, confirmations: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """``doc_id, level, decision``: may the document go to an external service?

    Only (doc_id, level) and the columns of ``carry`` are joined; the text stays in the scan.
    """
    return decided(sensitivity_label(docs, carry).select("doc_id", *carry, "level"), confirmations, carry)


def egress_audit(decisions: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """``source, decision, n`` with subtotals marked ``'*'``; the total is the document count.

    Decisions that carry their ``source`` need no ``docs``; for others they are joined.
    """
    placed = decisions
    if docs is not None:
        placed = docs.select("doc_id", "source").join(decisions.select("doc_id", "decision"), "doc_id", "left")
    finest = placed.groupBy("source", "decision").agg(F.count("*").alias("_n"))
    return finest.cube("source", "decision").agg(
        F.sum("_n").alias("n"),
        F.grouping("source").alias("_all_sources"),
        F.grouping("decision").alias("_all_decisions"),
    ).select(
        F.when(F.col("_all_sources") == 1, "*").otherwise(F.col("source")).alias("source"),
        F.when(F.col("_all_decisions") == 1, "*").otherwise(F.col("decision")).alias("decision"),
        "n",
    )
