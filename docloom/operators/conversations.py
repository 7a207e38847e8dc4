"""Conversation turns: threads, preceding context, context queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import body, tokens
from docloom.operators.index import corpus_totals, term_stats
from docloom.plans.shapes import BLOCK, block_of, keyed_join, top_k, with_preceding
from docloom.sources.tables import written


def _spoken() -> F.Column:
    return F.concat(body("role"), F.lit(":"), body("text"))


def conversation_threads(turns: DataFrame, part_turns: int = BLOCK) -> DataFrame:
    """``conv_id, part, n_turns, first_role, last_role, transcript`` from ``conv_id, turn, role, text``.

    One row per conversation, ``part`` 0. A conversation running past turn ``part_turns`` gives
    one row per stretch of that many turn numbers, so no row and no task holds it whole; counts
    and roles are always those of the conversation.
    """
    cut = turns.withColumn("part", block_of("turn", part_turns))
    texts = cut.groupBy("conv_id", "part").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("turn", _spoken().alias("line")))),
                lambda entry: entry["line"],
            ),
            "\n",
        ).alias("transcript")
    )
    # Heads carry no text, so a window over a whole conversation's heads stays small.
    heads = cut.groupBy("conv_id", "part").agg(
        F.count("*").alias("_n"),
        F.min_by("role", "turn").alias("_first"),
        F.max_by("role", "turn").alias("_last"),
    )
    whole = (
        Window.partitionBy("conv_id")
        .orderBy("part")
        .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    totals = heads.select(
        "conv_id",
        "part",
        F.sum("_n").over(whole).alias("n_turns"),
        F.first("_first").over(whole).alias("first_role"),
        F.last("_last").over(whole).alias("last_role"),
    )
    return texts.join(totals, ["conv_id", "part"]).select(
        "conv_id",
        F.expr(f"part div {part_turns}").alias("part"),
        "n_turns",
        "first_role",
        "last_role",
        "transcript",
    )


def context_window(turns: DataFrame, k: int = 3, block: int = BLOCK) -> DataFrame:
    """``conv_id, turn, role, ctx``: up to ``k`` preceding turns as ``role:text`` lines."""
    said = turns.select("conv_id", "turn", "role", _spoken().alias("_line"))
    seen = with_preceding(said, "conv_id", "turn", "_line", k, "_before", block)
    return seen.select("conv_id", "turn", "role", F.array_join("_before", "\n").alias("ctx"))


def context_query_terms(
    turns: DataFrame,
    postings: DataFrame,
    back: int = 2,
    max_terms: int | None = None,
    max_df_ratio: float | None = None,
    stats: DataFrame | None = None,
    n_docs: DataFrame | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """``conv_id, turn, term, weight``: search terms for each user turn.

    Own terms weigh 1, those of the j-th previous user turn 0.5^j; all that the corpus has are
    kept. A caller who wants fewer may give ``max_df_ratio``, which leaves out terms of a larger
    share of the documents, and ``max_terms``, which keeps the best by ``round(weight * idf, 6)``,
    then by term. ``stats`` and ``n_docs`` (see ``corpus_totals``) may be given where they exist
    already. Writes the weighed terms as a scratch table.
    """
    stats = term_stats(postings) if stats is None else stats
    asked = turns.where(F.col("role") == "user").select(
        "conv_id", "turn", F.array_distinct(tokens("text")).alias("_own")
    )
    heard = with_preceding(asked, "conv_id", "turn", "_own", back, "_before", block)
    said = F.transform(F.col("_own"), lambda t: F.struct(t.alias("term"), F.lit(1.0).alias("w")))
    said_before = F.flatten(
        F.transform(
            F.reverse("_before"),
            lambda terms, j: F.transform(
                terms, lambda t: F.struct(t.alias("term"), F.pow(F.lit(0.5), j + 1).alias("w"))
            ),
        )
    )
    # Counted by term and then joined by term: written, so that the turns are windowed once.
    weighed = written(
        heard.select("conv_id", "turn", F.explode(F.concat(said, said_before)).alias("_t"))
        .groupBy("conv_id", "turn", F.col("_t.term").alias("term"))
        .agg(F.sum("_t.w").alias("weight")),
        "turn-terms",
    )
    # Every term of the conversations, with how often it is used there and its corpus numbers.
    used = (
        weighed.groupBy("term")
        .agg(F.count("*").alias("_rows"))
        .join(stats.select("term", "df", "idf"), "term", "left")
    )
    kept = keyed_join(weighed, used, "term", "_rows").where(F.col("df").isNotNull())
    if max_df_ratio is not None:
        totals = corpus_totals(postings=postings) if n_docs is None else n_docs
        kept = kept.where(F.col("df") <= max_df_ratio * totals.select("n_docs").scalar())
    if max_terms is None:
        return kept.select("conv_id", "turn", "term", "weight")
    best = F.round(F.col("weight") * F.col("idf"), 6)
    return top_k(
        kept.withColumn("_best", best),
        ["conv_id", "turn"],
        [F.col("_best").desc(), F.col("term")],
        max_terms,
    ).select("conv_id", "turn", "term", "weight")
