"""Search metadata: postings, term statistics, keywords, profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import body, lines, symbol_ratio, tokens
from docloom.plans.shapes import keyed_join, top_k


def build_postings(docs: DataFrame, lengths: bool = False, carry: Sequence[str] = ()) -> DataFrame:
    """``term, doc_id, tf`` and, if asked, ``dl``, the number of tokens of the document.

    Columns named in ``carry`` stand beside each posting, so that a search can restrict documents
    by them in its scan; in an index, sorted by term, Parquet keeps a few codes for them.

    ``doc_id`` is unique. A document's counts depend on its row alone, so they are made there, as
    runs in its sorted tokens, and nothing is shuffled. To write an index use ``write_postings``.
    """
    # The sorted array is a column of its own so that it is made once per document.
    sorted_tokens = docs.select("doc_id", *carry, F.sort_array(tokens("text")).alias("_sorted"))
    size = F.size("_sorted")
    # Places alone: a row for each token would have to be made for most of them in vain.
    starts = F.filter(
        F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.slice(F.sequence(F.lit(0), F.lit(0)), 1, 0)),
        lambda i: (i == 0) | (F.get(F.col("_sorted"), i) != F.get(F.col("_sorted"), i - 1)),
    )
    counted = sorted_tokens.select("doc_id", *carry, size.cast("long").alias("dl"), "_sorted", starts.alias("_starts"))
    runs = F.transform(
        "_starts",
        lambda s, i: F.struct(
            F.get(F.col("_sorted"), s).alias("term"),
            (F.coalesce(F.get(F.col("_starts"), i + 1).cast("long"), F.col("dl")) - s).alias("tf"),
        ),
    )
    out = ["term", "doc_id", "tf"] + (["dl"] if lengths else []) + list(carry)
    return counted.select("doc_id", "dl", *carry, F.inline(runs)).select(*out)


def build_positions(docs: DataFrame) -> DataFrame:
    """``term, doc_id, at``: postings with the positions of the term among the document's tokens, from
    0 on, in order. Map-only, like ``build_postings``; write them with ``write_postings``."""
    placed = docs.select(
        "doc_id", F.sort_array(F.transform(tokens("text"), lambda t, i: F.struct(t.alias("term"), i.alias("at")))).alias("_placed")
    )
    first = F.filter(
        F.transform("_placed", lambda p, i: F.struct(p["term"].alias("term"), i.alias("from"))),
        lambda s: (s["from"] == 0) | (s["term"] != F.get(F.col("_placed"), s["from"] - 1)["term"]),
    )
    starts = placed.select("doc_id", "_placed", first.alias("_starts"))
    runs = F.transform(
        "_starts",
        lambda s, i: F.struct(
            s["term"].alias("term"),
            F.slice(
                "_placed", s["from"] + 1, F.coalesce(F.get(F.col("_starts"), i + 1)["from"], F.size("_placed")) - s["from"]
            )["at"].alias("at"),
        ),
    )
    return starts.select("doc_id", F.inline(runs)).select("term", "doc_id", "at")


def corpus_totals(docs: DataFrame | None = None, postings: DataFrame | None = None) -> DataFrame:
    """One row ``n_docs, n_tokens`` over the documents that have a token.

    From documents this is one scan without a shuffle of rows; from postings the documents have
    to be told apart first.
    """
    if docs is not None:
        sized = docs.select(F.size(tokens("text")).cast("long").alias("dl"))
    else:
        sized = postings.groupBy("doc_id").agg(F.sum("tf").alias("dl"))
    return sized.where("dl > 0").agg(
        F.count("*").alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("n_tokens")
    )


def term_stats(postings: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """``term, df, cf, idf``: documents, occurrences and ``round(ln(N / df), 6)`` of each term."""
    n_docs = (corpus_totals(postings=postings) if totals is None else totals).select("n_docs")
    return (
        postings.groupBy("term")
        .agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
        .withColumn("idf", F.round(F.log(n_docs.scalar() / F.col("df")), 6))
    )


def keywords_topk(postings: DataFrame, k: int = 5, totals: DataFrame | None = None) -> DataFrame:
    """``doc_id, term, weight, rank`` by weight ``round(tf * ln(N / df), 6)``, then term.

    Frequent terms, most rows of any text, meet their df by broadcast; only rows of rarer terms
    are shuffled by term. Where there are many, tasks are as many as bound what one sorts.
    """
    total = (corpus_totals(postings=postings) if totals is None else totals).first()
    counts = postings.groupBy("term").agg(F.count("*").alias("_rows")).withColumn("df", F.col("_rows"))
    weighed = keyed_join(postings.select("term", "doc_id", "tf"), counts, "term", "_rows").select(
        "doc_id",
        "term",
        F.round(F.col("tf") * F.log(F.lit(float(total["n_docs"])) / F.col("df")), 6).alias("weight"),
    )
    # A document has no more postings than tokens.
    return top_k(weighed, ["doc_id"], [F.col("weight").desc(), F.col("term")], k, rows=total["n_tokens"])


def doc_profile(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, n_words, n_lines, symbol_ratio, uniq_line_ratio``; map-only."""
    return docs.select(
        "doc_id",
        F.length(body("text")).cast("long").alias("n_chars"),
        F.size(tokens("text")).cast("long").alias("n_words"),
        F.size(lines("text")).cast("long").alias("n_lines"),
        symbol_ratio("text").alias("symbol_ratio"),
        F.when(
            F.length(body("text")) > 0,
            F.round(F.size(F.array_distinct(lines("text"))) / F.size(lines("text")), 6),
        ).alias("uniq_line_ratio"),
    )
