"""Scanned text: put pages together, find gaps, clean lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import body, lines, symbol_ratio
from docloom.plans.shapes import block_of
from docloom.sources.tables import written

# Pages of one assembled row.
PART_PAGES = 65_536
# Bytes of the pages in one assembled row, but for its last page.
PART_BYTES = 64 << 20
# Page numbers checked together.
GAP_BLOCK = 4096


def _best_pages(pages: DataFrame, *carry: str) -> DataFrame:
    """``doc_id, carry, page_no, text``: of several rows for a page the longest text, then the smallest.

    A minimum is combined before the shuffle, so copies of one page don't meet in one task.
    """
    best = pages.groupBy("doc_id", *carry, "page_no").agg(
        F.min(F.struct((-F.length(body("text"))).alias("neg"), body("text").alias("text"))).alias("_best")
    )
    return best.select("doc_id", *carry, "page_no", F.col("_best.text").alias("text"))


def assemble_pages(pages: DataFrame, part_pages: int = PART_PAGES) -> DataFrame:
    """``doc_id, part, n_pages, text`` from ``doc_id, page_no, text``.

    Of several rows for a page the longest text counts, then the smallest. One row per document
    and stretch of ``part_pages`` page numbers, so no row grows without bound; ``part`` is
    ``page_no div part_pages``. ``n_pages`` counts the pages of the whole document.
    """
    cut = pages.withColumn("part", F.expr(f"cast(page_no div {part_pages} as bigint)"))
    parts = _best_pages(cut, "part").groupBy("doc_id", "part").agg(
        F.array_sort(F.collect_list(F.struct("page_no", "text"))).alias("_pages")
    )
    # Page numbers without texts: counted by part, then over the few parts of a document.
    numbers = cut.select("doc_id", "part", "page_no").distinct().groupBy("doc_id", "part").agg(F.count("*").alias("_n"))
    counts = numbers.select("doc_id", "part", F.sum("_n").over(Window.partitionBy("doc_id")).alias("n_pages"))
    return parts.join(counts, ["doc_id", "part"]).select(
        "doc_id", "part", "n_pages", F.array_join(F.col("_pages.text"), "\n").alias("text")
    )


def assemble_pages_by_size(pages: DataFrame, part_bytes: int = PART_BYTES, block: int = GAP_BLOCK) -> DataFrame:
    """``doc_id, part, first_page, n_pages, text``: like ``assemble_pages``, with parts bounded in bytes.

    A page belongs to the part that holds its first byte: ``part`` is the number of bytes in the
    document's pages before it, ``div part_bytes``. So a row has at most ``part_bytes`` and one
    page, pages of any size. ``n_pages`` counts the pages of the part. Pages with equal parts stay
    in the order of their numbers; joining a document's parts by line ends gives the document.

    Sizes are summed without texts: within blocks of page numbers, and over the sums of a
    document's blocks. The best pages become a scratch table, as they are read twice.
    """
    best = written(_best_pages(pages), "best-pages")
    sizes = best.select("doc_id", "page_no", block_of("page_no", block).alias("_block"), F.octet_length("text").cast("long").alias("_size"))
    blocks = sizes.groupBy("doc_id", "_block").agg(F.sum("_size").alias("_sum"))
    earlier = Window.partitionBy("doc_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("doc_id", "_block", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("doc_id", "_block").orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        sizes.withColumn("_inside", F.coalesce(F.sum("_size").over(inside), F.lit(0)))
        .join(blocks, ["doc_id", "_block"])
        .select("doc_id", "page_no", F.expr(f"(_before + _inside) div {part_bytes}").alias("part"))
    )
    parts = best.join(placed, ["doc_id", "page_no"]).groupBy("doc_id", "part").agg(
        F.array_sort(F.collect_list(F.struct("page_no", "text"))).alias("_pages")
    )
    return parts.select(
        "doc_id",
        "part",
        F.get("_pages", F.lit(0))["page_no"].alias("first_page"),
        F.size("_pages").cast("long").alias("n_pages"),
        F.array_join(F.col("_pages.text"), "\n").alias("text"),
    )


def missing_pages(pages: DataFrame, block: int = GAP_BLOCK) -> DataFrame:
    """``doc_id, page_no`` of the gaps between page 0 and the last page.

    Page numbers are compared block by block: a document of any length, or any number of rows of
    one document, meets in groups of at most ``block`` distinct numbers.
    """
    numbered = pages.select("doc_id", F.col("page_no").cast("long").alias("page_no")).where(
        "page_no >= 0"
    )
    seen = (
        numbered.withColumn("_block", block_of("page_no", block))
        .groupBy("doc_id", "_block")
        .agg(F.collect_set("page_no").alias("_seen"), F.max("page_no").alias("_max"))
    )
    blocks = (
        seen.groupBy("doc_id")
        .agg(F.max("_max").alias("_last"))
        .select(
            "doc_id",
            "_last",
            F.explode(F.sequence(F.lit(0).cast("long"), block_of("_last", block), F.lit(block).cast("long"))).alias("_block"),
        )
    )
    wanted = F.sequence(
        F.col("_block"), F.least(F.col("_block") + F.lit(block - 1), F.col("_last"))
    )
    gaps = F.array_except(wanted, F.coalesce("_seen", F.array().cast("array<bigint>")))
    return blocks.join(seen.drop("_max"), ["doc_id", "_block"], "left").select(
        "doc_id", F.explode(gaps).alias("page_no")
    )


def clean_ocr_text(docs: DataFrame, max_symbols: float = 0.5) -> DataFrame:
    """``doc_id, text, n_dropped``: no repeated non-blank line, no line made of symbols.

    A document's lines sit in its own row, so they are sorted, thinned and put back in order
    there; no text is shuffled.
    """
    numbered = F.transform(
        lines("text"),
        lambda line, i: F.struct(line.alias("line"), i.alias("at"), symbol_ratio(line).alias("ratio")),
    )
    by_line = docs.select("doc_id", F.sort_array(numbered).alias("_lines"))
    first = F.transform(
        "_lines",
        lambda entry, i: F.struct(
            entry["at"].alias("at"),
            entry["line"].alias("line"),
            (
                (F.coalesce(entry["ratio"], F.lit(0.0)) <= max_symbols)
                & (
                    (F.trim(entry["line"]) == "")
                    | (i == 0)
                    | (entry["line"] != F.get(F.col("_lines"), i - 1)["line"])
                )
            ).alias("keep"),
        ),
    )
    kept = F.array_sort(F.filter(first, lambda entry: entry["keep"]))
    return (
        by_line.select("doc_id", F.size("_lines").alias("_n"), kept.alias("_kept"))
        .select(
            "doc_id",
            F.array_join(F.transform("_kept", lambda entry: entry["line"]), "\n").alias("text"),
            (F.col("_n") - F.size("_kept")).cast("long").alias("n_dropped"),
        )
    )
