"""Search: boolean, BM25, metadata, phrases, vectors, conversations, facets.

Operators taking a set of queries look at its size first. A small set is taken to every task, so
the documents are filtered where they are read. A larger set is joined by shuffle, with hot keys
cut up. The looking runs a job on the queries alone.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import normalised, tokens
from docloom.operators.conversations import context_query_terms
from docloom.operators.index import corpus_totals, term_stats
from docloom.plans.balls import nearest_in_balls
from docloom.plans.blockmax import best_in_blocks, dealt
from docloom.plans.shapes import BROADCAST_BYTES, few_rows, grid_join, is_small, keyed_join, top_k
from docloom.plans.vectors import nearest_in_partitions
from docloom.sources.tables import written

# Query sets up to this many rows, and this many bytes of text, go to every task.
FEW = 50_000
FEW_BYTES = 8 << 20
# Asked terms up to this many, and BROADCAST_BYTES of them, go to every task, too.
FEW_TERMS = 500_000
FEW_VECTORS = 4096
FEW_VECTOR_BYTES = 64 << 20
# A query's first terms are tried until they have this many documents for each wanted hit.
SEEDS = 4
# Pairs of a query's term and a posting from which on few queries meet the postings in blocks, too.
PAIRS = 1_000_000
# Scores nearer than this may round alike, so nothing is left out for less.
SLACK = 2e-6


def boolean_search(
    postings: DataFrame,
    all: Sequence[str] = (),
    any: Sequence[str] = (),
    none: Sequence[str] = (),
) -> DataFrame:
    """``doc_id`` of documents with every ``all`` term, an ``any`` term if given, no ``none`` term.

    One aggregation answers all three conditions. On a written index the terms reach the scan as
    a filter; postings made on the fly are filtered once they are made.
    """
    every, some, never = set(all), set(any), set(none)
    wanted = sorted(every | some | never)
    if not (every or some):
        return postings.select("doc_id").where(F.lit(False))

    def held(terms: set[str]) -> Column:
        return F.sum(F.when(F.col("term").isin(sorted(terms)), 1).otherwise(0)) if terms else F.lit(0)

    return (
        postings.where(F.col("term").isin(wanted))
        .groupBy("doc_id")
        .agg(held(every).alias("_all"), held(some).alias("_any"), held(never).alias("_none"))
        .where(
            (F.col("_all") == len(every)) & (F.col("_any") >= (1 if some else 0)) & (F.col("_none") == 0)
        )
        .select("doc_id")
    )


def _with_length(hits: DataFrame, postings: DataFrame) -> DataFrame:
    """Hits with ``dl``; summed up only where the postings were built without it."""
    if "dl" in postings.columns:
        return hits
    return hits.join(postings.groupBy("doc_id").agg(F.sum("tf").alias("dl")), "doc_id")


def bm25_search(
    postings: DataFrame,
    queries: DataFrame,
    k: int = 10,
    k1: float = 1.2,
    b: float = 0.75,
    qid: str = "qid",
    totals: DataFrame | None = None,
    few: int = FEW,
    allowed: DataFrame | None = None,
    where: Column | None = None,
) -> DataFrame:
    """``qid, doc_id, score, rank`` for ``queries(qid, term[, weight])``, weights not negative.

    score = sum of weight * ln(1 + (N - df + 0.5) / (df + 0.5)) * tf (k1 + 1) / (tf + k1 (1 - b +
    b dl / avgdl)), rounded to 6; rank by score, then ``doc_id``. Postings built with lengths
    need no join for ``dl``. ``where``, a condition on columns that the postings carry, or
    ``allowed(doc_id)`` restricts the documents before they are ranked; df, N and the mean length
    stay those of all documents. The condition is met in the scan, ``allowed`` by a join.

    The result is exact, but a query is not paired with every document that shares a word with it:
    1. The k best documents by its most telling terms are scored in full. The k-th hit reaches at
       least the lowest of these scores.
    2. A document holding only terms that cannot sum up to that score is never looked at, which
       spares the frequent terms; the others are scored on their telling terms.
    3. Only those that can still reach the score are looked up in the frequent terms.
    So it goes for a set of queries of at most ``few`` rows and FEW_BYTES, which is broadcast. A
    larger one meets the postings in blocks that are skipped by their largest gains (see
    ``plans.blockmax``), and so does a small one that shares its terms with PAIRS postings or more:
    then looking up candidates costs more than scoring documents. The asked terms, their postings, the weighed terms and the candidates
    become scratch tables.
    """
    may = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    weight = F.col("weight").cast("double") if "weight" in queries.columns else F.lit(1.0)
    asked = written(
        queries.select(qid, "term", weight.alias("weight"))
        .groupBy(qid, "term")
        .agg(F.sum("weight").alias("weight")),
        "asked-terms",
    )
    small = is_small(asked, few, FEW_BYTES)
    wanted = asked.select("term").distinct()
    if small:
        kept = postings.join(F.broadcast(wanted), "term", "left_semi")
    else:
        # From here on a number stands for the term, a small one: a task's place among its terms is less than 2^33.
        numbers = written(wanted.where("term is not null").withColumn("_no", F.monotonically_increasing_id()), "asked-numbers")
        parts = (numbers.agg(F.max(F.shiftright("_no", 33)).alias("last")).first()["last"] or 0) + 1
        numbers = numbers.withColumn("_no", F.col("_no").bitwiseAND((1 << 33) - 1) * parts + F.shiftright("_no", 33))
        if is_small(numbers, FEW_TERMS, BROADCAST_BYTES):
            kept = postings.join(F.broadcast(numbers), "term")
        else:
            known = postings.groupBy("term").agg(F.count("*").alias("_rows")).join(numbers, "term", "left")
            kept = keyed_join(postings, known, "term", "_rows").where("_no is not null")
        kept = kept.withColumn("term", F.col("_no")).drop("_no")

    total = (corpus_totals(postings=postings) if totals is None else totals).first()
    n_docs, average = float(total["n_docs"]), total["n_tokens"] / max(total["n_docs"], 1)
    gain = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / average))
    met = _with_length(kept, postings).select("term", "doc_id", "dl", "tf", may.alias("_may"))
    if allowed is not None:
        mine = allowed.select("doc_id").distinct().withColumn("_may", F.lit(True))
        met = met.drop("_may").join(mine, "doc_id", "left").withColumn("_may", F.coalesce("_may", F.lit(False)))
    if not small:
        # As the blocks take them. Counts and lengths are less to shuffle than gains.
        met = dealt(met, postings.count())
    postings_asked = written(met.select("term", "doc_id", "dl", gain.alias("gain"), "_may"), "query-postings")
    found = postings_asked.where("_may").drop("_may")
    # df counts every document, what can be reached only those that may be hits.
    counts = postings_asked.groupBy("term").agg(
        F.count("*").alias("df"),
        F.count(F.when(F.col("_may"), 1)).alias("_hits"),
        F.max(F.when(F.col("_may"), F.col("gain"))).alias("_top_gain"),
        F.count(F.when(F.col("doc_id").isNull(), 1)).alias("_nameless"),
    )
    if small:
        rated = asked.join(counts, "term")
    else:
        named = counts.withColumnRenamed("term", "_no").join(numbers, "_no")
        used = asked.groupBy("term").agg(F.count("*").alias("_rows")).join(named, "term", "left")
        rated = keyed_join(asked, used, "term", "_rows").where("df is not null")
    idf = F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    if not small:
        heavy = rated.where("_hits > 0").select(qid, F.col("_no").alias("term"), (F.col("weight") * idf).alias("w"))
        heavy = written(heavy.where("w > 0"), "query-terms")
        parts = best_in_blocks(found, heavy, k, qid, laid_out=True).select(qid, "doc_id", F.round("part", 6).alias("score"))
        return top_k(parts, [qid], [F.col("score").desc(), F.col("doc_id")], k).select(qid, "doc_id", "score", "rank")

    rated = written(rated, "rated-terms")
    plain = F.coalesce(F.col("weight") > 0, F.lit(False)) & F.col(qid).isNotNull() & (F.col("_nameless") == 0)
    shared = rated.agg(F.sum("_hits").alias("pairs"), F.count(F.when(~plain, 1)).alias("odd")).first()
    # Blocks hold documents by number, weights above 0 and a posting for each document and term.
    numbered = dict(found.dtypes)["doc_id"] in ("int", "bigint")
    many = (shared["pairs"] or 0) >= PAIRS and not shared["odd"] and numbered
    if many and found.groupBy("doc_id", "term").count().where("count > 1").isEmpty():
        heavy = written(rated.where("_hits > 0").select(qid, "term", (F.col("weight") * idf).alias("w")), "query-terms")
        parts = best_in_blocks(found, heavy, k, qid, summed=True).select(qid, "doc_id", F.round("part", 6).alias("score"))
        return top_k(parts, [qid], [F.col("score").desc(), F.col("doc_id")], k).select(qid, "doc_id", "score", "rank")

    by_worth = Window.partitionBy(qid).orderBy(F.col("_worth").desc(), "term")
    before, onwards = by_worth.rowsBetween(Window.unboundedPreceding, -1), by_worth.rowsBetween(0, Window.unboundedFollowing)
    # _most: what a document can score by this term and the less telling ones.
    weighed = written(
        rated.where("_hits > 0")
        .select(qid, "term", "_hits", (F.col("weight") * idf).alias("w"), "_top_gain")
        .withColumn("_worth", F.col("w") * F.col("_top_gain"))
        .select(
            qid,
            "term",
            "w",
            F.coalesce(F.sum("_hits").over(before), F.lit(0)).alias("_docs_before"),
            F.sum("_worth").over(onwards).alias("_most"),
        ),
        "query-terms",
    )

    def meet(terms: DataFrame) -> DataFrame:
        return found.join(F.broadcast(terms), "term").groupBy(qid, "doc_id").agg(
            F.sum(F.col("w") * F.col("gain")).alias("part"), F.max("_need").alias("_need")
        )

    seeds = weighed.where(F.col("_docs_before") < SEEDS * k).select(qid, "term", "w", F.lit(0.0).alias("_need"))
    first = top_k(meet(seeds), [qid], [F.col("part").desc(), F.col("doc_id")], k)
    reach = (
        first.select(qid, "doc_id")
        .join(weighed.select(qid, "term", "w"), qid)
        .join(found, ["term", "doc_id"])
        .groupBy(qid, "doc_id")
        .agg(F.sum(F.col("w") * F.col("gain")).alias("_score"))
        .groupBy(qid)
        .agg(F.min("_score").alias("_lowest"), F.count("*").alias("_n"))
        .where(F.col("_n") == k)
        .select(qid, (F.col("_lowest") - SLACK).alias("_reach"))
    )
    spared = F.max(F.when(F.col("_spare"), F.col("_most"))).over(Window.partitionBy(qid))
    split = written(
        weighed.join(reach, qid, "left")
        .withColumn("_spare", F.coalesce(F.col("_most") < F.col("_reach"), F.lit(False)))
        .withColumn("_need", F.coalesce("_reach", F.lit(0.0)) - F.coalesce(spared, F.lit(0.0)))
        .select(qid, "term", "w", "_spare", "_need"),
        "query-split",
    )
    candidates = written(
        meet(split.where("not _spare").select(qid, "term", "w", "_need"))
        .where("part >= _need")
        .select(qid, "doc_id", "part"),
        "query-candidates",
    )
    others = split.where("_spare").select(qid, "term", "w")
    completed = candidates.join(F.broadcast(others), qid)
    looked_up = (
        completed.select(qid, "doc_id", "term", "w")
        .join(found, ["term", "doc_id"])
        .select(qid, "doc_id", (F.col("w") * F.col("gain")).alias("part"))
    )
    scored = (
        candidates.unionByName(looked_up)
        .groupBy(qid, "doc_id")
        .agg(F.round(F.sum("part"), 6).alias("score"))
    )
    return top_k(scored, [qid], [F.col("score").desc(), F.col("doc_id")], k).select(
        qid, "doc_id", "score", "rank"
    )


def _meets(lang: str | None, space: str | None, cls: str | None) -> Column:
    """The given predicates as one condition."""
    holds = [F.col(c) == F.lit(v) for c, v in (("lang", lang), ("source", space), ("cls", cls)) if v is not None]
    return reduce(and_, holds, F.lit(True))


def metadata_matches(
    docs: DataFrame, lang: str | None = None, space: str | None = None, cls: str | None = None
) -> DataFrame:
    """``doc_id`` of the documents that meet the given predicates, which reach the scan."""
    return docs.where(_meets(lang, space, cls)).select("doc_id")


def metadata_search(
    docs: DataFrame | None,
    scored: DataFrame | None = None,
    k: int = 10,
    lang: str | None = None,
    space: str | None = None,
    cls: str | None = None,
    postings: DataFrame | None = None,
    queries: DataFrame | None = None,
    totals: DataFrame | None = None,
) -> DataFrame:
    """``qid, doc_id, score, rank`` of the best documents among those that meet the predicates.

    Postings that carry the columns of the predicates (``build_postings(carry=...)``) need no
    ``docs``: the condition is met beside each posting, in the scan. Otherwise ``docs`` has the
    columns, ``cls`` too if asked for. Either ``postings`` and ``queries`` are given, which are
    searched with the predicates met first (see ``bm25_search``), so that nothing is cut before
    them, or ``scored(qid, doc_id, score)`` with every document that may be a hit.
    """
    if scored is None:
        if docs is None:
            return bm25_search(postings, queries, k, totals=totals, where=_meets(lang, space, cls))
        return bm25_search(postings, queries, k, totals=totals, allowed=metadata_matches(docs, lang, space, cls))
    matches = metadata_matches(docs, lang, space, cls)
    # A document may be a hit of very many queries, so they meet by how often it is one.
    flagged = matches.withColumn("_kept", F.lit(True))
    known = scored.groupBy("doc_id").agg(F.count("*").alias("_rows")).join(flagged, "doc_id", "left")
    allowed = keyed_join(scored.select("qid", "doc_id", "score"), known, "doc_id", "_rows").where("_kept")
    return top_k(
        allowed.drop("_kept"), ["qid"], [F.col("score").desc(), F.col("doc_id")], k
    ).select("qid", "doc_id", "score", "rank")


def phrase_search(docs: DataFrame, phrases: DataFrame, few: int = FEW) -> DataFrame:
    """``doc_id, item_id`` where the document holds the phrase, token by token.

    Only documents holding a phrase's rarest token are compared with it. A large set of phrases
    makes scratch tables on its way.
    """
    wanted = phrases.select(
        "item_id", normalised("text").alias("_phrase"), F.array_distinct(tokens("text")).alias("_tokens")
    ).where(F.size("_tokens") > 0)
    wanted = written(wanted, "phrases")
    needed = wanted.select("item_id", F.size("_tokens").alias("_n"), F.explode("_tokens").alias("term"))
    asked = needed.select("term").distinct()

    def rarest(rated: DataFrame) -> DataFrame:
        # A phrase with a token no document has is dropped by the count of its tokens.
        return (
            rated.groupBy("item_id", "_n")
            .agg(F.min(F.struct("df", "term")).alias("_rare"), F.count("*").alias("_seen"))
            .where("_seen = _n")
            .select("item_id", F.col("_rare.term").alias("term"))
        )

    def held(terms: DataFrame, *columns: str) -> DataFrame:
        """Distinct tokens of the documents, those among ``terms``."""
        spelled = docs.select("doc_id", *columns, F.explode(F.array_distinct(tokens("text"))).alias("term"))
        return spelled.join(F.broadcast(terms), "term")

    if is_small(wanted, few, FEW_BYTES):
        counts = held(asked).groupBy("term").agg(F.count("*").alias("df"))
        rare = written(rarest(needed.join(counts, "term")).join(wanted.select("item_id", "_phrase"), "item_id"), "rarest-terms")
        return (
            held(rare, "text")
            .where(F.contains(normalised("text"), F.col("_phrase")))
            .select("doc_id", "item_id")
        )

    # Each step is read several times by the next, so each is written. Of the documents' tokens
    # only those of phrases are: a semi-join that Spark's skew join splits at frequent tokens.
    spelled = docs.select("doc_id", F.explode(F.array_distinct(tokens("text"))).alias("term"))
    doc_terms = written(spelled.join(asked, "term", "left_semi"), "doc-terms")
    counts = doc_terms.groupBy("term").agg(F.count("*").alias("df"))
    used = needed.groupBy("term").agg(F.count("*").alias("_rows")).join(counts, "term", "left")
    rare = written(rarest(keyed_join(needed, used, "term", "_rows").where("df is not null")), "rarest-terms")
    pairs = written(grid_join(doc_terms, rare, "term").select("doc_id", "item_id"), "phrase-pairs")
    # A document or phrase in very many pairs is copied to slices of them, never broadcast.
    tried = written(grid_join(pairs, wanted.select("item_id", "_phrase"), "item_id"), "phrases-asked")
    # Only texts with a candidate are taken to the join.
    texts = docs.join(tried.select("doc_id").distinct(), "doc_id", "left_semi")
    return (
        grid_join(tried, texts.select("doc_id", normalised("text").alias("_text")), "doc_id")
        .where(F.contains("_text", "_phrase"))
        .select("doc_id", "item_id")
    )


def positional_search(positions: DataFrame, phrases: DataFrame, few: int = FEW) -> DataFrame:
    """``doc_id, item_id`` where the document holds the phrase, token by token, from ``build_positions``.

    No text is read. A phrase's rarest token says where it may start; each other token must then
    stand at its distance from one and the same start. A phrase with a token that no document has
    gives nothing, nor does one without tokens. ``item_id`` is unique.

    Phrases and postings asked become scratch tables. Of a large set of phrases, tokens and phrases
    that very many rows share are met in cells.
    """
    spelled = phrases.select("item_id", tokens("text").alias("_tokens")).select(
        "item_id", F.size("_tokens").alias("_n"), F.posexplode("_tokens").alias("_offset", "term")
    )
    needed = written(spelled, "phrase-tokens")
    small = is_small(needed, few, FEW_BYTES)
    asked = needed.select("term").distinct()
    found = written(positions.join(F.broadcast(asked) if small else asked, "term", "left_semi"), "phrase-postings")

    def meet(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
        return left.join(F.broadcast(right), key) if small else grid_join(left, right, key)

    counts = found.groupBy("term").agg(F.count("*").alias("df"))
    if small:
        rated = needed.join(counts, "term")
    else:
        used = needed.groupBy("term").agg(F.count("*").alias("_rows")).join(counts, "term", "left")
        rated = keyed_join(needed, used, "term", "_rows").where("df is not null")
    rare = (
        rated.groupBy("item_id", "_n")
        .agg(F.min(F.struct("df", "term", "_offset")).alias("_rare"), F.count("*").alias("_seen"))
        .where("_seen = _n")
        .select("item_id", "_n", F.col("_rare.term").alias("term"), F.col("_rare._offset").alias("_from"))
    )
    rare = written(rare, "rarest-terms")
    starts = F.filter(F.transform("at", lambda a: a - F.col("_from")), lambda s: s >= 0)
    begun = meet(found, rare, "term").select("doc_id", "item_id", "_n", "_from", starts.alias("_starts")).where(F.size("_starts") > 0)
    begun = written(begun, "phrase-starts")
    others = needed.select("item_id", "_offset", "term")
    # The rarest token's other places count like any token.
    tried = meet(begun.where("_n > 1"), others, "item_id").where("_offset <> _from")
    shifted = F.transform("at", lambda a: a - F.col("_offset"))
    kept = (
        tried.join(found, ["term", "doc_id"])
        .select("doc_id", "item_id", "_n", F.explode(F.array_intersect("_starts", shifted)).alias("_start"))
        .groupBy("doc_id", "item_id", "_n", "_start")
        .agg(F.count("*").alias("_held"))
        .where("_held = _n - 1")
    )
    single = begun.where("_n = 1")
    return kept.select("doc_id", "item_id").distinct().unionByName(single.select("doc_id", "item_id"))


def vector_search(
    embeddings: DataFrame, query_vecs: DataFrame, k: int = 10, few: int = FEW_VECTORS
) -> DataFrame:
    """``qid, vec_id, score, rank`` by exact cosine, rounded to 6, then ``vec_id``.

    ``embeddings`` is ``vec_id, embedding``, ``query_vecs`` is ``qid, embedding``. Each task
    multiplies its vectors with the queries and passes on its own best ``k`` per query, so pairs
    are never rows. More than ``few`` queries, or FEW_VECTOR_BYTES of them, stay a table and meet
    only the balls of vectors that may hold a near one (see ``plans.balls``). Zero vectors, and
    vectors of another length than the query, have no score. ``qid`` is unique.
    """
    queries = query_vecs.select("qid", F.col("embedding").cast("array<double>").alias("embedding"))
    rows = few_rows(queries, few) if is_small(queries, few, FEW_VECTOR_BYTES) else None
    if rows is None:
        best, _ = nearest_in_balls(embeddings, queries, k)
    else:
        best = nearest_in_partitions(embeddings, rows, k, query_vecs.schema["qid"].dataType.simpleString())
    return top_k(best, ["qid"], [F.col("score").desc(), F.col("vec_id")], k)


def contextual_search(
    turns: DataFrame,
    postings: DataFrame,
    k: int = 5,
    back: int = 2,
    max_terms: int | None = None,
    max_df_ratio: float | None = None,
    totals: DataFrame | None = None,
    few: int = FEW,
) -> DataFrame:
    """``conv_id, turn, doc_id, score, rank``: BM25 hits for the context of each user turn.

    Turns with equal terms and weights are one query, searched once. Writes the turns' terms as
    scratch tables; ``postings`` should be a written table with lengths.
    """
    totals = corpus_totals(postings=postings) if totals is None else totals
    terms = context_query_terms(
        turns, postings, back, max_terms, max_df_ratio, term_stats(postings, totals), totals
    )
    asked = written(
        terms.groupBy("conv_id", "turn")
        .agg(F.sort_array(F.collect_list(F.struct("term", "weight"))).alias("_terms"))
        .withColumn("qid", F.sha2(F.to_json("_terms"), 256)),
        "turn-queries",
    )
    distinct = asked.groupBy("qid").agg(F.any_value("_terms").alias("_terms"))
    hits = bm25_search(postings, distinct.select("qid", F.inline("_terms")), k, totals=totals, few=few)
    # A query may be that of very many turns, and has k hits.
    hits = written(hits, "query-hits")
    return grid_join(asked.select("conv_id", "turn", "qid"), hits, "qid").select(
        "conv_id", "turn", "doc_id", "score", "rank"
    )


def search_facets(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """``lang, source, n`` hit counts, by (lang, source), by lang and in all; ``'*'`` marks totals."""
    # Hits of a document are counted before they meet it: one may be hit very often.
    finest = (
        hits.groupBy("doc_id")
        .agg(F.count("*").alias("_hits"))
        .join(docs.select("doc_id", "lang", "source"), "doc_id")
        .groupBy("lang", "source")
        .agg(F.sum("_hits").alias("_n"))
    )
    return finest.rollup("lang", "source").agg(
        F.sum("_n").alias("n"),
        F.grouping("lang").alias("_all_langs"),
        F.grouping("source").alias("_all_sources"),
    ).select(
        F.when(F.col("_all_langs") == 1, "*").otherwise(F.col("lang")).alias("lang"),
        F.when(F.col("_all_sources") == 1, "*").otherwise(F.col("source")).alias("source"),
        "n",
    )
