"""Plans, bounds and the paths that only large inputs take, with the limits lowered."""

from __future__ import annotations

import io
import random
from contextlib import redirect_stdout

import numpy as np
import pytest
from docloom.operators import actions, classify, conversations, index, search, sensitive
from docloom.plans import shapes, vectors
from docloom.queries import registered
from docloom.sources.tables import read_postings, read_table, write_postings
from docloom.streaming import routing
from pyspark.sql import functions as F
from test_shapes import brute_bm25

FOLDER = "/root/testdata/sf0.001"


def plan(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def corpus(spark, n=300):
    rng = random.Random(2)
    rows = [(i, " ".join(["the"] * rng.randrange(1, 4) + [f"w{rng.randrange(60)}" for _ in range(rng.randrange(3, 15))]), "en" if i % 17 else "fr", f"s{i % 3}") for i in range(n)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")


def test_metadata_is_met_before_ranking(spark):
    """The allowed documents all rank beyond the first hundred."""
    rows = [(i, "rare rare rare word", "en") for i in range(150)] + [(200 + i, f"rare{' filler' * (5 + i)}", "fr") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    postings = index.build_postings(docs, lengths=True)
    queries = spark.createDataFrame([(1, "rare"), (1, "word"), (2, "missing")], "qid int, term string")
    everything = search.bm25_search(postings, queries, 1000).collect()
    allowed = [r for r in everything if r.doc_id >= 200]
    assert min(r["rank"] for r in allowed) > 100
    got = search.metadata_search(docs, k=10, lang="fr", postings=postings, queries=queries).collect()
    assert [(r.doc_id, r.score, r["rank"]) for r in sorted(got, key=lambda r: r["rank"])] == [
        (r.doc_id, r.score, i + 1) for i, r in enumerate(sorted(allowed, key=lambda r: r["rank"])[:10])
    ]
    none = search.metadata_search(docs, k=10, lang="xx", postings=postings, queries=queries)
    assert none.columns == ["qid", "doc_id", "score", "rank"] and none.count() == 0


@pytest.mark.parametrize("few", [50_000, 0])
def test_restricted_search_is_exact(spark, few, monkeypatch):
    monkeypatch.setattr(shapes, "HEAVY_KEYS", 5)
    docs = corpus(spark)
    rng = random.Random(3)
    queries = [(q, t, 1.0) for q in range(12) for t in ["the", *rng.sample([f"w{i}" for i in range(60)], 4)]]
    asked = spark.createDataFrame(queries, "qid int, term string, weight double")
    every = {(q, d): s for q, d, s, _ in brute_bm25(docs, queries, 10**6)}
    may = docs.where("source = 's1'").select("doc_id")
    ids = {r.doc_id for r in may.collect()}
    got = search.bm25_search(index.build_postings(docs, True), asked, 3, few=few, allowed=may).collect()
    want = []
    for q in range(12):
        best = sorted(((-s, d) for (p, d), s in every.items() if p == q and d in ids))[:3]
        want += [(q, d, i + 1) for i, (_, d) in enumerate(best)]
    assert sorted((r.qid, r.doc_id, r["rank"]) for r in got) == sorted(want)


def test_many_long_queries(spark, monkeypatch):
    """500 queries of 500 terms, of which the corpus has some, through the path of large sets."""
    monkeypatch.setattr(shapes, "HEAVY_KEYS", 20)
    monkeypatch.setattr(shapes, "BROADCAST_BYTES", 500)
    docs = corpus(spark, 120)
    postings = index.build_postings(docs, True)
    rng = random.Random(4)
    words = ["the"] + [f"w{i}" for i in range(60)] + [f"no{i}" for i in range(2_000)]
    queries = [(q, t, float(rng.choice([1, 2]))) for q in range(500) for t in rng.sample(words, 500)]
    asked = spark.createDataFrame(queries, "qid int, term string, weight double").repartition(8)
    got = sorted((r[0], r[1], r[2], r[3]) for r in search.bm25_search(postings, asked, 3, few=0).collect())
    known = [x for x in queries if not x[1].startswith("no")]
    want = brute_bm25(docs, known, 3)
    assert [(g[0], g[1], g[3]) for g in got] == [(w[0], w[1], w[3]) for w in want]


def test_wide_rows_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(shapes, "BROADCAST_BYTES", 1000)
    left = spark.range(100).select((F.col("id") % 10).alias("k"), "id")
    right = spark.range(10).select(F.col("id").alias("k"), F.lit(10).alias("n"), F.repeat(F.lit("x"), 1000).alias("wide"))
    joined = shapes.keyed_join(left, right, "k", "n")
    assert joined.count() == 100
    assert not shapes.is_small(right, 100, 1000) and shapes.is_small(right, 100, 100_000) and not shapes.is_small(right, 9, 100_000)


def test_every_context_term_is_searched(spark):
    docs = corpus(spark)
    turns = spark.createDataFrame([(1, 0, "user", "w1 the " + " ".join(f"w{i}" for i in range(40))), (1, 1, "assistant", "w50"), (1, 2, "user", "w2 unseen")], "conv_id bigint, turn bigint, role string, text string")
    postings = index.build_postings(docs, True)
    got = {(r.turn, r.term): r.weight for r in conversations.context_query_terms(turns, postings).collect()}
    first = {"the", *(f"w{i}" for i in range(40))}
    assert got == {(0, t): 1.0 for t in first} | {(2, t): 0.5 + (t == "w2") for t in first}
    fewer = conversations.context_query_terms(turns, postings, max_terms=3, max_df_ratio=0.9).collect()
    assert len(fewer) == 6 and all(r.term != "the" for r in fewer)


@pytest.mark.parametrize("score_bytes", [1 << 20, 300])
def test_nearest_vectors_in_blocks(spark, monkeypatch, score_bytes):
    random_ = np.random.default_rng(8)
    left, right = random_.normal(size=(150, 6)).round(1), random_.normal(size=(40, 6)).round(1)
    best = vectors._Best(list(range(40)), list(right), 5)
    monkeypatch.setattr(vectors, "SCORE_BYTES", score_bytes)
    best.add(np.arange(150), left)
    unit = lambda m: m / np.linalg.norm(m, axis=1)[:, None]
    cosines = np.round(unit(right) @ unit(left).T, 6)
    want = [(q, int(i)) for q in range(40) for i in np.lexsort((np.arange(150), -cosines[q]))[:5]]
    assert list(zip(best.frame()["qid"], best.frame()["vec_id"], strict=True)) == want
    frames = [
        spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], f"{name} bigint, embedding array<double>")
        for name, m in (("vec_id", left), ("qid", right))
    ]
    got = search.vector_search(*frames, 5, few=0).collect()
    assert sorted((r.qid, r["rank"], r.vec_id) for r in got) == [(q, i % 5 + 1, v) for i, (q, v) in enumerate(want)]


def test_row_wise_operators_have_no_exchange(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for df in (
        index.build_postings(docs),
        index.doc_profile(docs),
        sensitive.find_sensitive_spans(docs),
        sensitive.sensitivity_label(docs),
        sensitive.mask_sensitive(docs, "text"),
        classify.classify_rules(docs),
        actions.propose_moves(classify.classify_rules(docs, carry=["source"])),
    ):
        assert "Exchange" not in plan(df)


def test_documents_are_not_joined_to_themselves(spark):
    audit = plan(registered()["egress_audit"](spark, FOLDER))
    assert audit.count("documents.parquet") == 1 or audit.count("Scan parquet") == 2  # documents and labels
    assert "SortMergeJoin" not in plan(registered()["propose_moves"](spark, FOLDER))


def test_labels_come_before_the_tokeniser(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    text = plan(index.build_postings(docs.join(labels.select("doc_id"), "doc_id", "left_semi")))
    tree = text[: text.index("\n\n")]
    assert tree.index("Generate") < tree.index("Join") < tree.index("Scan parquet")


def test_terms_reach_the_scan_of_a_written_index(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    path = str(tmp_path / "index")
    write_postings(index.build_postings(docs, lengths=True), path, partitions=4)
    postings = read_postings(spark, path)
    assert "EqualTo(term,the)" in plan(search.boolean_search(postings, all=["the"]))
    assert sorted(map(tuple, postings.collect())) == sorted(map(tuple, index.build_postings(docs, lengths=True).collect()))
    # Files hold ranges of terms: only neighbours share one.
    ranges = sorted(
        tuple(r)
        for r in postings.groupBy(F.input_file_name().alias("f")).agg(F.min("term").alias("a"), F.max("term").alias("b")).select("a", "b").collect()
    )
    assert len(ranges) == 4 and all(x[1] <= y[0] for x, y in zip(ranges, ranges[1:], strict=False))


def test_stream_in_batches_with_a_restart(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    confirmations = labels.select("doc_id", (F.col("toxic") == 0).alias("approved"))
    source, out, offsets = (str(tmp_path / n) for n in ("in", "out", "offsets"))

    def run():
        stream = routing.document_stream(spark, source, docs.schema, files_per_batch=1)
        query = routing.start_routing(routing.route_external_stream(stream, confirmations), out, offsets)
        query.awaitTermination()
        return query

    (tmp_path / "in").mkdir()
    run()
    decisions = spark.read.schema("doc_id bigint, level string, decision string")
    assert decisions.parquet(out).count() == 0
    docs.where("doc_id < 100").repartition(3).write.mode("append").parquet(source)
    assert len([p for p in run().recentProgress if p["numInputRows"]]) == 3
    assert decisions.parquet(out).count() == docs.where("doc_id < 100").count()
    docs.where("doc_id >= 100").repartition(2).write.mode("append").parquet(source)
    run()
    run()
    want = sensitive.route_external(docs, confirmations).collect()
    assert sorted(map(tuple, decisions.parquet(out).collect())) == sorted(map(tuple, want))


def test_a_small_scan_is_dealt_out(spark):
    whole = read_table(spark, FOLDER, "documents")
    spread = read_table(spark, FOLDER, "documents", spread=True)
    assert spread.rdd.getNumPartitions() >= whole.rdd.getNumPartitions()
    assert spread.count() == whole.count()
