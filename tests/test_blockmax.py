"""Searches in blocks that are skipped by their bounds, doc-values beside postings, and plans."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_scale_paths import brute_bm25, corpus

from docloom import queries as catalogue
from docloom.operators import actions, classify, index, search
from docloom.plans import balls, blockmax
from docloom.plans.blockmax import Queries, _whole_documents


def ranked(score, doc, k):
    order = sorted((-round(s, 6), d) for s, d in zip(score, doc, strict=True) if s > 0)
    return order[:k]


@pytest.mark.parametrize("cells", [1 << 20, 300])
def test_skipping_loses_nothing(monkeypatch, cells):
    monkeypatch.setattr(blockmax, "CELLS", cells)
    rng = np.random.default_rng(2)
    n_docs, n_terms, n_queries = 400, 60, 30
    gains = np.where(rng.random((n_terms, n_docs)) < 0.2, rng.random((n_terms, n_docs)).round(1), 0)
    weights = np.where(rng.random((n_queries, n_terms)) < 0.3, rng.integers(1, 4, (n_queries, n_terms)), 0).astype(float)
    q, t = np.nonzero(weights)
    queries = Queries(q, t, weights[q, t], n_queries, n_terms, 5)
    docs = rng.permutation(n_docs)
    for some in np.array_split(np.arange(n_docs), 7):
        terms, rows = np.nonzero(gains[:, some])
        queries.add(docs[some], terms, rows, gains[terms, some[rows]])
    for i in range(n_queries):
        want = ranked(weights[i] @ gains, docs.tolist(), 5)
        found = ranked(queries.score[i], queries.doc[i].tolist(), 5)
        assert found == want


def test_blocks_of_frequent_terms_are_skipped():
    """A term that every document has is in all blocks; where it is all there is, blocks are skipped."""
    rng = np.random.default_rng(3)
    n_docs = 2048
    gains = np.zeros((12, n_docs))
    gains[0] = 0.5 + 0.1 * rng.random(n_docs)
    gains[1:, :64] = 2.0
    weights = np.zeros((9, 12))
    weights[:, 0] = 0.01
    weights[:, 1:] = rng.random((9, 11)) + 0.1
    q, t = np.nonzero(weights)
    queries = Queries(q, t, weights[q, t], 9, 12, 5)
    terms, rows = np.nonzero(gains)
    queries.add(np.arange(n_docs), terms, rows, gains[terms, rows])
    assert queries.met + queries.skipped == 9 * n_docs // blockmax.BLOCK
    assert queries.met <= 9 * 2
    for i in range(9):
        assert ranked(queries.score[i], queries.doc[i].tolist(), 5) == ranked(weights[i] @ gains, range(n_docs), 5)


@pytest.mark.parametrize("share", [0, 4, 1 << 40])
@pytest.mark.parametrize("cells", [1 << 20, 2000])
def test_common_and_rare_terms(monkeypatch, share, cells):
    """Whatever is met as a matrix, scores are the same; a posting given twice counts once."""
    monkeypatch.setattr(blockmax, "SHARE", share)
    monkeypatch.setattr(blockmax, "CELLS", cells)
    rng = np.random.default_rng(5)
    n_docs, n_terms, n_queries = 200, 90, 25
    often = np.where(np.arange(n_terms) < 10, 0.8, 0.02)
    gains = np.where(rng.random((n_docs, n_terms)) < often, rng.random((n_docs, n_terms)).round(1), 0).T
    weights = np.where(rng.random((n_queries, n_terms)) < often, 1.5, 0)
    q, t = np.nonzero(weights)
    queries = Queries(q, t, weights[q, t], n_queries, n_terms, 4)
    terms, rows = (np.tile(x, 2) for x in np.nonzero(gains))
    queries.add(np.arange(n_docs), terms, rows, gains[terms, rows])
    for i in range(n_queries):
        assert ranked(queries.score[i], queries.doc[i].tolist(), 4) == ranked(weights[i] @ gains, range(n_docs), 4)


def test_long_documents_are_taken_together():
    """Documents with many words of their own are not met a few at a time by all queries."""
    n_docs, n_terms = 300, 400
    terms = [f"{d}-{t}" for d in range(n_docs) for t in range(n_terms)]
    batch = pa.record_batch([pa.array(np.repeat(np.arange(n_docs), n_terms)), pa.array(terms), pa.array(np.ones(len(terms)))], ["doc_id", "term", "gain"])
    slices = list(_whole_documents(iter([batch]), {t: i for i, t in enumerate(terms)}))
    assert [len(docs) for docs, *_ in slices] == [n_docs]


def test_copies_of_one_document(spark):
    """Ties between many blocks go to the smallest ids."""
    docs = spark.createDataFrame([(i, "w1 w2 the", "s0") for i in range(3000)], "doc_id bigint, text string, source string")
    asked = spark.createDataFrame([(7, "w1", 1.0), (7, "the", 0.5), (8, "none", 1.0)], "qid int, term string, weight double")
    got = search.bm25_search(index.build_postings(docs.repartition(6), True), asked, 4, few=0).collect()
    assert [(r.qid, r.doc_id, r["rank"]) for r in sorted(got, key=lambda r: r["rank"])] == [(7, i, i + 1) for i in range(4)]


def test_queries_in_several_chunks(spark, monkeypatch):
    monkeypatch.setattr(blockmax, "CHUNK_BYTES", 600)
    docs = corpus(spark, 100)
    rng = random.Random(9)
    queries = [(q, t, 1.0) for q in range(40) for t in ["the", *rng.sample([f"w{i}" for i in range(60)], 5)]]
    asked = spark.createDataFrame(queries, "qid int, term string, weight double")
    got = sorted((r[0], r[1], r[3]) for r in search.bm25_search(index.build_postings(docs, True), asked, 3, few=0).collect())
    assert got == [(w[0], w[1], w[3]) for w in brute_bm25(docs, queries, 3)]


@pytest.mark.parametrize("chunk_bytes", [600, 48 << 20])
def test_some_documents_are_searched_before_the_others(spark, monkeypatch, chunk_bytes):
    """In two rounds, in groups and with numbers for terms: the same hits."""
    monkeypatch.setattr(blockmax, "FIRST_ROWS", 0)
    monkeypatch.setattr(blockmax, "CHUNK_BYTES", chunk_bytes)
    monkeypatch.setattr(blockmax, "DOCS", 16)
    docs = corpus(spark, 150)
    rng = random.Random(10)
    queries = [(q, t, 1.0 + q % 3) for q in range(30) for t in ["the", "of", *rng.sample([f"w{i}" for i in range(60)], 4)]]
    asked = spark.createDataFrame(queries, "qid int, term string, weight double")
    wanted = [(w[0], w[1], w[3]) for w in brute_bm25(docs, queries, 3)]
    for terms in (500_000, 0):
        monkeypatch.setattr(search, "FEW_TERMS", terms)
        got = search.bm25_search(index.build_postings(docs, True), asked, 3, few=0).collect()
        assert sorted((r[0], r[1], r[3]) for r in got) == wanted


def test_a_known_score_spares_blocks():
    """Documents that cannot reach what the first ones gave are not multiplied, nor lost where they can."""
    rng = np.random.default_rng(6)
    gains = rng.random((20, 1024)) * np.where(np.arange(1024) % 256 < 8, 2.0, 0.9)
    weights = rng.random((10, 20)) + 0.1
    q, t = np.nonzero(weights)
    queries = Queries(q, t, weights[q, t], 10, 20, 5)
    first, others = np.arange(0, 1024, 2), np.arange(1, 1024, 2)
    terms, rows = np.nonzero(gains[:, first])
    queries.add(first, terms, rows, gains[terms, first[rows]])
    early, met = queries.score.copy(), queries.met
    queries.begin(early[:, -1])
    terms, rows = np.nonzero(gains[:, others])
    queries.add(others, terms, rows, gains[terms, others[rows]])
    assert queries.met < met / 2
    for i in range(10):
        found = [(s, d) for s, d in zip(early[i], ranked(weights[i] @ gains[:, first], first.tolist(), 5), strict=True)]
        both = [(-d[0], d[1]) for _, d in found] + list(zip(queries.score[i], queries.doc[i].tolist(), strict=True))
        assert ranked(*zip(*both, strict=True), 5) == ranked(weights[i] @ gains, range(1024), 5)


def test_groups_keep_all_postings():
    """Alike documents stand together and every posting is there once."""
    rng = np.random.default_rng(7)
    kind = rng.integers(0, 2, 900)
    held = [np.unique(rng.integers(0, 40, 12)) + 40 * k for k in kind]
    slices = []
    for some in np.array_split(np.arange(900), 9):
        rows = np.repeat(np.arange(len(some)), [len(held[d]) for d in some])
        terms = np.concatenate([held[d] for d in some])
        slices.append((some, terms, rows, terms + 1000.0 * some[rows]))
    groups = blockmax.Groups(np.repeat(np.arange(60), 10), np.concatenate([rng.permutation(40)[:10] + 40 * (i % 2) for i in range(60)]), 60, 80)
    dealt = list(groups.alike(iter(slices)))
    assert max(len(docs) for docs, *_ in dealt) <= blockmax.DOCS
    got = sorted((docs[r], t, g) for docs, terms, rows, gains in dealt for t, r, g in zip(terms, rows, gains, strict=True))
    assert got == sorted((d, t, t + 1000.0 * d) for d in range(900) for t in held[d])
    order = np.concatenate([kind[docs] for docs, *_ in dealt])
    assert (order[1:] != order[:-1]).sum() < blockmax.GROUPS


def test_postings_of_many_queries_meet_few_terms_in_the_scan(spark, monkeypatch, tmp_path):
    monkeypatch.setattr("docloom.plans.shapes.HEAVY_KEYS", 3)
    docs = corpus(spark)
    index.build_postings(docs, True).write.parquet(str(tmp_path / "index"))
    asked = spark.createDataFrame([(q, f"w{t}", 1.0) for q in range(9) for t in range(q, q + 8)], "qid int, term string, weight double")
    seen, original = {}, search.written
    monkeypatch.setattr(search, "written", lambda df, name: seen.setdefault(name, df._jdf.queryExecution().executedPlan().toString()) and original(df, name))
    search.bm25_search(spark.read.parquet(str(tmp_path / "index")), asked, 3, few=0)
    assert "SortMergeJoin" not in seen["query-postings"] and "hashpartitioning(term" not in seen["query-postings"]


@pytest.mark.parametrize("few", [50_000, 0])
def test_predicates_beside_postings(spark, few):
    docs = corpus(spark)
    queries = [(q, t, 1.0) for q in range(8) for t in ("the", f"w{q}", f"w{q + 9}")]
    asked = spark.createDataFrame(queries, "qid int, term string, weight double")
    postings = index.build_postings(docs, True, carry=["source"])
    assert postings.columns == ["term", "doc_id", "tf", "dl", "source"]
    mine = search.bm25_search(postings, asked, 3, few=few, where=F.col("source") == "s1").collect()
    joined = search.bm25_search(index.build_postings(docs, True), asked, 3, few=few, allowed=docs.where("source = 's1'")).collect()
    assert sorted(mine) == sorted(joined) != []
    by_search = search.metadata_search(None, k=3, space="s1", postings=postings, queries=asked).collect()
    assert sorted(by_search) == sorted(joined)
    nothing = search.metadata_search(None, k=3, space="none such", postings=postings, queries=asked)
    assert nothing.count() == 0


@pytest.mark.parametrize("odd", ["", "weights", "twice"])
def test_few_queries_that_share_many_postings_meet_in_blocks(spark, monkeypatch, odd):
    """A weight of 0, a query without an id or a document that comes twice takes no block."""
    docs = corpus(spark, 120).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source")
    docs = docs.unionByName(docs.where("doc_id % 7 = 0")) if odd == "twice" else docs
    queries = [(q, t, 1.0 + q % 2) for q in range(6) for t in ("the", "of", *(f"w{q + i}" for i in (0, 3, 9)))]
    asked = spark.createDataFrame(queries + [(None, "w1", 1.0), (9, "w2", 0.0)] * (odd == "weights"), "qid int, term string, weight double")
    blocks, original = [], search.best_in_blocks
    monkeypatch.setattr(search, "best_in_blocks", lambda *a, **b: blocks.append(b) or original(*a, **b))
    monkeypatch.setattr(search, "PAIRS", 1)
    postings = index.build_postings(docs, True, carry=["source"])
    found = search.bm25_search(postings, asked, 4, where=F.col("source") == "s1").collect()
    assert len(blocks) == (not odd)
    if not odd:
        held, total = postings.collect(), index.corpus_totals(postings=postings).first()
        df, n = Counter(p.term for p in held), total["n_docs"]
        want = []
        for q in range(6):
            weight, score = {t: w for i, t, w in queries if i == q}, Counter()
            for p in held:
                if p.source == "s1" and p.term in weight:
                    idf = math.log(1 + (n - df[p.term] + 0.5) / (df[p.term] + 0.5))
                    score[p.doc_id] += weight[p.term] * idf * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * p.dl * n / total["n_tokens"]))
            best = sorted(score, key=lambda d: (-round(score[d], 6), d))[:4]
            want += [(q, d, pytest.approx(score[d], abs=2e-6), i + 1) for i, d in enumerate(best)]
        assert sorted((r.qid, r.doc_id, r.score, r["rank"]) for r in found) == sorted(want, key=lambda w: w[:2])


def test_rules_of_metadata_search_run_once(spark, monkeypatch):
    """The postings that the sink samples and sorts come from written classes."""
    seen, original = [], catalogue.write_postings
    monkeypatch.setattr(catalogue, "write_postings", lambda df, *a, **b: seen.append(df) or original(df, *a, **b))
    catalogue.registered()["metadata_search"](spark, "/root/testdata/sf0.001")
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "licensed under" not in plan


def test_postings_of_odd_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " - "), (4, "b"), (5, "B a b, a b")], "doc_id long, text string")
    got = sorted(tuple(r) for r in index.build_postings(docs, True).collect())
    assert got == [("a", 5, 2, 5), ("b", 4, 1, 1), ("b", 5, 3, 5)]


def test_predicates_need_no_shuffle_of_postings(spark, tmp_path):
    """What is read of the postings is asked terms with a flag: no join by document anywhere."""
    docs = corpus(spark).withColumn("lang", F.lit("en"))
    index.build_postings(docs, True, carry=["source"]).write.parquet(str(tmp_path / "index"))
    postings = spark.read.parquet(str(tmp_path / "index"))
    asked = spark.createDataFrame([(1, "w1")], "qid int, term string")
    seen = []
    original = search.written

    def spy(df, name):
        seen.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return original(df, name)

    search.written, kept = spy, search.written
    try:
        search.metadata_search(None, k=3, space="s1", postings=postings, queries=asked)
    finally:
        search.written = kept
    plan = dict(seen)["query-postings"]
    assert "SortMergeJoin" not in plan and "hashpartitioning(doc_id" not in plan


def test_class_is_evaluated_once(spark):
    docs = corpus(spark).withColumn("text", F.concat("text", F.lit(" call +1 (555) 555-1234")))
    moves = actions.propose_moves(classify.classify_rules(docs, carry=["source"]))
    plan = moves._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("released under") == 1
    assert moves.count() == docs.count()


@pytest.mark.parametrize("few", [50_000, 0])
def test_phrases_by_position(spark, few):
    """Equal to containment of the tokens for repeated words and phrases over line ends."""
    rng = random.Random(12)
    words = ["a", "b", "c", "d"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 14))) for _ in range(250)]
    texts += ["A b\nc. d", "a-b-c", None, "", "...", "a a a a", "the end\nof it", "d " * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    asked = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 5))) for _ in range(60)]
    asked += ["a a", "a a a", "a a a a", "end of", "b, c!", "unseen", "a unseen", "", None, "d " * 299, "d " * 301]
    phrases = spark.createDataFrame(list(enumerate(asked)), "item_id long, text string")
    plain = lambda t: " " + " ".join("".join(ch if ch.isalnum() else " " for ch in (t or "").lower()).split()) + " "
    want = sorted((d, i) for d, t in enumerate(texts) for i, p in enumerate(asked) if plain(p).strip() and plain(p) in plain(t))
    found = search.positional_search(index.build_positions(docs), phrases, few)
    assert sorted((r.doc_id, r.item_id) for r in found.collect()) == want
    assert sorted((r.doc_id, r.item_id) for r in search.phrase_search(docs, phrases).collect()) == want


def test_positions_are_in_order(spark):
    rows = index.build_positions(spark.createDataFrame([(1, "b a b. A"), (2, None), (3, "")], "doc_id long, text string")).collect()
    assert sorted((r.term, r.doc_id, r["at"]) for r in rows) == [("a", 1, [1, 3]), ("b", 1, [0, 2])]


@pytest.mark.parametrize("cell", [4 << 20, 2000])
def test_vectors_in_balls(spark, monkeypatch, cell):
    """Equal to all cosines; of clustered vectors most balls are not met."""
    monkeypatch.setattr(balls, "CELL_BYTES", cell)
    rng = np.random.default_rng(4)
    middles = rng.normal(size=(12, 8))
    data = (middles[rng.integers(0, 12, 600)] + 0.05 * rng.normal(size=(600, 8))).round(2)
    asked = (middles[rng.integers(0, 12, 50)] + 0.05 * rng.normal(size=(50, 8))).round(2)
    data[100:110] = data[100]
    rows = [(i, v.tolist()) for i, v in enumerate(data)] + [(900, [0.0] * 8), (901, [1.0, 2.0]), (902, None), (903, [])]
    queries = [(i, v.tolist()) for i, v in enumerate(asked)] + [(90, [0.0] * 8), (91, [2.0, 1.0]), (92, [1.0] * 5), (93, None)]
    frames = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(4), spark.createDataFrame(queries, "qid bigint, embedding array<double>")
    got = search.vector_search(*frames, 5, few=0).collect()
    unit = lambda m: m / np.linalg.norm(m, axis=1)[:, None]
    cosines = np.round(unit(asked) @ unit(data).T, 6)
    want = [(q, i, int(v)) for q in range(50) for i, v in enumerate(np.lexsort((np.arange(600), -cosines[q]))[:5], 1)] + [(91, 1, 901)]
    assert sorted((r.qid, r["rank"], r.vec_id) for r in got) == want
    _, met = balls.nearest_in_balls(*frames, 5)
    assert met.count() < 0.3 * 50 * balls.BALLS


def test_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    asked = spark.createDataFrame([(1, [1.0])], "qid bigint, embedding array<float>")
    assert search.vector_search(none, asked, 5, few=-1).count() == 0
    some = spark.createDataFrame([(1, [1.0])], "vec_id bigint, embedding array<float>")
    assert search.vector_search(some, asked.limit(0), 5, few=-1).count() == 0
