"""Plan shapes and the paths for large sides, against brute force on small fixtures."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom import queries
from docloom.operators import conversations, index, search
from docloom.plans import shapes


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(7)
    words = ["the", "of"] + [f"w{i}" for i in range(40)]
    weights = [60, 40] + [40 / (i + 1) for i in range(40)]
    rows = [
        (i, " ".join(rng.choices(words, weights, k=rng.randint(1, 60))), "en", "s", 0) for i in range(300)
    ]
    return spark.createDataFrame(
        rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"
    )


def test_top_k_beyond_the_group_limit(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("g"), F.col("id").alias("v"))
    got = shapes.top_k(df, ["g"], [F.col("v").desc()], 1500).collect()
    assert len(got) == 3000
    assert {r["rank"] for r in got if r["g"] == 1} == set(range(1, 1501))
    assert max(r["v"] for r in got if r["rank"] == 1) == 4999


def test_keyed_join_heavy_and_light(spark, monkeypatch):
    monkeypatch.setattr(shapes, "HEAVY_KEYS", 4)
    keys = ["hot"] * 50 + [f"k{i % 20}" for i in range(60)] + ["gone"] * 30
    left = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "key string, v int")
    right = spark.createDataFrame(
        [(k, n, k.upper()) for k, n in Counter(keys).items() if k != "gone"], "key string, n bigint, name string"
    )
    got = shapes.keyed_join(left, right, "key", "n").select("v", "name").collect()
    assert sorted(map(tuple, got)) == [(i, k.upper()) for i, k in enumerate(keys) if k != "gone"]


def test_grid_join(spark):
    a = [("x", i) for i in range(25)] + [("y", 1), ("z", 1)]
    b = [("x", i) for i in range(17)] + [("y", 5), ("y", 6), ("w", 1)]
    left, right = spark.createDataFrame(a, "k string, a int"), spark.createDataFrame(b, "k string, b int")
    got = shapes.grid_join(left, right, "k", cell=4).select("k", "a", "b").collect()
    assert sorted(map(tuple, got)) == sorted((k, i, j) for k, i in a for m, j in b if k == m)


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_preceding_over_blocks_and_gaps(spark, block):
    rng = random.Random(3)
    turns = {c: sorted(rng.sample(range(60), rng.randint(1, 25))) for c in range(6)}
    rows = [(c, t, "user", f"t{t}") for c, ts in turns.items() for t in ts]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {(r["conv_id"], r["turn"]): r["ctx"] for r in conversations.context_window(df, 3, block).collect()}
    want = {
        (c, t): "\n".join(f"user:t{x}" for x in ts[max(0, i - 3) : i])
        for c, ts in turns.items()
        for i, t in enumerate(ts)
    }
    assert got == want


def test_long_conversation_comes_in_parts(spark):
    df = spark.createDataFrame(
        [(1, t, "user" if t % 2 == 0 else "assistant", f"m{t}") for t in range(10)],
        "conv_id bigint, turn bigint, role string, text string",
    )
    got = sorted(conversations.conversation_threads(df, part_turns=4).collect())
    assert [r["part"] for r in got] == [0, 1, 2]
    assert {(r["n_turns"], r["first_role"], r["last_role"]) for r in got} == {(10, "user", "assistant")}
    said = "\n".join(r["transcript"] for r in got)
    assert said == "\n".join(f"{'user' if t % 2 == 0 else 'assistant'}:m{t}" for t in range(10))


def brute_bm25(docs, queries, k):
    texts = {r["doc_id"]: r["text"].split() for r in docs.collect()}
    n, avg = len(texts), sum(map(len, texts.values())) / len(texts)
    df = Counter(t for words in texts.values() for t in set(words))
    scores = defaultdict(dict)
    for q, term, weight in queries:
        for d, words in texts.items():
            tf = words.count(term)
            if tf:
                idf = math.log(1 + (n - df[term] + 0.5) / (df[term] + 0.5))
                gain = tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / avg))
                scores[q][d] = scores[q].get(d, 0) + weight * idf * gain
    out = []
    for q, per in scores.items():
        best = sorted(((round(s, 6), d) for d, s in per.items()), key=lambda x: (-x[0], x[1]))[:k]
        out += [(q, d, s, i + 1) for i, (s, d) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("few,lengths", [(50_000, True), (0, True), (50_000, False)])
def test_bm25_is_exact(spark, docs, few, lengths):
    rng = random.Random(11)
    queries = [
        (q, t, rng.choice([1.0, 0.5, 0.25]))
        for q in range(8)
        for t in ["the", "of", "missing"] + rng.sample([f"w{i}" for i in range(40)], q)
    ]
    asked = spark.createDataFrame(queries, "qid int, term string, weight double")
    postings = index.build_postings(docs, lengths)
    got = search.bm25_search(postings, asked, 5, few=few).collect()
    want = brute_bm25(docs, queries, 5)
    assert [(r[0], r[1], r[3]) for r in sorted(got)] == [(w[0], w[1], w[3]) for w in want]
    assert np.allclose([r[2] for r in sorted(got)], [w[2] for w in want], atol=1.1e-6)


def test_bm25_spares_frequent_terms(spark, docs, monkeypatch):
    """With telling terms in enough documents, documents with stop words only are left out."""
    sizes = {}
    real = search.written

    def watch(df, name):
        table = real(df, name)
        sizes[name] = table.count()
        return table

    monkeypatch.setattr(search, "written", watch)
    asked = spark.createDataFrame([(1, "the", 0.1), (1, "w5", 5.0)], "qid int, term string, weight double")
    search.bm25_search(index.build_postings(docs, True), asked, 3).collect()
    assert sizes["query-candidates"] < 200


@pytest.mark.parametrize("few", [10_000, 0])
def test_phrases_are_found_like_by_brute_force(spark, docs, few):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    phrases = [(i, " ".join(texts[i * 7].split()[:n])) for i, n in enumerate([1, 2, 3, 4, 5, 6])]
    phrases += [(90, "nowhere w1"), (91, "?!"), (92, "The,  OF")]
    got = search.phrase_search(docs, spark.createDataFrame(phrases, "item_id bigint, text string"), few)
    want = {
        (d, i)
        for d, t in texts.items()
        for i, p in phrases
        if p != "?!" and f" {p.lower().replace(',', '').replace('  ', ' ')} " in f" {t} "
    }
    assert {tuple(r) for r in got.collect()} == want
    assert got.count() == len(want)


@pytest.mark.parametrize("few", [4096, 0])
def test_nearest_vectors(spark, few):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(200, 6)).round(1)
    vectors[17] = 0
    vectors[50] = vectors[49]
    asked = np.vstack([vectors[49], rng.normal(size=(3, 6)), np.zeros((1, 6))])
    left = spark.createDataFrame(
        [(i, v.tolist()) for i, v in enumerate(vectors)] + [(999, [1.0])], "vec_id bigint, embedding array<float>"
    )
    right = spark.createDataFrame(
        [(i, v.tolist()) for i, v in enumerate(asked)], "qid bigint, embedding array<double>"
    )
    got = sorted(map(tuple, search.vector_search(left, right, 4, few).collect()))
    wide = vectors.astype(np.float32).astype(float)
    want = []
    for q, v in enumerate(asked[:4]):
        norms = np.linalg.norm(wide, axis=1)
        cos = [(round(float(wide[i] @ v / norms[i] / np.linalg.norm(v)), 6), i) for i in range(200) if norms[i]]
        best = sorted(cos, key=lambda x: (-x[0], x[1]))[:4]
        want += [(q, i, s, n + 1) for n, (s, i) in enumerate(best)]
    want.sort()
    assert [(g[0], g[1], g[3]) for g in got] == [(w[0], w[1], w[3]) for w in want]
    assert np.allclose([g[2] for g in got], [w[2] for w in want], atol=1.1e-6)


def test_contextual_search_both_ways(spark, docs):
    said = ["w1 w2 the", "w3", "w1 w2 the", "w9 of", "w30 w31 w5"]
    turns = spark.createDataFrame(
        [(c, t, "user" if t % 2 == 0 else "assistant", said[(t // 2 + c // 3) % 5]) for c in range(9) for t in range(6)],
        "conv_id bigint, turn bigint, role string, text string",
    )
    postings = index.build_postings(docs, True)
    a = search.contextual_search(turns, postings, max_df_ratio=0.9, few=50_000).collect()
    b = search.contextual_search(turns, postings, max_df_ratio=0.9, few=0).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    assert {(r["conv_id"], r["turn"]) for r in a} == {(c, t) for c in range(9) for t in (0, 2, 4)}


def test_many_rows_are_sorted_in_bounded_tasks(spark, monkeypatch):
    """Tasks follow the rows, not the cores: ranking, joining and writing an index."""
    docs = spark.range(600).select(
        F.col("id").alias("doc_id"),
        F.concat_ws(" ", F.lit("the of"), *[F.concat(F.lit("w"), F.pmod(F.col("id") * p, F.lit(97)).cast("string")) for p in (3, 5, 7)]).alias("text"),
    )
    postings, totals = index.build_postings(docs, True), index.corpus_totals(docs=docs)
    want = sorted(map(tuple, index.keywords_topk(postings, 2, totals).collect()))
    monkeypatch.setattr(shapes, "TASK_ROWS", 100)
    assert shapes.tasks_for(spark, 3000) == 30
    assert shapes.tasks_for(spark, 300) is None
    ranked = index.keywords_topk(postings, 2, totals)
    parts = ranked.withColumn("_task", F.spark_partition_id()).cache()
    assert sorted(map(tuple, parts.drop("_task").collect())) == want
    assert parts.select("_task").distinct().count() == 30
    keys = spark.range(100).select(F.col("id").alias("k"), F.lit(30).alias("n"))
    left = spark.range(3000).select(F.pmod("id", F.lit(100)).alias("k"), "id")
    monkeypatch.setattr(shapes, "HEAVY_KEYS", 50)
    assert shapes.keyed_join(left, keys, "k", "n").count() == 3000
    monkeypatch.setattr(shapes, "HEAVY_KEYS", 90)
    uneven = keys.withColumn("n", F.when(F.col("k") == 7, 1000).otherwise(20))
    assert shapes.keyed_join(left, uneven, "k", "n").count() == 3000
    written = queries._written_index(postings, totals)
    assert len(written.inputFiles()) > 20
    assert written.count() == postings.count()
