"""Operators that learn from the corpus: toxicity, quality, suffix tree."""

import math
import pickle
import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from helpers import SMALL, odd_docs, table
from pyspark.sql import functions as F

from docloom.llm import quality, queries, suffixtree, toxicity

MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def toxic_model(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    return toxicity.fit(docs, spark.read.parquet(f"{MEDIUM}/labels.parquet"))


def _dense(index, size):
    """The examples' vectors; those of telling words stand in the blocks too."""
    dense = np.zeros((len(index.ids), size))
    dense[np.repeat(np.arange(len(index.ids)), index.held), index.at] = index.all
    for feature in range(size):
        for cell in range(index.cells[feature], index.cells[feature + 1]):
            span = slice(index.begin[cell], index.begin[cell] + index.sizes[cell])
            assert (index.examples[span] // index.block == index.blocks[cell]).all()
            assert (dense[index.examples[span], feature] == index.weights[span]).all()
    return dense


def test_nearest_is_exact(toxic_model):
    """Block by block, the search finds what comparing with every example finds."""
    index, size = toxic_model.index, len(toxic_model.vocabulary.words)
    dense = _dense(index, size)
    assert np.allclose(np.square(dense).sum(axis=1), 1)
    random = np.random.default_rng(1)
    for _ in range(200):
        at = np.sort(random.choice(size, random.integers(1, 8), replace=False))
        weights = random.random(len(at))
        weights /= np.sqrt(np.square(weights).sum())
        cosines = dense[:, at] @ weights
        order = [i for i in np.lexsort((np.arange(len(cosines)), -np.round(cosines, 9))) if cosines[i] > 0][: toxicity.NEAREST]
        _, found = index.nearest(at, weights, toxicity.NEAREST)
        assert np.allclose(found, cosines[order])
        assert not index.row.any()


def test_toxicity_on_held_out_labels(spark, toxic_model):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    scored = {r.doc_id: r for r in toxicity.score(docs, toxic_model).collect()}
    assert len(scored) == docs.count() and all(0 <= r.score <= 1 for r in scored.values())
    held = [(scored[i].predicted, y) for i, y in table("labels", MEDIUM, "doc_id, toxic") if scored[i].held_out]
    hits = Counter(held)
    assert hits[1, 0] <= 1 and hits[1, 1] >= 8
    assert all(zlib.crc32(str(i).encode()) % 4 == 2 for i, r in scored.items() if r.held_out)
    civil = docs.where(~toxicity.is_toxic(toxic_model)(F.col("text")))
    assert civil.columns == docs.columns
    assert {r.doc_id for r in civil.select("doc_id").collect()} == {i for i, r in scored.items() if not r.predicted}


def test_toxicity_edges(spark, toxic_model):
    docs = odd_docs(spark)
    rows = toxicity.score(docs, toxic_model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    labels = spark.createDataFrame([], "doc_id long, toxic int, score string")
    assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()} == {0.0}
    odd = spark.createDataFrame([(None, 1), (7, None), (63, 1), (63, 0), (5000, 1)], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.fit(docs, odd)).count() == docs.count()
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), odd)).count() == 0


def _plain_stats(text):
    words = (text or "").encode().split()
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    repeated = {j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").encode().split(b"\n") if x.split()]
    return (
        len(words), sum(len(w.decode()) for w in words), sum((text or "").count(c) for c in "#*$%&|<>"),
        len(lines) - len(set(lines)), len(repeated), len(lines),
    )


def test_quality_statistics(spark):
    docs = odd_docs(spark)
    rows = quality.judge(docs).collect()
    got = sorted((str(r.doc_id), tuple(r[s] for s in quality.STATS), r.base_failed) for r in rows)
    want = []
    for r in docs.select("doc_id", "text").collect():
        stats = _plain_stats(r.text)
        want.append((str(r.doc_id), stats, stats[0] < 10 or 100 * stats[4] > 20 * stats[0]))
    assert got == sorted(want)
    assert all(not r.kept and r.distance is None for r in rows if r.base_failed)
    assert quality.judge(docs.limit(0)).count() == 0


def test_quality_estimate_is_that_of_the_nearest(spark):
    """Against concentration steps on the whole group in one place."""
    random = np.random.default_rng(3)
    bulk = random.normal([0.0, 1.0, 0.2, 0.1], [0.3, 0.2, 0.4, 0.1], (1700, 4))
    far = random.normal([5.0, -3.0, 4.0, 2.0], 0.2, (300, 4))
    x = np.vstack([bulk, far])
    frame = spark.createDataFrame([(*r, "en", "s") for r in x.tolist()], "_x0 double, _x1 double, _x2 double, _x3 double, _lang string, _source string")
    frame = frame.withColumn("_salt", F.pmod(F.xxhash64("_x0"), F.lit(quality.SALTS)))
    got = quality.robust_estimates(frame.repartition(7)).where("_level = 0").first()._e
    centre, scatter = np.median(x, axis=0), np.diag(np.square((np.percentile(x, 75, axis=0) - np.percentile(x, 25, axis=0)) / 1.349))
    for _ in range(quality.STEPS):
        d = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(scatter), x - centre)
        near = x[np.argsort(d)[: int(quality.SHARE * len(x))]]
        centre, scatter = near.mean(axis=0), np.cov(near.T, bias=True) * quality._SCALE + np.diag(np.square(quality.FLOOR))
    inverse = np.linalg.inv(scatter)
    assert np.allclose([got[f"_c{i}"] for i in range(4)], centre, atol=0.03)
    assert np.allclose([got[f"_v{i}{i}"] for i in range(4)], inverse.diagonal(), rtol=0.1)
    # All of what is far is out, of the bulk next to nothing.
    d = np.einsum("ij,jk,ik->i", x - centre, inverse, x - centre)
    assert (d[1700:] > quality.CUTOFF).all() and (d[:1700] > quality.CUTOFF).mean() < 0.002


def test_quality_keeps_sound_documents(spark):
    got = {r.doc_id: r for r in queries.op9_quality(spark, MEDIUM).collect()}
    labels = dict(table("labels", MEDIUM, "doc_id, quality"))
    judged = [(labels[i], r.kept) for i, r in got.items() if i in labels and not r.base_failed]
    assert not any(q == 1 and not k for q, k in judged)
    assert sum(not k for q, k in judged if q == 0) > 0.7 * sum(q == 0 for q, _ in judged)


def _estimate(level, n, centre, scale, lang="", source=""):
    inverse = np.linalg.inv(np.diag([scale] * quality.DIM))
    return (level, lang, source, (float(n), *([centre] * quality.DIM), *(float(inverse[i, j]) for i, j in quality._PAIRS)))


def test_estimates_move_smoothly_with_the_size_of_a_group(spark):
    """No size of a source, 200 least, switches from one estimate to another."""
    numbers = [1, 50, 100, 198, 199, 200, 201, 400, 100_000]
    rows = [_estimate(2, 10**9, 0.0, 1.0), _estimate(1, 10**9, 1.0, 2.0, "en")]
    rows += [_estimate(0, n, 3.0, 4.0, "en", f"{n}") for n in numbers]
    fields = ", ".join(f"{c}: double" for c in ["_n", *quality._CENTRE, *quality._INVERSE])
    frame = spark.createDataFrame(rows, f"_level int, _lang string, _source string, _e struct<{fields}>")
    got = {int(r["_source"]): r for r in quality.blended(frame).collect()}
    assert sorted(got) == numbers
    for n, r in got.items():
        weight = n / (n + quality.BLEND)
        centre = 3 * weight + 1 - weight
        want = np.full((4, 4), 9 * weight + 1 - weight - centre * centre) + np.eye(4) * (4 * weight + 2 * (1 - weight))
        assert np.allclose([r[c] for c in quality._CENTRE], centre, atol=1e-6)
        assert np.allclose([r[v] for v in quality._INVERSE], [np.linalg.inv(want)[i, j] for i, j in quality._PAIRS], atol=1e-6)
    assert abs(got[199]["_c0"] - got[200]["_c0"]) < 0.01


def test_quality_rejects_repetition_alone(spark):
    """Texts that differ from sound ones in repeated words only, or in repeated lines only."""
    def words(i, n):
        return [f"w{(i * 7919 + j * 104729) % 99991}" for j in range(n)]

    rows = [(i, " ".join(words(i, 400))) for i in range(300)]
    twice = words(1000, 38)
    rows.append((1000, " ".join(words(1000, 324) + twice)))  # 76 of 362 words: 20.99 % fail by rule
    rows.append((1001, " ".join(words(1001, 330) + words(1001, 35))))  # 70 of 365: 19.2 %, by distance
    rows.append((1002, "\n".join("yes\nyes\n" + " ".join(words(2000 + k, 10)) for k in range(30))))  # 59 of 90 lines
    rows.append((1003, " ".join(words(1003, 390) + words(1003, 8))))  # 16 of 398: sound
    docs = spark.createDataFrame([(i, t, "en", "web") for i, t in rows], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    assert got[1000].base_failed and not got[1001].base_failed
    assert got[1002].n_dup_lines == 59 and got[1002].n_repeat_words == 0
    assert not got[1001].kept and not got[1002].kept and got[1003].kept
    assert all(got[i].kept for i in range(300))


def test_small_groups_take_the_estimate_of_their_language(spark):
    rows = [(i, " ".join(f"w{(i * 31 + j * j) % 911}" for j in range(40)), "en" if i % 2 else "de", f"s{i % 40}") for i in range(300)]
    rows.append((1000, "#$% " * 3 + " ".join(f"q{j}###$$$" for j in range(60)), "en", "s-new"))
    judged = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    assert [r.doc_id for r in judged.where("not kept").collect()] == [1000]


def _corpus():
    random = np.random.default_rng(5)
    texts = []
    for i in range(400):
        words = ["new", "york"] * int(random.integers(0, 3)) + [f"v{k}" for k in random.integers(0, 40, 30)]
        words += ["in", "the", "house"] if i % 2 else ["at", "the", "sea"]
        texts.append(" ".join(words))
    return texts


def test_suffix_tree(spark, monkeypatch):
    """Contexts that matter are retained, and every state's distribution sums to one."""
    monkeypatch.setattr(suffixtree, "SYMBOL", 0.115)
    texts = _corpus()
    docs = spark.createDataFrame([(1, t, False) for t in texts], "doc_id long, text string, held_out boolean").repartition(3)
    tree, counts, _ = suffixtree.learn(docs)
    plain = Counter(w for t in texts for w in [*t.encode().split(), None])
    assert (tree.total, tree.distinct) == (sum(plain.values()), len(plain))
    assert counts.agg(F.sum("train")).first()[0] == tree.total
    codes = suffixtree._Codes(tree.hashes)
    number = {w: codes[w] for w in plain if w}
    known = [number[w] for w in (b"new", b"york", b"the", b"house", b"in")]
    # "in the" and "at the" tell what follows, which "the" does not.
    line = np.array([number[b"in"], number[b"the"], number[b"house"]])
    states = tree.states(line, len(tree.levels))
    assert states[1][2] >= 0 and tree.probabilities(line)[2] > 0.9
    all_symbols = np.arange(tree.size)
    for before in ([], [known[0]], [number[b"in"], number[b"the"]], [number[b"at"], number[b"the"]], [number[b"v1"]]):
        p = [tree.probabilities(np.array([*before, s]))[-1] for s in all_symbols]
        rest = tree.probabilities(np.array([*before, -1]))[-1]
        rare = 1 - tree.root(tree.counts).sum()
        assert math.isclose(sum(p) + rest * rare, 1, abs_tol=1e-9)


def test_suffix_tree_counts_followers(spark):
    texts = _corpus()
    docs = spark.createDataFrame([(1, t, False) for t in texts], "doc_id long, text string, held_out boolean").repartition(3)
    tree, _, coded = suffixtree.learn(docs)
    everything = suffixtree.Tree(tree.hashes, tree.counts, tree.total, tree.rare, tree.distinct, [suffixtree.Level(np.arange(tree.size))])
    got = {r.key: r.n for r in suffixtree._followers(coded, everything, 1).collect()}
    codes = suffixtree._Codes(tree.hashes)
    end = codes[b"\n"]
    want: Counter = Counter()
    for t in texts:
        s = [codes[w] for w in [*t.encode().split(), b"\n"]]
        want.update(a * (tree.size + 1) + b for a, b in zip(s, s[1:], strict=False))
    got = {k: n for k, n in got.items() if k // (tree.size + 1) != end}  # the level has the end, too
    assert got == dict(want)


def test_suffix_tree_grows_with_the_corpus(spark):
    sizes = []
    for folder in (SMALL, MEDIUM):
        docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", F.lit(False).alias("held_out"))
        tree, _, _ = suffixtree.learn(docs)
        sizes.append(([len(level.keys) for level in tree.levels], len(tree.levels[0].pairs)))
    (small, few), (medium, many) = sizes
    assert medium[0] > 1.5 * small[0] and sum(medium) > 1.5 * sum(small) and many > 2 * few


def test_scores(spark):
    rows = {r.doc_id: r for r in queries.op10_suffix_tree(spark, SMALL).collect()}
    tokens = {i: [*(t or "").encode().lower().split(), None] for i, t in table("documents", columns="doc_id, text")}
    counts: Counter = Counter()
    for i, t in tokens.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update(t)
    n, v = sum(counts.values()), len(counts)
    for i, t in tokens.items():
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        r = rows[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(counts[w] > 0 for w in t), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
    held = [r for r in rows.values() if r.held_out]
    assert sum(r.score for r in held) >= sum(r.base_score for r in held)


def test_score_edges(spark):
    docs = odd_docs(spark)
    rows = suffixtree.score(docs).collect()
    assert len(rows) == docs.count()
    assert all(r.n_tokens >= 1 and r.score < 0 for r in rows)
    twice = [r for r in rows if r.doc_id == 63]
    assert len(twice) == 2 and math.isclose(twice[0].score, twice[1].score)
    assert suffixtree.score(docs.limit(0)).count() == 0
    # Nothing to learn from: every token is unknown.
    alone = spark.createDataFrame([(4, "a b")], "doc_id long, text string")
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    got = suffixtree.score(alone.withColumn("doc_id", F.lit(held).cast("long"))).first()
    assert (got.n_known, got.train_tokens, got.base_score) == (0, 0, 0.0)


def test_toxicity_of_few_labels(spark):
    """Nine toxic examples are enough for the pipeline's stage, though no word is in five of them."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    left = {r.doc_id for r in corpus_pipeline.keep_civil(spark, docs, SMALL).select("doc_id").collect()}
    labels = table("labels", SMALL, "doc_id, toxic")
    gone = Counter(y for i, y in labels if i not in left)
    assert gone[1] >= 9 and gone[0] <= 2


def test_toxicity_indexes_whole_texts(spark, monkeypatch):
    """Every word of every example is a feature, and blocks in any order find the nearest."""
    monkeypatch.setattr(toxicity, "BLOCK", 8)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    labels = {i for i, _ in table("labels", columns="doc_id, toxic") if zlib.crc32(str(i).encode()) % 4 != 2}
    texts = {t for i, t in table("documents", columns="doc_id, text") if i in labels}
    plain = [{w for w in re.split(rb"[^0-9a-z\x80-\xff]+", t.encode().lower()) if w} for t in texts]
    numbers = model.vocabulary.numbers
    assert set(numbers) == set().union(*plain)
    index = model.index
    assert index.block == 8 and len(index.edges) > 5
    assert len(index.ids) == sum(map(bool, plain)) and len(index.all) == sum(map(len, plain))
    dense = _dense(index, len(numbers))
    some = [model.vocabulary.numbered(t) for _, t in table("documents", columns="doc_id, text")]
    vectors = [(at, model.vector(at, tf)) for at, tf in some if len(at)]
    multiplied = []
    monkeypatch.setattr(index, "_products", lambda part, plain=index._products: multiplied.append(len(part)) or plain(part))
    for (at, weights), (places, cosines) in zip(vectors, index.nearest_of(vectors, 5), strict=True):
        want = dense[:, at] @ weights
        assert np.allclose(cosines, np.sort(want)[::-1][:5][: len(cosines)]) and np.allclose(want[places], cosines)
        assert len(cosines) == min(5, (want > 0).sum())
    assert sum(multiplied) < len(vectors) * len(index.ids)
    assert model.scores([None, "", "a b"] * 2)[:3] == model.scores([None, "", "a b"])


def test_toxicity_index_travels_without_what_a_task_makes(toxic_model, monkeypatch):
    """Of an example's words only numbers and counts travel; a task finds the same, however it cuts its sums."""
    index, size = toxic_model.index, len(toxic_model.vocabulary.words)
    packed = pickle.dumps(index)
    assert len(packed) < 6 * len(index.at) + 32 * len(index.ids) + 4 * size + 8 * toxicity.COMMONEST + 4096
    other = pickle.loads(packed)
    assert (other.all == index.all).all() and (other.weights == index.weights).all()
    random = np.random.default_rng(2)
    vectors = []
    for _ in range(40):
        at = np.sort(random.choice(size, 60, replace=False))
        weights = random.random(60)
        vectors.append((at, weights / np.sqrt(np.square(weights).sum())))
    want = index.nearest_of(vectors, toxicity.NEAREST)
    monkeypatch.setattr(toxicity, "POSTINGS", 16)
    monkeypatch.setattr(toxicity, "PRODUCT", 3)
    for (places, cosines), (places2, cosines2) in zip(want, other.nearest_of(vectors, toxicity.NEAREST), strict=True):
        assert (places == places2).all() and (cosines == cosines2).all()
