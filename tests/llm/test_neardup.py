"""Near-duplicates against comparing all pairs, and the pipeline."""

import random

import corpus_pipeline
import numpy as np
import pytest
from helpers import SMALL, odd_docs, table
from pyspark.sql import functions as F

from docloom.llm import decontaminate, neardup, queries


def _set(text):
    words = (text or "").encode().lower().split()
    size = min(5, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()


def _linked(a, b):
    shared = len(a & b)
    return shared > 0 and 100 * shared >= 75 * (len(a) + len(b) - shared)


def _plain(docs):
    """Component of each id by comparing all pairs of different sets."""
    sets = {}
    for i, t in docs:
        sets.setdefault(i, []).append(frozenset(_set(t)))
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if top(a) != top(b) and any(_linked(x, y) for x in sets[a] for y in sets[b]):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {i: top(i) for i in sets}


def _family(seed, n, edits, size=60):
    """Copies of one text, each with some of its words changed."""
    r = random.Random(seed)
    base = [f"{seed}w{i}" for i in range(size)]
    out = []
    for k in range(n):
        words = list(base)
        for _ in range(edits):
            words[r.randrange(size)] = f"{seed}x{k}y{r.randrange(10**6)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("edits,cell", [(1, 256), (2, 256), (2, 7), (3, 7)])
def test_same_as_all_pairs(spark, monkeypatch, edits, cell):
    """Two and three edits put most pairs near the threshold, on both sides of it."""
    monkeypatch.setattr(neardup, "CELL", cell)
    monkeypatch.setattr(neardup, "SMALL", min(cell, neardup.SMALL))
    texts = _family(1, 60, edits) + _family(2, 40, edits, 40) + _family(3, 20, edits, 12) + ["one two", "ONE two", "two one"]
    # A chain: each text is linked with the next only.
    chain = [f"c{i}" for i in range(200)]
    texts += [" ".join(chain[6 * k : 6 * k + 60]) for k in range(20)]
    # A passage that many short texts share.
    passage = " ".join(f"p{i}" for i in range(50))
    texts += [passage + " " + " ".join(f"own{k}n{i}" for i in range(30)) for k in range(40)]
    random.Random(9).shuffle(texts)
    docs = [(i * 3, t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in neardup.near_duplicates(frame).collect()}
    want = _plain(docs)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.kept == (i == want[i]) and r.n_shingles == len(_set(dict(docs)[i])) for i, r in got.items())


def test_edges(spark):
    docs = odd_docs(spark).unionByName(spark.createDataFrame([(7, "a b c d e f g")], "doc_id long, text string"), True)
    rows = neardup.near_duplicates(docs).collect()
    want = _plain([(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None])
    assert len(rows) == docs.count()
    for r in rows:
        assert r.component_id == (None if r.doc_id is None else want[r.doc_id])
        assert r.kept == (r.doc_id is None or r.doc_id == want[r.doc_id])
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_repeated_ids_carry_the_links_of_each_row(spark):
    """Documents 1 and 3 meet through the two texts of 2."""
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    docs = spark.createDataFrame([(3, a), (2, a), (2, b), (1, b), (9, "z")], "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in neardup.near_duplicates(docs).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (9, 9)}


def test_estimate(spark):
    """Agreeing bits, less chance, are near the true similarity."""
    pairs = [(_family(s, 2, e, 300)) for s in range(20) for e in (3, 10, 25)]
    docs = [(2 * n + k, t) for n, p in enumerate(pairs) for k, t in enumerate(p)]
    bits = neardup.signatures(spark.createDataFrame(docs, "doc_id long, text string")).select("doc_id", "bits")
    one = bits.where("doc_id % 2 = 0").select(F.col("doc_id").alias("a"), F.col("bits").alias("x"))
    two = bits.where("doc_id % 2 = 1").select((F.col("doc_id") - 1).alias("a"), F.col("bits").alias("y"))
    errors = []
    for r in one.join(two, "a").select("a", neardup.estimate(F.col("x"), F.col("y")).alias("est")).collect():
        s, t = (_set(x) for x in pairs[r.a // 2])
        errors.append(r.est - len(s & t) / len(s | t))
    assert abs(np.mean(errors)) < 0.02 and np.abs(errors).max() < 0.2


def test_components(spark):
    r = random.Random(4)
    links = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + r.randrange(1, 300)) for _ in range(200)]
    links += [(r.randrange(1000, 1200), r.randrange(1000, 1200)) for _ in range(120)] + [(7, 7)]
    up = {}

    def top(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = top(a), top(b)
        up[max(x, y)] = min(x, y)
    got = {r.node: r.comp for r in neardup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: top(i) for i in up if i != 7}


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").withColumn("kept", F.lit("theirs"))
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(stage(spark, kept[-1], SMALL).cache())
        assert kept[-1].columns == docs.columns
    ids = [{r.doc_id for r in k.select("doc_id").collect()} for k in kept]
    assert all(b <= a for a, b in zip(ids, ids[1:], strict=False)) and len(ids[-1]) < len(ids[0])
    texts = dict(table("documents", columns="doc_id, text"))
    want = _plain([(i, texts[i]) for i in ids[2]])
    assert ids[3] == set(want.values())
    items = table("benchmark", columns="item_id, text")
    find = decontaminate._finder(items, 10)
    assert ids[4] == {i for i in ids[3] if not len(find(texts[i])[1])}
    last = {r.doc_id: r for r in corpus_pipeline.STAGES[-1][1](spark, kept[4], SMALL).collect()}
    assert set(last) == ids[4]
    assert last == {i: r for i, r in ((r.doc_id, r) for r in queries.op7_pieces(spark, SMALL).collect()) if i in last}
    assert {r.doc_id for r in corpus_pipeline.run(spark, SMALL).select("doc_id").collect()} == ids[4]


def test_pipeline_on_odd_and_empty_input(spark):
    for docs in (odd_docs(spark), odd_docs(spark).limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SMALL)
        docs.count()
