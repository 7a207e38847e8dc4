"""Ranked lexical search against a plain version."""

from __future__ import annotations

import math
import re
from collections import Counter

import pytest
from helpers import odd_docs, odd_texts, table

from docloom.llm import lexical

TERM = re.compile(lexical.TERM)


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, k=10):
    """All documents scored for all items, in Python's integers."""
    counted = [(d, Counter(terms(t))) for d, t in docs]
    counted = [(d, c) for d, c in counted if c]
    n, total = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = []
    for i, words in wanted.items():
        scored = []
        for d, c in counted:
            m = 100 - 90 + 90 * c.total() * n // total
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m))
                for w in words
                if c[w]
            )
            if score > 0:
                scored.append((-score, d is None, d))
        scored.sort(key=lambda s: (s[0], s[1], s[2] or 0))
        out += [(i, r, d, -s) for r, (s, _, d) in enumerate(scored[:k], 1)]
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


@pytest.mark.parametrize("sizes", [{}, {"GROUP_ITEMS": 7, "TERMS": 5, "DOCS": 16, "ITEMS": 3}])
def test_given_tables(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(lexical, name, value)
    docs, items = table("documents", columns="doc_id, text"), table("benchmark", columns="item_id, text")
    frames = (spark.createDataFrame(r, s) for r, s in ((docs, "doc_id long, text string"), (items, "item_id long, text string")))
    assert rows(lexical.search(*frames)) == plain(docs, items)


def test_odd_rows_ties_and_copies(spark):
    docs = odd_docs(spark)
    items = [(i, t) for i, t in enumerate(odd_texts()[:12])] + [(3, "more twelve"), (None, "no id at all"), (99, None), (98, "nowhere")]
    wanted = plain([(r["doc_id"], r["text"]) for r in docs.collect()], items, 4)
    assert rows(lexical.search(docs, spark.createDataFrame(items, "item_id int, text string"), 4)) == wanted
    assert any(d is None for _, _, d, _ in wanted)
    copies = [(i, "same words here") for i in range(700)] + [(1000 + i, f"other {i}") for i in range(50)]
    found = rows(lexical.search(spark.createDataFrame(copies, "doc_id long, text string").repartition(5), spark.createDataFrame([("a", "words")], "item_id string, text string")))
    assert [d for _, _, d, _ in sorted(found, key=lambda r: r[1])] == list(range(10))


def test_terms_of_sums_near_the_bound(spark, monkeypatch):
    """Tiles get narrower as weights rise, and never lose a unit."""
    monkeypatch.setattr(lexical, "MOST_IMPACT", 2**40)
    docs = [(i, " ".join(f"w{j}" for j in range(i % 40 + 1))) for i in range(60)]
    items = [(1, " ".join(f"w{j}" for j in range(40)))]
    frames = (spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert rows(lexical.search(*frames)) == plain(docs, items)


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    for docs, asked in ((none, items), (some, items.limit(0)), (none, items.limit(0))):
        found = lexical.search(docs, asked)
        assert found.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
        assert found.count() == 0
