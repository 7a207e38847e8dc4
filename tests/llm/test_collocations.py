"""Phrase collocations against a plain version."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from helpers import odd_docs, table

from docloom.llm import collocations


def pieces(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [re.findall("[^ \t]+", p) for p in re.split("[.,;:!?\n\x0b\x0c\r]", lower)]


def plain(docs, most=5, least=100, share=100, top=2000):
    f, total = Counter(), Counter()
    for _, lang, text in docs:
        lang = "und" if lang is None else lang
        for words in pieces(text):
            total[lang] += len(words)
            f.update((lang, tuple(words[i : i + n])) for n in range(1, most + 1) for i in range(len(words) - n + 1))
    chosen = {p: a for p, a in f.items() if a >= least and len(p[1]) > 1}
    inside = Counter()
    for (lang, words), a in chosen.items():
        for n in range(2, len(words)):
            for i in range(len(words) - n + 1):
                key = lang, words[i : i + n]
                inside[key] = max(inside[key], a)
    out = []
    for (lang, words), a in chosen.items():
        if (lang, words) in inside and 100 * inside[lang, words] >= share * a:
            continue
        cuts = [(1000 * a * total[lang] // (f[lang, words[:k]] * f[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out.append((lang, score, a, " ".join(words), f[lang, words[:k]], f[lang, words[k:]], total[lang]))
    ranked = []
    for lang in total:
        mine = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[1], -r[2], r[3].encode()))[:top]
        ranked += [(lang, i, p, a, le, r, n, s) for i, (_, s, a, p, le, r, n) in enumerate(mine, 1)]
    return sorted(ranked)


def rows(df):
    return sorted(tuple(r) for r in df.drop("first").collect())


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, lang string, text string")


@pytest.mark.parametrize("bits", [64, 12])
def test_given_table(spark, bits):
    """With fingerprints of 12 bits nearly all phrases share theirs with others."""
    docs = table("documents", columns="doc_id, lang, text")
    found = collocations.collocations(frame(spark, docs).repartition(3), least=40, bits=bits)
    assert rows(found) == plain(docs, least=40) != []


def test_odd_rows(spark):
    docs = odd_docs(spark)
    given = [(r["doc_id"], r["lang"], r["text"]) for r in docs.collect()]
    for most, least, share, top in ((5, 2, 100, 2000), (2, 1, 100, 7), (3, 3, 50, 2000), (7, 2, 100, 50)):
        found = collocations.collocations(docs, most, least, share, top)
        assert rows(found) == plain(given, most, least, share, top) != []


def test_pointers_lead_to_the_phrase(spark):
    docs = [(i, "en", "x. " * (i % 3) + "alpha\t beta gamma, delta " + "alpha beta " * (i % 2)) for i in range(40)]
    found = collocations.collocations(frame(spark, docs), least=5)
    texts = {i: [f" {' '.join(p)} " for p in pieces(t)] for i, _, t in docs}
    for r in found.collect():
        holds = [i for i in texts if any(f" {r['phrase']} " in p for p in texts[i])]
        assert r["first"] == min(holds)


def test_blocks_cut_nothing_apart():
    """Texts in blocks give the phrases of the whole text, once each."""
    rng = random.Random(5)
    texts = ["".join(rng.choice(["ab", "Cd ", "e  f\t", " ", ". ", "\n", "ghijklmnopqrstuvwxyz" * 3, "é "]) for _ in range(900)) for _ in range(6)]
    for block in (1, 7, 50, 400):
        found = Counter()
        for text in texts:
            for data, own in collocations._entries(text, 4, block):
                words = collocations._Words([(1, "en", data, own)], 64)
                seen = words.joined.split()
                assert words.piece.shape == (len(seen),)
                for n in range(1, 5):
                    ok = np.flatnonzero(words.grams(n)[1])
                    found.update(tuple(seen[i : i + n]) for i in ok)
        wanted = Counter()
        for text in texts:
            for p in pieces(text):
                p = [w.encode() for w in p]
                wanted.update(tuple(p[i : i + n]) for n in range(1, 5) for i in range(len(p) - n + 1))
        assert found == wanted


def test_products_beyond_64_bits(spark):
    a, n = 4 * 10**15, 9 * 10**16
    phrases = [("en", 0, "", n), ("en", 1, "p", a + 7), ("en", 1, "q", a + 1), ("en", 1, "r", a + 1), ("en", 2, "p q", a + 1), ("en", 2, "q r", a + 3), ("en", 3, "p q r", a)]
    counted = spark.createDataFrame([(*p, 1) for p in phrases], "lang string, size int, phrase string, n long, first long")
    best = {r["phrase"]: (r["l"], r["r"], r["score"]) for r in collocations.best_cut(counted).collect()}
    cut = lambda a, le, r: 1000 * a * n // (le * r)
    assert best["p q r"] == min(((a + 7, a + 3), (a + 1, a + 1)), key=lambda c: cut(a, *c)) + (min(cut(a, a + 7, a + 3), cut(a, a + 1, a + 1)),)
    assert best["p q"] == (a + 7, a + 1, cut(a + 1, a + 7, a + 1))


def test_equal_cuts_take_the_shortest_first_part(spark):
    docs = [(i, "en", "k l m") for i in range(5)]
    (row,) = rows(collocations.collocations(frame(spark, docs), least=5))
    assert row == ("en", 1, "k l m", 5, 5, 5, 15, 3000)


def test_empty_table(spark):
    found = collocations.collocations(frame(spark, []))
    assert found.count() == 0 and dict(found.dtypes)["rank"] == dict(found.dtypes)["score"] == "bigint"
    assert collocations.collocations(frame(spark, [(1, None, None), (2, "en", " ,. ")])).count() == 0
