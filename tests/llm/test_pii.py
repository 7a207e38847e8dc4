"""Personal data: base spans against the stated patterns, added ones by planted cases."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from helpers import SMALL, odd_docs, table
from pyspark.sql import functions as F

from docloom.llm import pii, queries

PATTERNS = {k: re.compile(p) for k, p in pii.BASE.items()}


def passes_luhn(digits):
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = int(ch) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and passes_luhn(digits)
    return kind != "phone" or 8 <= len(digits) <= 15


def plain(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in p.finditer(text or "") if valid(k, m[0])]


def spans(rows):
    return [tuple(s) for s in rows]


def random_texts(n):
    rng = random.Random(11)
    bits = ["a", "b.c", "@", "x@y.z", "q@w.e_r@t.y", ".", "..", "1.2.3.4", "255.256.1.1", "00012.7.7.7", " ", "-", "4111 1111 1111 1111", "4111-1111-1111-1112", "5500005555555559", "12", "7 7-7", "+", "+1 (017) 555-7713", "+49 30 1234", "(", ")", "é", "😀", "x", "9" * 20, "\n", "%", "_"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(1, 25))) for _ in range(n)]


def test_base_spans_are_those_of_the_patterns(spark):
    texts = random_texts(3000) + [r[0] for r in table("documents", columns="text")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    found = {r["doc_id"]: spans(r["base"]) for r in pii.find_private(docs).collect()}
    assert all(found[i] == plain(t) for i, t in enumerate(texts))
    assert len({s[0] for f in found.values() for s in f}) == 4


def test_digests_of_the_registered_query(spark):
    texts = dict(table("documents", columns="doc_id, text"))
    rows = queries.op13_private(spark, SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = plain(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert set(text.split(",")) <= set(r["spans"].split(",")) or not text


def test_expressions_only(spark):
    plan = queries.op13_private(spark, SMALL)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.fixture(scope="module")
def planted(spark):
    """Ordinary texts with base spans and failing matches, and a few wider ones."""
    rng = random.Random(3)
    rows = []
    for i in range(400):
        digits = "".join(str(rng.randint(0, 9)) for _ in range(15))
        cards = [digits + str(d) for d in range(10)]
        good = next(c for c in cards if passes_luhn(c))
        bad = next(c for c in cards if not passes_luhn(c))
        rows += [
            f"please call me at +1 (5{i % 90 + 10}) 555-{1000 + i} today", f"write to user.{i}@mail{i % 9}.example.com please",
            f"from host {1 + i % 200}.{i % 256}.7.{i % 250} came this", f"card {good} was charged", f"order number {bad} shipped", f"nothing {i} to see",
        ]
    rows += ["please call me at (212) 555-0134 today", "write to jane.doe (at) example (dot) com please", "card 378282246310005 was charged"]
    rows += ["order 1234567812345678 shipped", "section 1.2.3", "version 300.1.2.3", "isbn 978-316-1484 here", "look at home. then go"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    return rows, {r["doc_id"]: r for r in pii.find_private(docs.repartition(4)).collect()}


def test_wider_spans_are_added(planted):
    rows, found = planted
    for text, span in (
        ("please call me at (212) 555-0134 today", "(212) 555-0134"),
        ("write to jane.doe (at) example (dot) com please", "jane.doe (at) example (dot) com"),
        ("card 378282246310005 was charged", "378282246310005"),
    ):
        (s,) = found[rows.index(text)]["added"]
        assert text[s["start"] : s["end"]] == span and s["chance"] >= pii.THRESHOLD


def test_clean_texts_and_failing_matches_are_left_alone(planted):
    rows, found = planted
    for i, text in enumerate(rows):
        if not re.search("call|write|host|card", text):
            assert not found[i]["base"] and not found[i]["added"], text
        assert not {(s["start"], s["end"]) for s in found[i]["added"]} & {(s["start"], s["end"]) for s in found[i]["base"]}


def test_labelers_reliability(spark):
    """A labeler that votes with the check is trusted more than one that votes at random."""
    rng = random.Random(7)
    rows = []
    for i in range(2000):
        good = i % 2
        check = 1 if good or rng.random() < 0.1 else -1
        rows.append((4, [rng.choice([-1, 1]), check, 1 if good else -1, 0, 0, 0], 1))
    counted = spark.createDataFrame(rows, "group int, votes array<int>, n long")
    share, chances = pii._estimated(counted)[4]
    assert 0.4 < share < 0.6
    random_no, random_yes = chances[0]
    assert abs(random_no[2] - random_yes[2]) < 0.1
    list_no, list_yes = chances[2]
    assert list_yes[2] > 0.9 and list_no[0] > 0.9


def test_odd_rows(spark):
    docs = odd_docs(spark)
    found = pii.find_private(docs)
    assert found.count() == docs.count()
    wanted = sorted((str(r["doc_id"]), str(plain(r["text"]))) for r in docs.collect())
    assert sorted((str(r["doc_id"]), str(spans(r["base"]))) for r in found.collect()) == wanted
    empty = pii.digests(pii.find_private(docs.limit(0)))
    assert empty.count() == 0
    assert empty.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]


def test_very_long_runs_take_no_square_time(spark):
    texts = ["x" * 400_000, "1" * 400_000, "1 " * 200_000, "a@" * 200_000, "+1" * 200_000, "1." * 200_000, "4111 1111 1111 1111, " * 5_000, "a at " * 100_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    found = {r["doc_id"]: r["n"] for r in pii.find_private(docs).select("doc_id", F.size("base").alias("n")).collect()}
    assert found == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 50_000, 6: 5_000, 7: 0}
