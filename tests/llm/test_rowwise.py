"""Operators that look at each text by itself: decontamination, pieces, token counts, sharding."""

import hashlib
import re
import tracemalloc
from collections import Counter

import public_tokenizers
import pytest
from helpers import SMALL, odd_docs, odd_texts, table
from pyspark.sql import functions as F

from docloom.llm import decontaminate, pieces, queries, sharding, tokencounts


def _lower(text):
    return re.sub("[A-Z]+", lambda m: m.group().lower(), text or "")


def _hits(text, items, window=10):
    """Word by word: hit words' places and items, by comparing every stretch of words."""
    found = [(m.group(), m.span()) for m in decontaminate.WORD.finditer(_lower(text))]
    words, hit, named = [w for w, _ in found], set(), set()
    for item_id, item in items:
        mine = decontaminate.WORD.findall(_lower(item))
        size = min(window, len(mine))
        grams = {tuple(mine[i : i + size]) for i in range(len(mine) - size + 1)} if size else set()
        for i in range(len(words) - size + 1 if size else 0):
            if tuple(words[i : i + size]) in grams:
                hit |= set(range(i, i + size))
                named.add(str(item_id))
    return len(words), hit, named, found


ITEMS = [
    (1, "one two three four five six seven eight nine ten, eleven"),
    (10, "two THREE four five six seven eight nine ten eleven"),
    (2, "Word1"), (3, None), (4, " ?! "), (5, "same line"), (5, "same line"), (6, "word976 ünï12"),
]


@pytest.mark.parametrize("most", [decontaminate.WINDOW_BYTES, 20])
def test_decontamination(spark, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "WINDOW_BYTES", most)
    benchmark = spark.createDataFrame([(*i, "x") for i in ITEMS], "item_id long, text string, n_hit string")
    docs = odd_docs(spark)
    got = decontaminate.find_contamination(docs, benchmark).collect()
    want = []
    for row in docs.select("doc_id", "text").collect():
        n, hit, named, found = _hits(row.text, ITEMS)
        want.append((row.doc_id, n, len(hit), sorted(named), bool(hit)))
        spans = [r.spans for r in got if (r.doc_id, r.n_words, r.n_hit) == (row.doc_id, n, len(hit))][0]
        covered = {i for i, (_, (a, b)) in enumerate(found) if any(s.begin <= a and b <= s.end for s in spans)}
        assert covered == hit
    key = lambda r: (str(r[0]), r[1], r[2])
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in got), key=key) == sorted(want, key=key)
    flagged = docs.where(decontaminate.is_contaminated(benchmark)(F.col("text")))
    assert flagged.columns == docs.columns
    assert flagged.count() == sum(w[4] for w in want)


def test_decontamination_of_nothing(spark):
    docs = odd_docs(spark)
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_contamination(docs, none).where("contaminated or n_hit > 0").count() == 0
    assert decontaminate.find_contamination(docs.limit(0), none).count() == 0


@pytest.fixture(scope="module")
def model():
    return pieces.read_model(public_tokenizers.path(queries.PIECES))


@pytest.mark.parametrize("table_size", [pieces.TABLE, 3])
def test_pieces_are_those_of_the_library(spark, model, monkeypatch, table_size):
    import sentencepiece

    monkeypatch.setattr(pieces, "TABLE", table_size)
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    assert pieces.chunks_are_safe(model)
    segment = pieces._segmenter(model)
    texts = [t or "" for t in odd_texts()] + [t for _, t in table("documents", columns="doc_id, text")]
    assert segment(texts) == library.encode(texts)
    decoded = pieces.decode(pieces.encode(odd_docs(spark), model), model).collect()
    assert len(decoded) == odd_docs(spark).count()
    for row in decoded:
        assert row.text == library.decode(row.ids)


def test_pieces_table_takes_few_bytes_a_chunk(model):
    words = [f"w{i:x}" for i in range(40_000)]
    texts = [" ".join(words[at : at + 500]) for at in range(0, len(words), 500)]
    segment = pieces._segmenter(model)
    segment(["first"])
    tracemalloc.start()
    try:
        for text in texts:
            segment([text])
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert held < 250 * len(words)


def test_pieces_query_digests(spark, model):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    got = {r.doc_id: r for r in queries.op7_pieces(spark, SMALL).collect()}
    for doc_id, text in table("documents", columns="doc_id, text"):
        ids = library.encode(text)
        assert got[doc_id].n_tokens == len(ids)
        assert got[doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[doc_id].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert pieces.encode(odd_docs(spark).limit(0), model).count() == 0


def test_token_counts(spark, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(queries.WORDS)
    tokenizer, library = pieces.read_model(path), Tokenizer.from_file(path)
    docs = odd_docs(spark).unionByName(
        spark.createDataFrame([(i, t) for i, t in table("documents", columns="doc_id + 9000, text")], "doc_id long, text string"), True
    )
    cache = str(tmp_path / "cache")
    got = tokencounts.count_tokens(docs, tokenizer, cache, limit=100).collect()
    want = [
        (r.doc_id, len((r.text or "").encode()), n, n > 100)
        for r in docs.select("doc_id", "text").collect()
        for n in [len(library.encode(r.text or "", add_special_tokens=False).ids)]
    ]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("content").distinct().count() == len(
        {re.sub(r"[\x09-\x0D ]+", " ", r.text or "").strip(" ") for r in docs.select("text").collect()}
    )
    # All are hits now; another version shares nothing with them.
    again = tokencounts.count_tokens(docs, tokenizer, cache, limit=100).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert spark.read.parquet(cache).count() == stored.count()
    tokencounts.count_tokens(docs, tokenizer + b" ", cache).count()
    assert spark.read.parquet(cache).groupBy("tokenizer").count().count() == 2
    assert tokencounts.count_tokens(docs.limit(0), tokenizer, str(tmp_path / "none")).count() == 0


def test_token_counts_without_the_word_table():
    bytes_bpe = pieces.read_model(public_tokenizers.path("byte_bpe_50k.json"))
    assert not tokencounts.drops_space(bytes_bpe)
    from tokenizers import Tokenizer

    texts = ["a  b\n\nc", "", "<|endoftext|> x "]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert tokencounts._counter(bytes_bpe)(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def _plain_table(shards, slots):
    """The table by written-out preference lists."""
    prefer = {}
    for s in shards:
        d = hashlib.sha256(s.encode()).digest()
        offset, skip = int.from_bytes(d[:8]) % slots, int.from_bytes(d[8:16]) % (slots - 1) + 1
        prefer[s] = [(offset + j * skip) % slots for j in range(slots)]
        assert len(set(prefer[s])) == slots
    taken = {}
    while len(taken) < slots:
        for s in sorted(shards):
            free = next((p for p in prefer[s] if p not in taken), None)
            if free is not None:
                taken[free] = s
    return [taken[i] for i in range(slots)]


def test_sharding_table():
    names = [f"s{i}" for i in range(7)]
    filled = [names[i] for i in sharding.fill_table(names, 101)]
    assert filled == _plain_table(names, 101)
    other = names[::-1]
    assert [other[i] for i in sharding.fill_table(other, 101)] == filled
    sizes = Counter(sharding.fill_table(queries.SHARDS))
    assert max(sizes.values()) - min(sizes.values()) <= 1
    fewer = queries.SHARDS[:-1]
    before, after = sharding.fill_table(queries.SHARDS), sharding.fill_table(fewer)
    gone = len(queries.SHARDS) - 1
    moved = sum(a != b for a, b in zip(before, after, strict=True) if a != gone)
    assert moved < 0.1 * sharding.SLOTS
    double = Counter(sharding.fill_table(names, 1009, [2, 1, 1, 1, 1, 1, 1]))
    assert 1.9 < double[0] / double[1] < 2.1
    for bad in (([], 101), (["a", "a"], 101), (["a"], 100)):
        with pytest.raises(ValueError):
            sharding.fill_table(*bad)


def test_sharding_of_rows(spark, tmp_path):
    docs = odd_docs(spark)
    names = [f"s{i}" for i in range(7)]
    plain = _plain_table(names, 101)
    placed = sharding.place(docs, F.col("doc_id"), names, 101)
    assert placed.count() == docs.count()
    for r in placed.select("doc_id", "slot", "shard").collect():
        key = "" if r.doc_id is None else str(r.doc_id)
        slot = int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % 101
        assert (r.slot, r.shard) == (slot, plain[slot])
    sharding.write_shards(placed, str(tmp_path / "shards"), 3)
    assert spark.read.parquet(str(tmp_path / "shards")).count() == docs.count()
    assert sharding.place(docs.limit(0), F.col("doc_id"), names, 101).count() == 0
    got = {r.doc_id: r.shard for r in queries.op4_sharding(spark, SMALL).collect()}
    table_ = sharding.fill_table(queries.SHARDS)
    for (doc_id,) in table("documents", columns="doc_id"):
        assert got[doc_id] == queries.SHARDS[table_[int(hashlib.md5(str(doc_id).encode()).hexdigest()[:15], 16) % sharding.SLOTS]]


@pytest.mark.parametrize("held,run", [(24 << 20, 20_000), (900, 7)])
def test_token_counter_forgets_and_counts_long_texts_in_runs(monkeypatch, held, run):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokencounts, "TABLE_BYTES", held)
    monkeypatch.setattr(tokencounts, "WORDS", run)
    model = pieces.read_model(public_tokenizers.path(queries.WORDS))
    texts = ["", "one", "one two " * 40 + "three", *(f"w{i} x{i % 3} one" for i in range(30)), ""]
    texts = [t.strip() for t in texts]
    library = Tokenizer.from_buffer(model)
    assert tokencounts._counter(model)(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
