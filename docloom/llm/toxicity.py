"""Toxicity by the nearest labelled examples.

Examples are a bounded sample of labelled documents, their features all words of their texts. A
word weighs (1 + log tf) * idf * relevance, with document frequencies over all documents. The
relevance is the log of the smoothed rate of the label among examples with the word over the base
rate, none below 0, plus ``COMMON``: no count decides whether a word exists, and a text without any
telling word is compared by plain TF-IDF. A text's nearest examples by exact cosine are found in an
inverted index of all words. What the commonest words add to each example is one matrix product for
a slice of texts, what the others add is summed up from their postings, and the examples that may be
among the nearest are multiplied again in full, so that equal ones are equal. The examples vote, the
nearer the more, and a monotone table turns votes into scores. It is made by folds of the examples,
each judged by a relevance and an index of the others.

Indexes are built in tasks, one for each fold and one of all examples. The driver sees the words of
the examples, their document frequencies, the votes of the folds, and the last index on its way to
the tasks: all bounded by the texts of at most ``EXAMPLES`` examples, not by the data.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields, replace
from functools import cached_property
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import SLICE, WORD_BYTES, fold, map_slices, release
from docloom.sources.tables import written

# Labelled documents that are examples, at most: those first in an order by hash.
EXAMPLES = 16_384
# Examples of the base rate that a word's rate is smoothed by, and the relevance of any word.
PRIOR, COMMON = 8.0, 0.02
# So many of the commonest words are compared for a whole slice of texts by one product; the others have
# postings. No result depends on it, nor on the examples of a block, which bounds what laying out takes.
COMMONEST = 384
NEAREST = 9
BLOCK = 2048
THRESHOLD = 0.3
FOLDS, HELD_OUT = 4, 2
# A vote at similarity s weighs 1 / (1 - s + SOFT); one vote of the base rate stands at s = 0.
SOFT = 0.05
BINS = 20
# Parts of the examples that are judged by the others for the calibration.
PARTS = 4
# Texts whose products with the common words a task holds at once, and postings of one text, about.
PRODUCT, POSTINGS = 128, 1 << 16
# Examples of which the best stands for all when the k-th best is looked for.
RUN = 64
# Bytes of a piece in which an index travels.
CHUNK = 1 << 20
# Sums in another order and in single precision differ by less.
SLACK = 1e-5


def _words(text: str | None) -> list[bytes]:
    return text.encode().translate(WORD_BYTES).split() if text else []


def _runs(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of the runs that begin there, one after the other."""
    ends = np.cumsum(sizes, dtype=begin.dtype)
    out = np.repeat(begin - ends + sizes.astype(begin.dtype), sizes)
    out += np.arange(len(out), dtype=begin.dtype)
    return out


@dataclass
class Index:
    """Examples with all words of each, as they travel: how often an example has a word, and the words'
    factors. A task lays out the rest once: weights, the commonest words as a matrix, and postings by
    feature of all others."""

    ids: np.ndarray  # of examples, in the index's order
    toxic: np.ndarray
    held: np.ndarray  # of each example: how many words
    at: np.ndarray
    tf: np.ndarray
    factors: np.ndarray  # [features], in single precision
    common: np.ndarray  # the commonest features
    block: int  # examples of a block

    def __getstate__(self) -> dict:
        """What can be made again in a task is not sent there."""
        return {f.name: getattr(self, f.name) for f in fields(self)}

    @cached_property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.held, dtype=np.int64) - self.held

    @cached_property
    def edges(self) -> np.ndarray:
        return np.arange(0, len(self.ids), self.block)

    def _span(self, first: int) -> tuple[slice, np.ndarray]:
        """Where the words of a block stand, and the example of each."""
        last = min(first + self.block, len(self.ids)) - 1
        of = np.repeat(np.arange(first, last + 1, dtype=np.uint16), self.held[first : last + 1])
        return slice(self.starts[first], self.starts[last] + self.held[last]), of

    @cached_property
    def all(self) -> np.ndarray:
        """The weights of all words of an example, of length 1."""
        out = np.empty(len(self.at), np.float32)
        for first in self.edges.tolist():
            span, of = self._span(first)
            out[span] = _weights(self.at[span], self.tf[span], of - np.uint16(first), self.factors)
        return out

    @cached_property
    def columns(self) -> np.ndarray:
        """[features]: the row of a feature in ``dense``, -1 for those that have none."""
        out = np.full(len(self.factors), -1, np.int32)
        out[self.common] = np.arange(len(self.common))
        return out

    @cached_property
    def dense(self) -> np.ndarray:
        """[common features, examples]: weights."""
        out = np.zeros((len(self.common), len(self.ids)), np.float32)
        for first in self.edges.tolist():
            span, of = self._span(first)
            column = self.columns[self.at[span]]
            out[column[column >= 0], of[column >= 0]] = self.all[span][column >= 0]
        return out

    @cached_property
    def _postings(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where a feature's postings begin, their examples, rising, and their weights. Made block by
        block, so that sorting takes little beside what is held."""
        rare = self.columns < 0
        sizes = np.bincount(self.at, minlength=len(self.factors)) * rare
        first = np.r_[0, np.cumsum(sizes)].astype(np.int32)
        examples, weights = np.empty(first[-1], np.uint16), np.empty(first[-1], np.float32)
        free = first[:-1].copy()
        for edge in self.edges.tolist():
            span, of = self._span(edge)
            mine = np.flatnonzero(rare[self.at[span]])
            mine = mine[np.argsort(self.at[span][mine], kind="stable")]
            features = self.at[span][mine]
            begin = np.flatnonzero(np.r_[True, features[1:] != features[:-1]][: len(features)])
            held = np.diff(np.r_[begin, len(features)])
            places = _runs(free[features[begin]], held)
            free[features[begin]] += held.astype(np.int32)
            examples[places], weights[places] = of[mine], self.all[span][mine]
        return first, examples, weights

    @property
    def examples(self) -> np.ndarray:
        return self._postings[1]

    @property
    def weights(self) -> np.ndarray:
        return self._postings[2]

    @cached_property
    def _cells(self) -> tuple[np.ndarray, ...]:
        first, examples, _ = self._postings
        keys = np.repeat(np.arange(len(self.factors)), np.diff(first)) * len(self.edges) + examples // self.block
        begin = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
        features, blocks = np.divmod(keys[begin], len(self.edges))
        return np.searchsorted(features, np.arange(len(first))), blocks, np.diff(np.r_[begin, len(keys)]), begin

    @property
    def cells(self) -> np.ndarray:
        """[features + 1]: where a feature's cells begin, which are its postings of a block."""
        return self._cells[0]

    @property
    def blocks(self) -> np.ndarray:
        return self._cells[1]

    @property
    def sizes(self) -> np.ndarray:
        return self._cells[2]

    @property
    def begin(self) -> np.ndarray:
        return self._cells[3]

    @cached_property
    def row(self) -> np.ndarray:
        """[features]: a text's weights while it is compared, else zeros."""
        return np.zeros(len(self.factors), np.float32)

    def lay_out(self) -> None:
        """Make what a search needs, and give back what the making took."""
        self.dense, self._postings, self.row  # noqa: B018
        release()

    def _products(self, examples: np.ndarray) -> np.ndarray:
        """The products of ``row`` with these examples."""
        sizes = self.held[examples]
        spots = _runs(self.starts[examples], sizes)
        terms = self.all.take(spots, mode="clip") * self.row.take(self.at.take(spots, mode="clip"), mode="clip")
        return np.add.reduceat(terms, np.cumsum(sizes) - sizes, dtype=np.float64)

    def nearest_of(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Places and cosines of the ``k`` nearest of each vector; equal ones in the index's order. One
        product for a slice gives what the common words add to each example."""
        found = []
        for at in range(0, len(vectors), PRODUCT):
            part = vectors[at : at + PRODUCT]
            common = np.zeros((len(part), len(self.common)), np.float32)
            for row, (features, weights) in zip(common, part, strict=True):
                column = self.columns[features]
                row[column[column >= 0]] = weights[column >= 0]
            found += [self._nearest(*v, k, sums) for v, sums in zip(part, common @ self.dense, strict=True)]
        return found

    def nearest(self, at: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        return self.nearest_of([(at, weights)], k)[0]

    def _nearest(self, at: np.ndarray, weights: np.ndarray, k: int, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``sums`` are what the common words add to each example; the postings of the others add the rest."""
        first, examples, weight = self._postings
        begin, by = first[at], weights.astype(np.float32)
        sizes = first[at + 1] - begin
        ends = np.cumsum(sizes, dtype=np.int64)
        cuts = np.searchsorted(ends, np.arange(POSTINGS, ends[-1], POSTINGS)) if len(ends) else []
        sums = sums.astype(np.float64)
        for some in map(slice, [0, *cuts], [*cuts, len(at)]):
            spots = _runs(begin[some], sizes[some])
            terms = weight[spots]
            terms *= np.repeat(by[some], sizes[some])
            sums += np.bincount(examples[spots], terms, len(sums))
        # The k-th best of the bests of runs is no more than the k-th best of all.
        bests = np.maximum.reduceat(sums, np.arange(0, len(sums), RUN))
        least = np.partition(bests, -k)[-k] - SLACK if len(bests) >= k else 0.0
        places = np.flatnonzero((sums >= least) & (sums > 0))
        if len(places) > k:
            near = sums[places]
            places = places[near >= np.partition(near, -k)[-k] - SLACK]
        if not len(places):
            return places, np.empty(0)
        self.row[at] = weights
        # Sums of equal numbers in another order are equal.
        best = np.round(self._products(places), 12)
        self.row[at] = 0.0
        nearest = np.lexsort((places, -best))[:k]
        return places[nearest], np.minimum(best[nearest], 1.0)


@dataclass
class Vocabulary:
    """All words of the examples, numbered in their order."""

    words: pa.Array

    def __getstate__(self) -> dict:
        return {"words": self.words}

    @cached_property
    def numbers(self) -> dict[bytes, int]:
        return {w: i for i, w in enumerate(self.words.to_pylist())}

    def numbered(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The features of a text, rising, and how often it has each."""
        words = _words(text)
        numbers = np.fromiter(map(self.numbers.get, words, repeat(-1)), np.int64, len(words))
        return np.unique(numbers[numbers >= 0], return_counts=True)


@dataclass
class Model:
    vocabulary: Vocabulary  # sent to tasks by itself, once
    factors: np.ndarray  # idf * relevance
    index: Index | None
    base: float
    votes: np.ndarray  # of the calibration's points, rising
    rates: np.ndarray
    none: float  # rate of examples without any word
    words: Broadcast | None = None  # of the vocabulary

    def shared(self, spark: SparkSession) -> Callable[[], Model]:
        """What gives the model in a task."""
        words = self.words or spark.sparkContext.broadcast(self.vocabulary)
        rest = spark.sparkContext.broadcast(replace(self, vocabulary=None, words=None))

        def model() -> Model:
            made = rest.value
            if made.vocabulary is None:
                made.vocabulary = words.value
                if made.index is not None:
                    made.vocabulary.numbers  # noqa: B018
                    made.index.lay_out()
            return made

        return model

    def vector(self, at: np.ndarray, tf: np.ndarray) -> np.ndarray:
        weights = (1 + np.log(tf)) * self.factors[at]
        return weights / np.sqrt(np.square(weights).sum()) if len(at) else weights

    def vote(self, places: np.ndarray, cosines: np.ndarray) -> float:
        weights = 1 / (1 - cosines + SOFT)
        prior = 1 / (1 + SOFT)
        return float((weights @ self.index.toxic[places] + prior * self.base) / (weights.sum() + prior))

    def scores(self, texts: list[str | None]) -> list[tuple[float, list]]:
        """The score and the nearest examples of each text; equal texts are compared once."""
        found: dict[str | None, tuple[float, list]] = dict.fromkeys(texts, (self.none, []))
        if self.index is None:
            return [found[text] for text in texts]
        vectors = {}
        for text in found:
            at, tf = self.vocabulary.numbered(text)
            if len(at):
                vectors[text] = at, self.vector(at, tf)
        for text, (places, cosines) in zip(vectors, self.index.nearest_of(list(vectors.values()), NEAREST), strict=True):
            value = float(np.interp(self.vote(places, cosines), self.votes, self.rates))
            found[text] = value, list(zip(self.index.ids[places].tolist(), cosines.tolist(), self.index.toxic[places].tolist(), strict=True))
        return [found[text] for text in texts]


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, text, toxic``: the examples, one for each different text."""
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
        .where(fold(F.col("doc_id"), FOLDS) != HELD_OUT)
        .groupBy("doc_id")
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    )
    # At most EXAMPLES rows of an id and a label.
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(EXAMPLES)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    one = found.groupBy(F.coalesce("text", F.lit("")).alias("text")).agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"))
    return written(one, "toxicity-examples")


def _vocabulary(sample: DataFrame) -> Vocabulary:
    def start():
        def work(text):
            return {"word": list({w for t in text for w in _words(t)})}

        return work

    words = map_slices(sample.select("text"), start, "word binary").distinct().toArrow()["word"].combine_chunks()
    return Vocabulary(words.take(pc.sort_indices(words)))


def _document_frequencies(docs: DataFrame, shared) -> np.ndarray:
    """Over all documents: how many there are, then how many have each feature."""
    size = len(shared.value.words) + 1
    out = pa.schema({"feature": pa.int32(), "n": pa.int64()})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.numbers.get
        counts, rows = np.zeros(size, np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for at in range(0, batch.num_rows, SLICE):
                words = chain.from_iterable(set(_words(t)) for t in batch.column(0).slice(at, SLICE).to_pylist())
                counts += np.bincount(np.fromiter(map(number, words, repeat(-1)), np.int64) + 1, minlength=size)
        # Unknown words were counted where the documents belong.
        counts[0] = rows
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], schema=out)
        release()

    slices = docs.select("text").mapInArrow(count, "feature int, n long")
    found = slices.groupBy("feature").agg(F.sum("n").alias("n")).toArrow()  # a row per feature, and one
    totals = np.zeros(size, np.int64)
    totals[found["feature"].to_numpy()] = found["n"].to_numpy()
    return totals


@dataclass
class Examples:
    """The examples that have words: the features of all, one example after the other."""

    ids: np.ndarray
    toxic: np.ndarray
    part: np.ndarray
    of: np.ndarray  # the example of each feature in ``at``
    at: np.ndarray
    tf: np.ndarray

    def without(self, part: int) -> Examples:
        keep = self.part != part
        if keep.all():
            return self
        number = np.cumsum(keep, dtype=np.int32) - 1
        mine = keep[self.of]
        return Examples(self.ids[keep], self.toxic[keep], self.part[keep], number[self.of[mine]], self.at[mine], self.tf[mine])

    def indexed(self, idf: np.ndarray, base: float, block: int) -> tuple[np.ndarray, Index]:
        """The features' factors and the index of these examples."""
        held = np.bincount(self.at, minlength=len(idf))
        toxic = np.bincount(self.at[self.toxic[self.of] > 0], minlength=len(idf))
        relevance = np.maximum(np.log((toxic + PRIOR * base) / (held + PRIOR) / base), 0.0)
        factors = idf * (relevance + COMMON)
        return factors, _index(self, factors.astype(np.float32), held, block)


def _weights(at: np.ndarray, tf: np.ndarray, of: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Of the words at ``at``, ``tf`` times in the example ``of``, in vectors of length 1."""
    weights = (1 + np.log(tf, dtype=np.float32)) * factors[at]
    weights /= np.sqrt(np.bincount(of, np.square(weights))).astype(np.float32)[of]
    return weights


def _index(rows: Examples, factors: np.ndarray, held: np.ndarray, block: int) -> Index:
    weights = _weights(rows.at, rows.tf, rows.of, factors)
    number = np.arange(len(rows.ids), dtype=np.int32)
    starts = np.searchsorted(rows.of, number).astype(np.int32)

    def first_by(value: np.ndarray) -> np.ndarray:
        largest = np.flatnonzero(value == np.maximum.reduceat(value, starts)[rows.of])
        return rows.at[largest[np.searchsorted(rows.of[largest], number)]]

    # Examples that share their most common word, mostly those of a language, and of these the ones
    # that share their weightiest, stand together, so that sums are added up near each other.
    order = np.lexsort((rows.ids, rows.toxic, first_by(weights), first_by(held.astype(np.int32)[rows.at])))
    del weights
    sizes = np.bincount(rows.of, minlength=len(order))[order]
    spots = _runs(starts[order], sizes)
    common = np.sort(np.argsort(-held, kind="stable")[: min(COMMONEST, int((held > 0).sum()))])
    tf = rows.tf.astype(np.min_scalar_type(rows.tf.max()))[spots]
    return Index(rows.ids[order], rows.toxic[order], sizes.astype(np.int32), rows.at[spots], tf, factors, common, block)


def _rising(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The nearest rising sequence: neighbours that fall are pooled."""
    pools: list[list[float]] = []
    for v, w in zip(values, weights, strict=True):
        pools.append([v, w, 1])
        while len(pools) > 1 and pools[-2][0] > pools[-1][0]:
            v2, w2, n2 = pools.pop()
            v1, w1, n1 = pools.pop()
            pools.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.concatenate([np.full(int(n), v) for v, _, n in pools])


def _examples(rows: pa.Table) -> Examples:
    """At most EXAMPLES rows."""
    lists = {c: rows[c].combine_chunks() for c in ("at", "tf")}
    sizes = lists["at"].value_lengths().to_numpy()
    ids, toxic, part = (rows[c].to_numpy() for c in ("doc_id", "toxic", "part"))
    return Examples(ids, toxic.astype(float), part, np.repeat(np.arange(len(ids), dtype=np.int32), sizes), *(lists[c].flatten().to_numpy() for c in ("at", "tf")))


def _learn(rows: pa.Table, judged: int, vocabulary: Vocabulary, idf: np.ndarray, base: float, block: int) -> tuple[list[float], list[float], bytes]:
    """The votes on a part of the examples by the others, with the labels; for part ``PARTS``, which
    has none, the factors and the index of all."""
    examples = _examples(rows)
    others = examples.without(judged)
    if not len(others.ids):
        return [], [], b""
    mine = np.flatnonzero(examples.part == judged)
    truth = examples.toxic[mine].tolist()
    begin, end = np.searchsorted(examples.of, mine), np.searchsorted(examples.of, mine, "right")
    texts = [(examples.at[i:j].astype(np.int64), examples.tf[i:j].copy()) for i, j in zip(begin, end, strict=True)]
    del examples
    factors, index = others.indexed(idf, base, block)
    if judged == PARTS:
        return [], [], pickle.dumps((factors, index))
    model = Model(vocabulary, factors, index, base, np.empty(0), np.empty(0), base)
    found = index.nearest_of([(at, model.vector(at, tf)) for at, tf in texts], NEAREST)
    return [model.vote(*x) for x in found], truth, b""


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from ``labels(doc_id, toxic)`` of the folds that are not held out."""
    sample = _sample(docs, labels)
    counts = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("n1")).first()
    n, positives = counts["n"], counts["n1"]
    base = positives / n if n else 0.0
    nothing = Vocabulary(pa.array([], pa.binary()))
    empty = Model(nothing, np.empty(0), None, base, np.array([0.0, 1.0]), np.array([base, base]), base)
    if positives in (0, n):
        return empty
    vocabulary = _vocabulary(sample)
    if not len(vocabulary.words):
        return empty
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    df = _document_frequencies(docs, shared)
    idf = np.log((df[0] + 1) / (df[1:] + 1)) + 1

    def start():
        def work(doc_id, text, toxic, part):
            at, tf = zip(*map(shared.value.numbered, text), strict=True)
            return {"doc_id": doc_id, "toxic": toxic, "part": part, "at": [a.tolist() for a in at], "tf": [x.tolist() for x in tf]}

        return work

    dealt = sample.select("doc_id", "text", "toxic", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int").alias("part"))
    numbered = map_slices(dealt, start, "doc_id long, toxic int, part int, at array<int>, tf array<int>")
    vectors = written(numbered.where(F.size("at") > 0), "toxicity-vectors")
    some = vectors.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("n1")).first()
    if not some["n"]:
        return empty

    block = BLOCK
    kinds = {"judged": pa.int32(), "place": pa.int32(), "vote": pa.float64(), "truth": pa.float64(), "packed": pa.binary()}
    out = pa.schema(kinds)

    def learn(rows: pa.Table) -> pa.Table:
        judged = rows["judged"][0].as_py()
        votes, truth, packed = _learn(rows, judged, shared.value, idf, base, block)
        # No row of either side is large.
        chunks = [packed[i : i + CHUNK] for i in range(0, len(packed), CHUNK)]
        count = len(votes) + len(chunks)
        columns = [[judged] * count, list(range(count)), votes + [None] * len(chunks), truth + [None] * len(chunks)]
        table = pa.table([*columns, [None] * len(votes) + chunks], schema=out)
        del rows, packed, chunks
        release()
        return pa.Table.from_batches(table.to_batches(max_chunksize=1 if judged == PARTS else 4096), out)

    # Each index from the same rows, of which there are at most EXAMPLES, in a task of its own.
    times = vectors.withColumn("judged", F.explode(F.array(*[F.lit(i) for i in range(PARTS + 1)])))
    learnt = written(times.groupBy("judged").applyInArrow(learn, "judged int, place int, vote double, truth double, packed binary"), "toxicity-index")
    chunks = {r["place"]: r["packed"] for r in learnt.where(F.col("judged") == PARTS).select("place", "packed").toLocalIterator()}
    factors, index = pickle.loads(b"".join(chunks[i] for i in range(len(chunks))))
    del chunks
    model = Model(vocabulary, factors, index, base, empty.votes, empty.rates, base, shared)
    model.none = (positives - some["n1"] + base) / (n - some["n"] + 1)
    judged = learnt.where(F.col("judged") != PARTS).select("vote", "truth").toArrow()  # a row per example
    votes, truth = (judged[c].to_numpy() for c in ("vote", "truth"))
    if not len(votes):
        return model
    bins = np.minimum((votes * BINS).astype(int), BINS - 1)
    sizes = np.bincount(bins, minlength=BINS)
    used = np.flatnonzero(sizes)
    means = np.bincount(bins, votes, BINS)[used] / sizes[used]
    rates = (np.bincount(bins, truth, BINS)[used] + base) / (sizes[used] + 1)
    model.votes, model.rates = means, _rising(rates, sizes[used].astype(float))
    return model


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted, evidence`` for ``docs(doc_id, text)``.

    ``score`` is the estimated probability of the label, ``evidence`` the nearest examples with
    their cosine and label, the nearest first. A text depends on nothing but its words.

    One row per row. A null, empty or wordless text, or one without any word of an example, has the rate of
    such examples and no evidence; without examples every score is their base rate, 0 if there are
    none. Equal cosines are ordered as in the index. ``doc_id`` is passed through, null is fold 0;
    other columns are not read.
    """

    shared = model.shared(docs.sparkSession)

    def start():
        model = shared()

        def work(doc_id, text):
            scores, evidence = zip(*model.scores(text), strict=True)
            named = [[{"doc_id": i, "similarity": s, "toxic": int(y)} for i, s, y in e] for e in evidence]
            return {"doc_id": doc_id, "score": list(scores), "evidence": named}

        return work

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, score double, evidence array<struct<doc_id:long,similarity:double,toxic:int>>"
    scored = map_slices(docs.select("doc_id", "text"), start, schema)
    return scored.select(
        "doc_id",
        (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        "evidence",
    )


def is_toxic(model: Model, threshold: float = THRESHOLD):
    """The verdict as a column function of the text, for filters that keep a row's other columns."""
    shared = model.shared(SparkSession.active())

    @F.pandas_udf("boolean")
    def verdicts(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            slices = (part[at : at + SLICE].tolist() for at in range(0, len(part), SLICE))
            yield pd.Series([score >= threshold for texts in slices for score, _ in shared().scores(texts)], dtype=bool)
        release()

    return verdicts
