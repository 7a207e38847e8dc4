"""Exact best documents for many weighted queries: postings in blocks, skipped by their largest gains.

Documents are dealt to tasks and taken by length there, longest first, so that those of a block are
alike. A task takes a few hundred documents at a time and the queries in panels. The few terms that
most pairs of a query and a document share are met as two matrices, the many others as products of
one query's weight and one posting's gain, a block's at a time, so that its sums stay in the cache.
The largest gain of each common term in a block of documents, plus the largest sum of the others
there, bounds what a query can score; only queries that may reach their ``k``-th score so far are
multiplied with the block, in single precision. What reaches that score, by more than the rounding
can be, is multiplied again in double precision. Pairs of a query and a document are never
rows; a task passes on its best ``k`` per query.

Queries go to the tasks in chunks of bounded size, one pass over the postings for each.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from copy import copy
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from docloom.sources.tables import written

# Documents of a block, documents taken at once, and numbers in a matrix, at most. A document's
# terms are never cut, so a slice has at least as many postings as the largest has terms.
BLOCK, DOCS, CELLS = 32, 512, 2 << 20
# A product outside of a matrix takes about that many times longer than one inside; a matter of speed.
SHARE = 256
# Bytes of queries that the driver and a task hold at once, about.
CHUNK_BYTES = 48 << 20
# Postings that a task gets, about.
TASK_ROWS = 2_000_000
# Groups of alike queries, the terms that tell them, how often their middles are found anew, and slices
# of documents that are dealt out by them at once.
GROUPS, FEATURES, ROUNDS, HELD = 16, 256, 6, 16
# One document of so many is searched before the others where there are more postings, so that more
# blocks of those are skipped.
FIRST, FIRST_ROWS = 8, 4_000_000
# Scores nearer than this may round alike, so nothing is left out for less.
SLACK = 2e-6


class Panel:
    """Some queries of a chunk: their terms and weights, by term."""

    def __init__(self, first: int, last: int, queries: np.ndarray, terms: np.ndarray, weights: np.ndarray, n_terms: int):
        self.first, self.n = first, last - first
        order = np.lexsort((queries, terms))
        self.queries, self.weights = (queries[order] - first).astype(np.int32), weights[order]
        self.from_term = np.searchsorted(terms[order], np.arange(n_terms + 1)).astype(np.int32)
        self.used = np.diff(self.from_term)

    def spots(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the queries of each term stand, term after term, and how many each term has."""
        begin, sizes = self.from_term[terms], self.used[terms]
        ends = np.cumsum(sizes, dtype=np.int64)
        return np.repeat(begin - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0), sizes

    def rare_part(self, terms: np.ndarray, rows: np.ndarray, gains: np.ndarray, height: int) -> np.ndarray:
        """[documents, queries]: what these postings give, a bounded number of products at a time."""
        out = None
        ends = np.cumsum(self.used[terms], dtype=np.int64)
        cuts = np.unique(np.searchsorted(ends, np.arange(CELLS, ends[-1], CELLS))) if len(ends) else []
        for some in np.split(np.arange(len(terms)), cuts) if len(cuts) else [slice(None)]:
            at, sizes = self.spots(terms[some])
            cells = self.queries[at] + np.repeat(rows[some] * np.int64(self.n), sizes)
            part = np.bincount(cells, self.weights[at] * np.repeat(gains[some], sizes), height * self.n)
            out = part if out is None else out + part
        return out.reshape(height, self.n)


class Queries:
    """A chunk of queries: terms and weights of each, and the best documents so far."""

    def __init__(
        self, queries: np.ndarray, terms: np.ndarray, weights: np.ndarray, n_queries: int, n_terms: int, k: int, summed: bool = False
    ):
        step, order = max(1, CELLS // DOCS), np.argsort(queries, kind="stable")
        edges = np.r_[np.arange(0, n_queries, step), n_queries]
        spans = np.searchsorted(queries[order], edges)
        self.panels = [
            Panel(first, last, queries[mine], terms[mine], weights[mine], n_terms)
            for first, last, mine in zip(edges[:-1], edges[1:], np.split(order, spans[1:-1]), strict=True)
        ]
        self.n_queries, self.n_terms, self.k, self.summed = n_queries, n_terms, k, summed
        self.begin()

    def begin(self, reach: np.ndarray | None = None) -> Queries:
        """Without documents. ``reach``: scores that the queries' k-th hits are known to reach."""
        self.score = np.zeros((self.n_queries, self.k))
        self.doc = np.zeros((self.n_queries, self.k), dtype=np.int64)
        self.reach = np.zeros(self.n_queries) if reach is None else reach.copy()
        # Hits that are not ranked yet.
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        # Pairs of a query and a block of documents that were multiplied, and that were not.
        self.met = self.skipped = 0
        return self

    def add(self, docs: np.ndarray, terms: np.ndarray, rows: np.ndarray, gains: np.ndarray) -> None:
        """Score documents with ``gains`` of ``terms`` at their ``rows``."""
        # One posting for each document and term, the last or all in one, in the documents' order.
        spots = rows * np.int64(self.n_terms) + terms
        if self.summed:
            spots, of = np.unique(spots, return_inverse=True)
            terms, rows, gains = spots % self.n_terms, spots // self.n_terms, np.bincount(of, gains)
        elif not (spots[1:] > spots[:-1]).all():
            last = len(terms) - 1 - np.unique(spots[::-1], return_index=True)[1]
            terms, rows, gains = terms[last], rows[last], gains[last]
        held = np.bincount(terms, minlength=self.n_terms)
        present = np.flatnonzero(held)
        held = held[present]
        column = np.full(self.n_terms, -1, dtype=np.int32)
        blocks = -(-len(docs) // BLOCK)
        for panel in self.panels:
            pairs = held * panel.used[present]
            # The terms that most pairs of a query and a document share are met as matrices.
            often = np.flatnonzero((pairs * SHARE >= panel.n * len(docs)) & (pairs > 0))
            most = max(1, CELLS // max(panel.n, blocks * BLOCK))
            if len(often) > most:
                often = often[np.argsort(-pairs[often], kind="stable")[:most]]
            common = present[often]
            column[common] = np.arange(len(common))
            at = column[terms]
            column[common] = -1
            dense = np.zeros((blocks * BLOCK, len(common)))
            dense[rows[at >= 0], at[at >= 0]] = gains[at >= 0]
            wide = np.zeros((panel.n, len(common)))
            spots, sizes = panel.spots(common)
            wide[panel.queries[spots], np.repeat(np.arange(len(common)), sizes)] = panel.weights[spots]
            rare = np.flatnonzero((at < 0) & (panel.used[terms] > 0))
            self._meet(panel, wide, dense, (terms[rare], rows[rare], gains[rare]), docs)
            self._rank(panel)

    def _meet(self, panel: Panel, wide: np.ndarray, dense: np.ndarray, rare: tuple, docs: np.ndarray) -> None:
        mine = slice(panel.first, panel.first + panel.n)
        largest = dense.reshape(len(dense) // BLOCK, BLOCK, dense.shape[1]).max(axis=1) @ wide.T
        # What rounding to single precision and adding up there can lose of so large a sum, and more.
        loss = largest * ((wide.shape[1] + 4) * 2.0**-22)
        wide_single, dense_single = wide.astype(np.float32), dense.astype(np.float32)
        whole = None
        terms, rows, gains = rare
        edges = np.searchsorted(rows, np.arange(0, len(dense) + 1, BLOCK))
        for b in range(len(largest)):
            here = docs[b * BLOCK : (b + 1) * BLOCK]
            span, some = slice(b * BLOCK, b * BLOCK + len(here)), slice(edges[b], edges[b + 1])
            others = panel.rare_part(terms[some], rows[some] - b * BLOCK, gains[some], len(here))
            bound = largest[b] + others.max(axis=0)
            reach = self.reach[mine] - SLACK
            met = np.flatnonzero((bound >= reach) & (bound > 0))
            self.met += len(met)
            self.skipped += panel.n - len(met)
            if not len(met):
                continue
            # Large products are faster by the number, so where many queries are met all are, and all blocks.
            if whole is None and 3 * len(met) >= panel.n:
                whole = dense_single @ wide_single.T
            if whole is not None and 6 * len(met) >= panel.n:
                met = np.arange(panel.n)
                about = others + whole[span]
            else:
                others = others[:, met]
                about = others + dense_single[span] @ wide_single[met].T
            lost, reach = loss[b, met], reach[met]
            row, at = np.divmod(np.flatnonzero(about >= reach - lost), len(met))
            if len(row) > 2 * self.k * len(met) and len(here) > self.k:
                # Many hits, as at the beginning: the k-th here is reached, too.
                kth = np.partition(about, len(here) - self.k, axis=0)[len(here) - self.k] - lost
                row, at = np.divmod(np.flatnonzero(about >= np.maximum(reach, kth - SLACK) - lost), len(met))
            if len(row) * 40 > about.size:
                exact = (dense[span] @ wide[met].T)[row, at]
            else:
                exact = np.einsum("ij,ij->i", dense[span][row], wide[met[at]])
            if len(row):
                self._keep(panel, met[at], exact + others[row, at], here[row])

    def _keep(self, panel: Panel, queries: np.ndarray, score: np.ndarray, docs: np.ndarray) -> None:
        queries = queries + panel.first
        # No score is no document.
        better = (score >= self.reach[queries] - SLACK) & (score > 0)
        self.waiting.append((queries[better], score[better], docs[better]))
        if sum(len(q) for q, *_ in self.waiting) > panel.n * self.k:
            self._rank(panel)

    def _rank(self, panel: Panel) -> None:
        if not self.waiting:
            return
        queries, score, docs = (np.concatenate(x) for x in zip(*self.waiting, strict=True))
        self.waiting = []
        changed = np.unique(queries)
        queries = np.concatenate([np.repeat(changed, self.k), queries])
        score = np.concatenate([self.score[changed].ravel(), score])
        docs = np.concatenate([self.doc[changed].ravel(), docs])
        # As they will be ranked: rounded, then by document.
        order = np.lexsort((docs, np.where(score > 0, -np.round(score, 6), 1), queries))
        starts = np.searchsorted(queries[order], changed)
        first = order[(starts[:, None] + np.arange(self.k)).ravel()].reshape(-1, self.k)
        self.score[changed], self.doc[changed] = score[first], docs[first]
        self.reach[changed] = np.maximum(self.reach[changed], self.score[changed].min(axis=1))


def _whole_documents(batches: Iterator[pa.RecordBatch], number: dict | np.ndarray) -> Iterator[tuple]:
    """Postings sorted by document, as arrays of a few hundred whole documents' known terms.

    ``number`` has the place of each term, or is all terms in order where terms are numbers themselves.
    """
    held: list[tuple] = []
    size = docs = 0
    last = None

    def joined() -> tuple:
        doc, term, gain = (np.concatenate(c) for c in zip(*held, strict=True))
        starts = np.r_[True, doc[1:] != doc[:-1]]
        return doc[starts], term, np.cumsum(starts) - 1, gain

    for batch in batches:
        doc, gain = batch.column(0).to_numpy(), batch.column(2).to_numpy()
        if isinstance(number, dict):
            term = np.fromiter((number.get(t, -1) for t in batch.column(1).to_pylist()), dtype=np.int64, count=len(doc))
        else:
            given = batch.column(1).to_numpy()
            term = np.searchsorted(number, given)
            term[number[np.minimum(term, len(number) - 1)] != given] = -1
        doc, term, gain = doc[term >= 0], term[term >= 0], gain[term >= 0]
        if not len(doc):
            continue
        begins = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        for a, b in zip(begins, np.r_[begins[1:], len(doc)], strict=True):
            new = doc[a] != last
            if new and (docs >= DOCS or size and size + b - a > CELLS // 4):
                yield joined()
                held, size, docs = [], 0, 0
            held.append((doc[a:b], term[a:b], gain[a:b]))
            size, docs, last = size + b - a, docs + new, doc[a]
    if held:
        yield joined()


class Groups:
    """Groups of alike queries, by the terms that most of them have; a matter of speed."""

    def __init__(self, queries: np.ndarray, terms: np.ndarray, n_queries: int, n_terms: int):
        often = np.argsort(-np.bincount(terms, minlength=n_terms), kind="stable")[:FEATURES]
        self.column = np.full(n_terms, -1, dtype=np.int32)
        self.column[often] = np.arange(len(often))
        # A bounded number of queries, evenly spaced, tells the middles.
        step = max(1, CELLS // FEATURES)
        some = queries % -(-n_queries // step) == 0
        known = self._features(queries[some] // -(-n_queries // step), terms[some], min(step, n_queries))
        middles = known[np.linspace(0, len(known) - 1, GROUPS).astype(int)]
        for _ in range(ROUNDS):
            nearest = (known @ middles.T).argmax(axis=1)
            sums = np.stack([known[nearest == g].sum(axis=0) for g in range(GROUPS)])
            middles = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
        self.middles = middles.astype(np.float32)

    def _features(self, rows: np.ndarray, terms: np.ndarray, height: int) -> np.ndarray:
        out = np.zeros((height, int(self.column.max()) + 1), dtype=np.float32)
        held = self.column[terms] >= 0
        out[rows[held], self.column[terms[held]]] = 1
        return out / np.maximum(np.sqrt(out.sum(axis=1, keepdims=True)), 1)

    def of(self, rows: np.ndarray, terms: np.ndarray, height: int) -> np.ndarray:
        """The group of each row; ``rows`` are in order."""
        step = max(1, CELLS // FEATURES)
        edges = np.arange(0, height + step, step)
        spans = np.searchsorted(rows, edges)
        parts = [
            (self._features(rows[a:b] - first, terms[a:b], min(step, height - first)) @ self.middles.T).argmax(axis=1)
            for first, a, b in zip(edges[:-1], spans[:-1], spans[1:], strict=True)
            if first < height
        ]
        return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)

    def alike(self, slices: Iterator[tuple]) -> Iterator[tuple]:
        """The documents of several slices again, dealt anew by their groups, those with many terms first."""
        held: list[tuple] = []
        for docs, terms, rows, gains in slices:
            if held and (len(held) >= HELD or sum(len(t) for _, t, *_ in held) + len(terms) > CELLS // 2):
                yield from self._dealt(held)
                held = []
            held.append((docs, terms, rows, gains))
        if held:
            yield from self._dealt(held)

    def _dealt(self, held: list[tuple]) -> Iterator[tuple]:
        firsts = np.cumsum([0] + [len(docs) for docs, *_ in held])
        docs, terms, gains = (np.concatenate([h[i] for h in held]) for i in (0, 1, 3))
        rows = np.concatenate([h[2] + first for h, first in zip(held, firsts, strict=False)])
        sizes = np.bincount(rows, minlength=len(docs))
        order = np.lexsort((-sizes, self.of(rows, terms, len(docs))))
        place = np.empty(len(docs), dtype=np.int64)
        place[order] = np.arange(len(docs))
        rows = place[rows]
        by_row = np.lexsort((terms, rows))
        docs, terms, rows, gains = docs[order], terms[by_row], rows[by_row], gains[by_row]
        edges = np.arange(0, len(docs), DOCS)
        spans = np.r_[np.searchsorted(rows, edges), len(rows)]
        for first, a, b in zip(edges, spans[:-1], spans[1:], strict=True):
            yield docs[first : first + DOCS], terms[a:b], rows[a:b] - first, gains[a:b]


def _asked(lists: pa.Table, k: int, summed: bool) -> tuple:
    """A chunk's queries: their ids, its terms, the queries by number and their groups."""
    ids, terms, weights = (lists.column(c).combine_chunks() for c in range(3))
    queries = np.repeat(np.arange(len(ids)), terms.value_lengths().to_numpy())
    terms, weights = terms.flatten(), weights.flatten().to_numpy()
    if pa.types.is_integer(terms.type):
        known, terms = np.unique(terms.to_numpy(), return_inverse=True)
    else:
        terms = terms.dictionary_encode()
        known, terms = {t: i for i, t in enumerate(terms.dictionary.to_pylist())}, terms.indices.to_numpy()
    groups = Groups(queries, terms, len(ids), len(known))
    order = np.argsort(groups.of(queries, terms, len(ids)), kind="stable")
    place = np.empty(len(ids), dtype=np.int64)
    place[order] = np.arange(len(ids))
    names = ids.take(pa.array(order)).to_pylist()
    return names, known, Queries(place[queries], terms, weights, len(ids), len(known), k, summed), groups


def dealt(postings: DataFrame, rows: int, order: Sequence[str] = ("dl", "doc_id")) -> DataFrame:
    """Whole documents in tasks of about TASK_ROWS of the ``rows``, longest first."""
    tasks = max(postings.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))
    return postings.repartition(tasks, "doc_id").sortWithinPartitions(*[F.col(c).desc() if c == "dl" else F.col(c) for c in order])


def best_in_blocks(postings: DataFrame, weighed: DataFrame, k: int, qid: str = "qid", summed: bool = False, laid_out: bool = False) -> DataFrame:
    """``qid, doc_id, part``: for each query the best ``k`` documents of each task.

    ``postings`` is a written ``doc_id, term, gain, dl`` with one row per document and term,
    ``weighed`` a written ``qid, term, w``, one row per query and term, all terms being among those
    of the postings; gains and weights are positive. ``part`` is the sum of weight times gain. Terms
    may be numbers that stand for them, which are taken to the tasks faster. ``laid_out`` postings were
    written as ``dealt`` gives them.

    Where there are many postings, one document of FIRST is searched before the others, which then
    know a score that each query's k-th hit reaches.

    With ``summed`` a document may have several postings of a term, also of several lengths, which
    add up: then blocks are taken by ``doc_id`` alone, and are less alike.
    """
    spark = postings.sparkSession
    long = F.octet_length("term") if weighed.schema["term"].dataType.simpleString() == "string" else F.lit(0)
    size = weighed.agg(F.sum(long.cast("long") + 16).alias("bytes")).first()["bytes"] or 0
    chunks = max(1, -(-size // CHUNK_BYTES))
    rows = postings.count()
    ranged = postings if laid_out else dealt(postings, rows, ["doc_id"] if summed else ["dl", "doc_id"])
    rounds = [F.lit(True)]
    if rows > FIRST_ROWS:
        first = F.pmod(F.xxhash64("doc_id"), F.lit(FIRST)) == 0
        rounds = [first, ~first]
    # Written once if it is read by several passes.
    ranged = ranged.select("doc_id", "term", "gain")
    ranged = written(ranged, "ranged-postings") if chunks * len(rounds) > 1 and not laid_out else ranged
    lists = weighed.groupBy(qid).agg(F.collect_list(F.struct("term", "w")).alias("_terms"))
    lists = lists.select(qid, F.col("_terms.term").alias("terms"), F.col("_terms.w").alias("ws"))
    lists = written(lists, "query-lists") if chunks > 1 else lists
    fields = StructType([weighed.schema[qid], StructField("doc_id", postings.schema["doc_id"].dataType), *StructType.fromDDL("part double")])
    arrow = to_arrow_schema(fields)
    parts = []
    for chunk in range(chunks):
        mine = lists.where(F.pmod(F.xxhash64(qid), F.lit(chunks)) == chunk).toArrow()
        if not mine.num_rows:
            continue
        asked = _asked(mine, k, summed)
        sent = spark.sparkContext.broadcast(asked)
        reach = None
        for some in rounds:

            def run(batches: Iterator[pa.RecordBatch], sent=sent, reach=reach) -> Iterator[pa.RecordBatch]:
                names, known, queries, groups = sent.value
                queries = copy(queries).begin(None if reach is None else reach.value)
                for docs, terms, rows, gains in groups.alike(_whole_documents(batches, known)):
                    queries.add(docs, terms, rows, gains)
                q, place = np.nonzero(queries.score > 0)
                columns = (pa.array([names[i] for i in q], type=arrow[0].type), pa.array(queries.doc[q, place], type=arrow[1].type), pa.array(queries.score[q, place]))
                yield pa.RecordBatch.from_arrays(list(columns), schema=arrow)

            best = ranged.where(some).mapInArrow(run, fields)
            several = chunks * len(rounds) > 1
            parts.append(written(best, "chunk-hits") if several else best)
            if some is not rounds[-1]:
                reach = spark.sparkContext.broadcast(_reached(parts[-1], asked[0], k, qid))
    if not parts:
        return spark.createDataFrame([], fields)
    return reduce(DataFrame.unionByName, parts)


def _reached(hits: DataFrame, names: list, k: int, qid: str) -> np.ndarray:
    """The k-th best score so far of each query, 0 where there are fewer hits."""
    lowest = hits.groupBy(qid).agg(F.get(F.sort_array(F.collect_list("part"), asc=False), k - 1).alias("reach"))
    found = lowest.where("reach is not null").toArrow()
    known = dict(zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True))
    return np.array([known.get(name, 0.0) for name in names])
