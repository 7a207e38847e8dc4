"""Near-duplicates by b-bit MinHash.

A document's set of word shingles is summed up in ``HASHES`` minima. Hashes of four minima each
are its band keys; of every minimum the low two bits are kept, packed in ``LANES`` longs. Documents
that share a band key are candidates; the packed bits estimate their similarity, corrected for bits
that agree by chance; what may be similar enough is confirmed on the full sets, made from the texts.

Only components are asked for, so not all pairs are looked at, and yet no link that matters is lost:
1. Documents with equal sets are one node.
2. Each node meets the smallest node of each of its bands. The best estimated of these links is
   confirmed. This joins large groups of copies with one link per document.
3. Bands whose nodes are all in one component by now can show nothing new. In the others each node
   outside the band's largest component meets the nodes of other components, in cells of bounded
   size: a task estimates all pairs of a cell by their bits, confirms what may be similar enough on
   the full sets, and passes on no more links than join the cell's components. So pairs are never
   rows, however many texts share a part.

Two documents at 0.75 share no band with a probability of 2.5e-7. An estimate that far below is
over six standard deviations off.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docloom.llm.common import SLICE, ascii_words, map_slices, release
from docloom.sources.tables import written

SHINGLE = 5
NUM, DEN = 75, 100
BANDS, ROWS = 40, 4
HASHES = BANDS * ROWS
BITS = 2
LANES = HASHES * BITS // 64
# Distinct words whose hashes a task remembers.
TABLE = 1_000_000
# Nodes of a band that is one cell; nodes of a slice of a larger one, whose cells have two slices.
SMALL, CELL = 64, 256
# Shingles that a task compares at once.
COLUMNS = 4096

_EVEN_BITS = 0x5555555555555555
# Chance of two unrelated minima to agree in their low bits.
_CHANCE = 2.0**-BITS
# Estimates below this are not confirmed.
_AGREE = _CHANCE + (1 - _CHANCE) * NUM / DEN
PLAUSIBLE = NUM / DEN - 6 * (_AGREE * (1 - _AGREE) / HASHES) ** 0.5 / (1 - _CHANCE)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= TABLE:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads every bit of 64 over all."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@cache
def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(2026)
    a = random.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, random.integers(0, 2**63, HASHES, dtype=np.uint64)


def shingles(text: str | None, hashes: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = ascii_words(text)
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(SHINGLE, len(w))
    out = np.full(len(w) - size + 1, size, np.uint64)
    for i in range(size):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + w[i : len(w) - size + 1 + i])
    return np.unique(out)


def _minima(found: np.ndarray) -> np.ndarray:
    a, b = _multipliers()
    lowest = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    # The high half of a product is well mixed; blocks keep long texts from needing much memory.
    for at in range(0, len(found), 2048):
        part = found[at : at + 2048]
        np.minimum(lowest, (a[:, None] * part[None, :] + b[:, None]).min(axis=1), out=lowest)
    return _mixed(lowest)


def _signed(x: np.ndarray) -> list[int]:
    return x.view(np.int64).tolist()


def _signature(found: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """Two hashes of the set, its band keys, its packed low bits."""
    if not len(found):
        return [0, 0], [], []
    whole = xxhash.xxh128(found.tobytes()).intdigest()
    minima = _minima(found)
    keys = np.arange(BANDS, dtype=np.uint64)
    for row in minima.reshape(BANDS, ROWS).T:
        keys = _mixed(keys * np.uint64(0x9E3779B97F4A7C15) + row)
    low = (minima & np.uint64(2**BITS - 1)).reshape(LANES, 64 // BITS)
    packed = (low << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))).sum(axis=1, dtype=np.uint64)
    halves = np.array([whole & (2**64 - 1), whole >> 64], np.uint64)
    return _signed(halves), _signed(keys), _signed(packed)


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, set0, set1, bands, bits``, one row per row of ``docs(doc_id, text)``."""

    def start():
        hashes = _WordHashes()

        def work(doc_id, text):
            sets = [shingles(t, hashes) for t in text]
            wholes, bands, bits = zip(*map(_signature, sets), strict=True)
            return {
                "doc_id": doc_id,
                "n_shingles": list(map(len, sets)),
                "set0": [w[0] for w in wholes],
                "set1": [w[1] for w in wholes],
                "bands": list(bands),
                "bits": list(bits),
            }

        return work

    schema = "doc_id long, n_shingles long, set0 long, set1 long, bands array<long>, bits array<long>"
    return map_slices(docs.select(F.col("doc_id").cast("long"), "text"), start, schema)


def estimate(a: Column, b: Column) -> Column:
    """Similarity by the number of agreeing low bits, less those that agree by chance."""

    def differing(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        return F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseAND(F.lit(_EVEN_BITS)))

    off = reduce(lambda s, c: s + c, [differing(a[i], b[i]) for i in range(LANES)])
    return ((1 - off / HASHES) - _CHANCE) / (1 - _CHANCE)


def confirm(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of ``pairs(a, b)`` whose full sets are similar enough.

    The smaller side's text stands by each of its partners, next to each other, so its set is made
    once. A node with very many partners is split over tasks by Spark's skew join.
    """
    texts = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("_id"), F.col("text").alias("_text"))
    with_b = pairs.join(texts, F.col("b") == F.col("_id")).select("a", "b", F.col("_text").alias("text_b"))
    both = with_b.join(texts, F.col("a") == F.col("_id")).select("a", "b", F.col("_text").alias("text_a"), "text_b")

    def start():
        hashes = _WordHashes()
        last: list = [None, None]

        def work(a, b, text_a, text_b):
            out: dict[str, list] = {"a": [], "b": []}
            for i, j, s, t in zip(a, b, text_a, text_b, strict=True):
                if last[0] is None or last[0] != s:
                    last[:] = s, shingles(s, hashes)
                x, y = last[1], shingles(t, hashes)
                shared = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                if shared and DEN * shared >= NUM * (len(x) + len(y) - shared):
                    out["a"].append(i)
                    out["b"].append(j)
            return out

        return work

    return map_slices(both, start, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """``node, comp`` for the nodes of ``links(a, b)``: the smallest node that can be reached.

    Every node takes on its smallest neighbour if that is smaller, links are led over to it, and
    so on until no link is left. Each round's tables are written; none is gathered by node.
    """
    edges = written(
        links.where("a <> b")
        .select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
        .distinct(),
        "links",
    )
    labels = written(edges.select("hi").union(edges.select("lo")).distinct().select(F.col("hi").alias("node"), F.col("hi").alias("comp")), "labels")
    while not edges.isEmpty():
        to = written(edges.groupBy("hi").agg(F.min("lo").alias("to")), "hooks")

        def led(df: DataFrame, column: str, to: DataFrame = to) -> DataFrame:
            hook = to.select(F.col("hi").alias("_from"), F.col("to").alias("_to"))
            return df.join(hook, F.col(column) == F.col("_from"), "left").withColumn(column, F.coalesce("_to", column)).drop("_from", "_to")

        labels = written(led(labels, "comp"), "labels")
        moved = led(led(edges, "hi"), "lo").where("hi <> lo")
        edges = written(moved.select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo")).distinct(), "links")
    return labels


def _labelled(df: DataFrame, labels: DataFrame, node: str, name: str) -> DataFrame:
    """``df`` with the component of ``node``, the node itself where it has no link yet."""
    known = labels.select(F.col("node").alias("_node"), F.col("comp").alias("_comp"))
    return df.join(known, F.col(node) == F.col("_node"), "left").withColumn(name, F.coalesce("_comp", node)).drop("_node", "_comp")


def _best(pairs: DataFrame) -> DataFrame:
    """The best estimated pair of each ``b``."""
    return pairs.groupBy("b").agg(F.min_by("a", F.struct((-F.col("est")).alias("e"), "a")).alias("a")).select("a", "b")


def _rated(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs(a, b)`` with ``est``, those that are plausible."""
    bits = sets.select(F.col("node").alias("_n"), "bits")
    one = pairs.join(bits, F.col("a") == F.col("_n")).select("a", "b", F.col("bits").alias("bits_a"))
    two = one.join(bits, F.col("b") == F.col("_n")).select("a", "b", "bits_a", F.col("bits").alias("bits_b"))
    rated = two.select("a", "b", estimate(F.col("bits_a"), F.col("bits_b")).alias("est"))
    return rated.groupBy("a", "b").agg(F.max("est").alias("est")).where(F.col("est") >= PLAUSIBLE)


def _mixed_rows(sets: DataFrame, active: DataFrame, labels: DataFrame) -> DataFrame | None:
    """``key, i, j, node, comp, bits``: the nodes of bands with several components, in cells.

    A small band is one cell, without the nodes that by their bits are near no other component's;
    bands of which the same nodes are left are one. A larger band's nodes are cut in slices, and
    so are those outside its largest component; cell (i, j) holds slice i of the outer ones and
    slice j of all. None if every band has one component.
    """
    held = sets.join(active, "node", "left_semi").select("node", "bands", "bits")
    rows = written(
        _labelled(held, labels, "node", "comp").select(F.explode("bands").alias("key"), "node", "comp", "bits"),
        "band-rows",
    )
    sizes = rows.groupBy("key", "comp").agg(F.count("*").alias("n"))
    main = F.max(F.struct("n", "comp"))
    mixed = written(
        sizes.groupBy("key")
        .agg(main["comp"].alias("main"), F.sum("n").alias("n"), (F.sum("n") - main["n"]).alias("outer"), F.count("*").alias("comps"))
        .where("comps > 1")
        .select("key", "main", "n", F.ceil(F.col("n") / CELL).alias("slices"), F.ceil(F.col("outer") / CELL).alias("outers")),
        "mixed-bands",
    )
    if mixed.isEmpty():
        return None

    def near(x: Column, y: Column) -> Column:
        return (x["comp"] != y["comp"]) & (estimate(x["bits"], y["bits"]) >= PLAUSIBLE)

    gathered = (
        rows.join(mixed.where(F.col("n") <= SMALL).select("key"), "key")
        .groupBy("key")
        .agg(F.array_sort(F.collect_list(F.struct("node", "comp", "bits"))).alias("m"))
        .select(F.filter("m", lambda x: F.exists("m", lambda y: near(x, y))).alias("m"))
        .where(F.size("m") > 0)
        .distinct()
    )
    zero = F.lit(0).cast("long")
    small = gathered.select(F.xxhash64("m.node").alias("key"), zero.alias("i"), zero.alias("j"), F.inline("m"))

    def every(i: Column | None, j: Column | None) -> Column:
        """The cells of one row or column."""
        over = F.sequence(zero, F.col("slices" if j is None else "outers") - 1)
        return F.transform(over, lambda x: F.struct((x if i is None else i).alias("i"), (x if j is None else j).alias("j")))

    mine = F.pmod(F.xxhash64("node"), F.col("slices"))
    outer = F.pmod(F.xxhash64("node", F.lit(1)), F.col("outers"))
    cells = F.when(F.col("comp") == F.col("main"), every(None, mine)).otherwise(F.array_union(every(None, mine), every(outer, None)))
    large = rows.join(mixed.where(F.col("n") > SMALL), "key").select("key", F.inline(cells), "node", "comp", "bits")
    return small.unionByName(large.select(*small.columns))


def _agreement(bits: np.ndarray) -> np.ndarray:
    """The estimate of similarity for all pairs of rows of packed bits."""
    off = np.zeros((len(bits), len(bits)))
    for lane in bits.T.astype(np.uint64):
        d = lane[:, None] ^ lane[None, :]
        off += np.bitwise_count((d | (d >> np.uint64(1))) & np.uint64(_EVEN_BITS))
    return ((1 - off / HASHES) - _CHANCE) / (1 - _CHANCE)


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each pair of sets has in common."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, number, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # What only one set has is in no intersection.
    owner, number = owner[times[number] > 1], number[times[number] > 1]
    number = np.unique(number, return_inverse=True)[1]
    order = np.argsort(number, kind="stable")
    owner, number = owner[order], number[order]
    out = np.zeros((len(sets), len(sets)))
    width = number[-1] + 1 if len(number) else 0
    for at in range(0, width, COLUMNS):
        span = slice(*np.searchsorted(number, [at, at + COLUMNS]))
        held = np.zeros((len(sets), min(COLUMNS, width - at)), np.float32)
        held[owner[span], number[span] - at] = 1
        out += held @ held.T
    return out


def _cell_links(node: np.ndarray, comp: np.ndarray, bits: np.ndarray, texts: list, hashes: _WordHashes) -> list[tuple[int, int]]:
    """Links of a cell's nodes that join different components, as few as tell which."""
    maybe = np.triu((_agreement(bits) >= PLAUSIBLE) & (comp[:, None] != comp[None, :]))
    used = np.flatnonzero(maybe.any(axis=0) | maybe.any(axis=1))
    if not len(used):
        return []
    sets = [shingles(texts[i], hashes) for i in used]
    size = np.array([len(x) for x in sets])
    shared = _shared(sets)
    linked = maybe[np.ix_(used, used)] & (shared > 0) & (DEN * shared >= NUM * (size[:, None] + size[None, :] - shared))
    up = {c: c for c in comp.tolist()}

    def top(c: int) -> int:
        while up[c] != c:
            up[c] = c = up[up[c]]
        return c

    out = []
    for x, y in zip(*(used[i] for i in np.nonzero(linked)), strict=True):
        p, q = top(int(comp[x])), top(int(comp[y]))
        if p != q:
            up[max(p, q)] = min(p, q)
            out.append((int(node[x]), int(node[y])))
    return out


def _links_of_cells(rows: DataFrame) -> DataFrame:
    """``a, b`` from ``key, i, j, node, comp, bits, text``; a task takes one cell after the other."""
    arrow = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        cell: list[tuple] = []
        links: list[tuple[int, int]] = []

        def finish() -> None:
            if cell:
                _, _, _, node, comp, bits, texts = zip(*cell, strict=True)
                links.extend(_cell_links(np.array(node), np.array(comp), np.array(bits, np.int64).view(np.uint64), texts, hashes))
                cell.clear()

        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if cell and cell[0][:3] != row[:3]:
                    finish()
                cell.append(row)
            if len(links) > SLICE:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*links, strict=True)], schema=arrow)
                links.clear()
        finish()
        if links:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*links, strict=True)], schema=arrow)
        del hashes, links
        release()

    cells = ["key", "i", "j"]
    dealt = rows.select(*cells, "node", "comp", "bits", "text").repartition(*cells).sortWithinPartitions(*cells)
    return dealt.mapInArrow(run, StructType.fromDDL("a long, b long"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for ``docs(doc_id, text)``.

    Words, lower-cased A-Z, stand between ASCII white space. The set of a text is its distinct
    5-word shingles, or all its words as one if it has fewer. Documents are linked if they share at
    least 75 of 100 of what either has; ``component_id`` is the smallest ``doc_id`` that links
    lead to, and that one is ``kept``.

    One row per row. A null, empty or blank text has no shingles and no links. Equal texts are
    linked. Rows that repeat a ``doc_id`` are one document with the links of each; a null
    ``doc_id`` is linked with nothing, has a null component and is kept. No documents, no rows;
    other columns are not read. Signatures, candidates and components become scratch tables.
    """
    signed = written(signatures(docs), "signatures")
    usable = signed.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    sets = written(
        usable.groupBy("set0", "set1")
        .agg(F.min("doc_id").alias("node"), F.min_by(F.struct("bands", "bits"), "doc_id").alias("_s"))
        .select("set0", "set1", "node", "_s.*"),
        "sets",
    )
    # A repeated document is a node of each of its sets.
    members = written(usable.join(sets.select("set0", "set1", "node"), ["set0", "set1"]).select("doc_id", "node").distinct(), "members")
    copies = members.where("doc_id <> node").select(F.col("node").alias("a"), F.col("doc_id").alias("b"))
    # Copies only count as links where a document has several sets; else the node stands for them.
    several = written(members.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "several")
    extra = copies.join(several, copies["b"] == several["doc_id"], "left_semi")

    rows = sets.select(F.explode("bands").alias("key"), "node")
    heads = written(
        rows.groupBy("key").agg(F.min("node").alias("head"), F.count("*").alias("n")).where("n > 1").select("key", "head"), "band-heads"
    )
    star = written(rows.join(heads, "key").where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct(), "star-links")
    rated = written(_rated(star, sets), "rated-links")
    tried = written(_best(rated), "tried-links")
    found = written(confirm(tried, docs).unionByName(extra), "confirmed-links")
    labels = components(found)
    active = written(star.select(F.col("a").alias("node")).union(star.select("b")).distinct(), "active-nodes")
    cells = _mixed_rows(sets, active, labels)
    if cells is not None:
        texts = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("_id"), "text")
        spelled = cells.join(texts, F.col("node") == F.col("_id")).drop("_id")
        found = written(found.unionByName(_links_of_cells(spelled).distinct()), "confirmed-links")
        labels = components(found)
    per_doc = _labelled(members, labels, "node", "component_id").select(F.col("doc_id").alias("_doc"), "component_id")
    per_doc = per_doc.groupBy("_doc").agg(F.min("component_id").alias("component_id"))
    counted = signed.select("doc_id", "n_shingles")
    out = counted.join(per_doc, counted["doc_id"] == per_doc["_doc"], "left").drop("_doc")
    component = F.coalesce("component_id", "doc_id")
    return out.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
    )
