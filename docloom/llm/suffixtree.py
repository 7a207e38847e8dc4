"""Language-model scores by a probabilistic suffix tree.

The model's root is the distribution of single tokens, smoothed by half a count. Its states are
contexts of one to three tokens. A context is a candidate if it occurs at least ``CONTEXT`` times the
root of the number of training tokens; it is retained if what follows it diverges from what follows
its suffix by more than chance explains, together with all its suffixes. Next tokens that follow the
context ``PAIR`` times that root or more have a discounted probability of their own; the discount and
the mass of the others go to the suffix. The longest retained suffix of what stands before a token is
its state.

So the tree grows with the corpus, though slower: by the root of N tokens there are at most
sqrt(N) / CONTEXT contexts of a length and sqrt(N) / PAIR pairs, and every count that decides rises
with the noise of the counts. The tree goes to every task: for 10^11 tokens at most 8 million contexts
of a length, and in natural text far fewer. The counts of all distinct tokens do not: tokens that
occur ``SYMBOL`` times that root or more go along, the rest, of which a text has few, meet their
counts by a join on hashes. As rare tokens have no probability of their own in any state, a state
only multiplies their root probability, and the two parts of a text's score add up.

Texts are read twice: once to count tokens, once to write them as numbers, which the counting of
contexts and the scoring read. Every count is summed up in each task before it is shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docloom.llm.common import SLICE, fold
from docloom.sources.tables import written

FOLDS, HELD_OUT = 5, 1
LENGTH = 3
# Least counts of contexts, of pairs and of symbols, as multiples of the root of all tokens.
CONTEXT, PAIR, SYMBOL = 0.04, 0.002, 0.003
DISCOUNT = 0.75
# Standard deviations of chi-square by which a divergence must exceed its mean.
DEVIATIONS = 5.0
# Words whose codes a task remembers, whose counts it holds, and followers that it holds.
TABLE, HELD, HELD_KEYS = 1_000_000, 500_000, 4_000_000


def _hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) >> 1


# No word has white space in it.
_END = _hash(b"\n")


class _Codes(dict):
    """Word to the number of its symbol, or, if it is none, to -1 less its hash."""

    def __init__(self, hashes: np.ndarray):
        self.symbols = {h: i for i, h in enumerate(hashes.tolist())}

    def __missing__(self, word: bytes) -> int:
        if len(self) >= TABLE:
            self.clear()
        h = _hash(word)
        value = self[word] = self.symbols.get(h, -1 - h)
        return value


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of keys in a sorted array, -1 where it has none."""
    if not len(sorted_keys):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, at, -1)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


_COUNTS = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("train", pa.int64())])


def _token_counts(docs: DataFrame) -> DataFrame:
    """``key, n, train``: how often each token occurs, in all and in training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, Counter] = {True: Counter(), False: Counter()}

        def flush() -> pa.RecordBatch:
            words = list(held[False].keys() | held[True].keys())
            train = [held[False][w] for w in words]
            n = [t + held[True][w] for t, w in zip(train, words, strict=True)]
            held[True].clear()
            held[False].clear()
            return pa.RecordBatch.from_arrays([pa.array(map(_hash, words), pa.int64()), pa.array(n), pa.array(train)], schema=_COUNTS)

        for part in _slices(batches):
            for text, out in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                held[out].update((text or b"").lower().split())
                held[out][b"\n"] += 1
            if len(held[False]) + len(held[True]) >= HELD:
                yield flush()
        yield flush()

    raw = docs.select(F.col("text").cast("binary"), "held_out")
    parts = raw.mapInArrow(run, StructType.fromDDL("key long, n long, train long"))
    return parts.groupBy("key").agg(F.sum("n").alias("n"), F.sum("train").alias("train"))


def _coded(docs: DataFrame, hashes: np.ndarray) -> DataFrame:
    """``row, doc_id, held_out, symbols, rare``: each text as symbols, -1 where a token is none,
    the end included, and the hashes of those that are none. Later passes read no texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes(hashes)
        for part in _slices(batches):
            words = [[*(t or b"").lower().split(), b"\n"] for t in part.column(3).to_pylist()]
            lengths = np.fromiter(map(len, words), np.int64, len(words))
            flat = np.fromiter(map(codes.__getitem__, chain.from_iterable(words)), np.int64, int(lengths.sum()))
            rare = flat < 0
            ends = np.r_[0, np.cumsum(lengths)]
            below = np.r_[0, np.cumsum(rare)][ends]
            symbols = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.where(rare, -1, flat), pa.int32()))
            others = pa.ListArray.from_arrays(pa.array(below, pa.int32()), pa.array(-1 - flat[rare], pa.int64()))
            names = ["row", "doc_id", "held_out", "symbols", "rare"]
            yield pa.RecordBatch.from_arrays([*part.columns[:3], symbols, others], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    raw = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", F.col("text").cast("binary"))
    return raw.mapInArrow(run, StructType.fromDDL(f"row long, doc_id {kind}, held_out boolean, symbols array<int>, rare array<long>"))


@dataclass
class Level:
    """Contexts of one length: the oldest token, the suffix, and what follows."""

    keys: np.ndarray  # suffix * symbols + oldest symbol, sorted: a context's place is its number
    rest: np.ndarray = field(default_factory=lambda: np.empty(0))  # mass left to the suffix
    pairs: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))  # context * (symbols + 1) + next
    own: np.ndarray = field(default_factory=lambda: np.empty(0))  # probability of each pair


@dataclass
class Tree:
    hashes: np.ndarray  # of the symbols, sorted
    counts: np.ndarray  # of the symbols in training texts
    total: int  # training tokens
    rare: float  # tokens that occur less often than this in all texts are no symbols
    distinct: int
    levels: list[Level] = field(default_factory=list)

    @property
    def size(self) -> int:
        return len(self.hashes)

    def root(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 0.5) / (self.total + 0.5 * (self.distinct + 1))

    def states(self, symbols: np.ndarray, depth: int) -> list[np.ndarray]:
        """For each length up to ``depth``, the context before each token, -1 for none.

        Texts may follow each other: no context has an end in it.
        """
        out: list[np.ndarray] = []
        before = np.zeros(len(symbols), np.int64)
        for d in range(depth):
            here = np.flatnonzero(before[d + 1 :] >= 0) + d + 1
            oldest = symbols[here - d - 1].astype(np.int64)
            here, oldest = here[oldest >= 0], oldest[oldest >= 0]
            state = np.full(len(symbols), -1)
            state[here] = _find(self.levels[d].keys, before[here] * self.size + oldest)
            out.append(state)
            before = state
        return out

    def probabilities(self, symbols: np.ndarray, depth: int | None = None) -> np.ndarray:
        """Of each token after what stands before it; for other tokens than symbols, the factor
        of their root probability."""
        depth = len(self.levels) if depth is None else depth
        p = np.where(symbols >= 0, self.root(self.counts[symbols]), 1.0) if self.size else np.ones(len(symbols))
        for level, state in zip(self.levels, self.states(symbols, depth), strict=False):
            here = np.flatnonzero(state >= 0)
            if not len(here):
                break
            keys = state[here] * (self.size + 1) + np.where(symbols[here] >= 0, symbols[here], self.size)
            pair = _find(level.pairs, keys)
            own = np.where(pair >= 0, level.own[pair], 0.0) if len(level.own) else 0.0
            p[here] = own + level.rest[state[here]] * p[here]
        return p


def _followers(coded: DataFrame, tree: Tree, depth: int) -> DataFrame:
    """``key, n`` in training texts: context of length ``depth`` * (symbols + 1) + next symbol."""
    arrow = pa.schema([("key", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            key, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], schema=arrow)

        for part in _slices(batches):
            symbols = part.column(0).flatten().to_numpy()
            state = tree.states(symbols, depth)[-1]
            here = np.flatnonzero(state >= 0)
            following = np.where(symbols[here] >= 0, symbols[here], tree.size)
            held.append(state[here] * (tree.size + 1) + following)
            if sum(map(len, held)) >= HELD_KEYS:
                yield flush()
        if held:
            yield flush()

    parts = coded.where("not held_out").select("symbols").mapInArrow(run, StructType.fromDDL("key long, n long"))
    return parts.groupBy("key").agg(F.sum("n").alias("n"))


def _grown(tree: Tree, level: Level, key: np.ndarray, n: np.ndarray, totals: np.ndarray, suffixes: list[np.ndarray]) -> np.ndarray:
    """Fill a level from the counts of its pairs; returns which contexts diverge."""
    context, following = key // (tree.size + 1), key % (tree.size + 1)
    level.pairs, level.own = key, (n - DISCOUNT) / totals[context]
    level.rest = 1 - np.bincount(context, level.own, len(totals))
    # What the suffix, and the suffixes of it, say of the same token.
    below = tree.root(tree.counts[following])
    for lower, number in zip(tree.levels, suffixes, strict=False):
        at = number[context]
        pair = _find(lower.pairs, at * (tree.size + 1) + following)
        below = np.where(pair >= 0, lower.own[pair] if len(lower.own) else 0.0, 0.0) + lower.rest[at] * below
    held, expected = np.bincount(context, n, len(totals)), np.bincount(context, below, len(totals))
    gain = np.bincount(context, n * np.log(n / (totals[context] * below)), len(totals))
    other = totals - held
    with np.errstate(divide="ignore", invalid="ignore"):
        gain += np.where(other > 0, other * np.log(other / (totals * np.maximum(1 - expected, 1e-12))), 0.0)
    freedom = np.bincount(context, minlength=len(totals)).astype(float)
    return 2 * gain > freedom + DEVIATIONS * np.sqrt(2 * np.maximum(freedom, 1))


def learn(docs: DataFrame) -> tuple[Tree, DataFrame, DataFrame]:
    """The tree of ``docs(doc_id, text, held_out)``, the counts of all tokens, the coded texts."""
    counts = written(_token_counts(docs), "token-counts")
    sums = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("all"),
        F.coalesce(F.sum("train"), F.lit(0)).alias("train"),
        F.count(F.when(F.col("train") > 0, 1)).alias("distinct"),
    ).first()
    rare = SYMBOL * sums["all"] ** 0.5
    # At most the root of the number of tokens / SYMBOL rows.
    frequent = counts.where(F.col("n") >= rare).select("key", "train").toArrow()
    hashes, trained = frequent["key"].to_numpy(), frequent["train"].to_numpy()
    order = np.argsort(hashes)
    tree = Tree(hashes[order], trained[order], sums["train"], rare, sums["distinct"])
    coded = written(_coded(docs, tree.hashes), "coded-texts")
    floor = max(2.0, CONTEXT * tree.total**0.5)
    end = _find(tree.hashes, np.array([_END]))[0]
    oldest = np.flatnonzero((tree.counts >= floor) & (np.arange(tree.size) != end))
    diverging: list[np.ndarray] = []
    # For each level, the number of each context's suffix one token shorter.
    parents: list[np.ndarray] = []
    level = Level(oldest)
    for depth in range(1, LENGTH + 1):
        if not len(level.keys):
            break
        tree.levels.append(level)
        pairs = written(_followers(coded, tree, depth), "followers")
        # Contexts and pairs are bounded by the root of the number of tokens.
        whole = pairs.groupBy(F.floor(F.col("key") / F.lit(tree.size + 1)).alias("context")).agg(F.sum("n").alias("n")).toArrow()
        totals = np.zeros(len(level.keys))
        totals[whole["context"].to_numpy()] = whole["n"].to_numpy()
        totals = np.maximum(totals, 1)
        least = max(2.0, PAIR * tree.total**0.5)
        kept = pairs.where((F.col("n") >= least) & (F.pmod("key", F.lit(tree.size + 1)) != tree.size)).select("key", "n").toArrow()
        key, n = kept["key"].to_numpy(), kept["n"].to_numpy().astype(float)
        order = np.argsort(key)
        key, n = key[order], n[order]
        parents.append(level.keys // tree.size)
        # From a context of this level to its suffixes of length 1, 2, ...
        chain, number = [], np.arange(len(level.keys))
        for up in reversed(parents[1:]):
            number = up[number]
            chain.append(number)
        tree.levels.pop()
        diverging.append(_grown(tree, level, key, n, totals, chain[::-1]))
        tree.levels.append(level)
        # Longer candidates: this context, which must go on with a token that ends a known context.
        context, last = key // (tree.size + 1), key % (tree.size + 1)
        often = (n >= floor) & (last != end)
        level = Level(_longer(tree, context[often], last[often]))
    _retain(tree, diverging, parents)
    return tree, counts, coded


def _longer(tree: Tree, context: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Keys of the contexts that are a known one and the token after it."""
    depth = len(tree.levels)
    spelled = np.empty((len(context), depth + 1), np.int64)
    spelled[:, depth] = last
    # A context's oldest token comes off first.
    number = context
    for d in range(depth, 0, -1):
        key = tree.levels[d - 1].keys[number]
        spelled[:, depth - d] = key % tree.size
        number = key // tree.size
    # The suffix without the oldest token, found from its last token on.
    suffix = np.zeros(len(context), np.int64)
    for d in range(depth):
        found = _find(tree.levels[d].keys, suffix * tree.size + spelled[:, depth - d])
        suffix = np.where(suffix >= 0, found, -1)
    keys = suffix * tree.size + spelled[:, 0]
    return np.unique(keys[suffix >= 0])


def _retain(tree: Tree, diverging: list[np.ndarray], parents: list[np.ndarray]) -> None:
    """Keep the contexts that diverge and the suffixes of those kept; number them anew."""
    keep = [d.copy() for d in diverging]
    for d in range(len(keep) - 1, 0, -1):
        keep[d - 1][parents[d][keep[d]]] = True
    before = None
    for level, kept, up in zip(tree.levels, keep, parents, strict=True):
        number = np.where(kept, np.cumsum(kept) - 1, -1)
        context, following = level.pairs // (tree.size + 1), level.pairs % (tree.size + 1)
        mine = kept[context]
        level.pairs = number[context[mine]] * (tree.size + 1) + following[mine]
        level.own = level.own[mine]
        level.rest = level.rest[kept]
        oldest = level.keys[kept] % tree.size
        suffix = np.zeros(len(oldest), np.int64) if before is None else before[up[kept]]
        # Numbers rise with the old ones, so keys stay sorted.
        level.keys = suffix * tree.size + oldest
        before = number


def _scored_symbols(coded: DataFrame, tree: Tree) -> DataFrame:
    """``row, doc_id, held_out, n_tokens, n_known, base, score`` by the symbols of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = np.append(np.log10(tree.root(tree.counts)), 0.0)
        known = np.append(tree.counts > 0, False)
        for part in _slices(batches):
            lists = part.column(3)
            symbols = lists.flatten().to_numpy()
            lengths = lists.value_lengths().to_numpy()
            starts = np.cumsum(lengths) - lengths
            sums = [np.add.reduceat(x, starts) for x in (known[symbols].astype(np.int64), logs[symbols], np.log10(tree.probabilities(symbols)))]
            names = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score"]
            columns = [part.column(0), part.column(1), part.column(2), pa.array(lengths, pa.int64()), *map(pa.array, sums)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = coded.schema["doc_id"].dataType.simpleString()
    schema = f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double"
    return coded.select("row", "doc_id", "held_out", "symbols").mapInArrow(run, StructType.fromDDL(schema))


def score(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Input is ``docs(doc_id, text)``. Tokens are the words between ASCII white space, lower-cased
    A-Z, and one end. Texts whose id's CRC-32 has remainder 1 by 5 are held out of the training.
    ``n_known`` counts tokens that training texts have; ``base_score`` is the root's log10
    probability of the text, ``score`` that of the tree.

    One row per row; equal texts have equal scores. A null or empty text is an end alone. A null
    ``doc_id`` is fold 0; other columns are not read. Without training texts every token has the
    root probability of an unknown one. Counts and coded texts become scratch tables. Words are
    told apart by 63 bits of hash.
    """
    texts = docs.select("doc_id", "text", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"))
    tree, counts, coded = learn(texts)
    heads = _scored_symbols(coded, tree)
    rare = counts.where(F.col("n") < tree.rare).select("key", F.col("train").alias("_c"))
    met = coded.select("row", F.explode("rare").alias("key")).join(rare, "key")
    others = met.select(
        "row",
        F.when(F.col("_c") > 0, 1).otherwise(0).cast("long").alias("known"),
        F.log10((F.col("_c") + 0.5) / (tree.total + 0.5 * (tree.distinct + 1))).alias("unit"),
    )
    # Heads and rare tokens of a text meet in one grouping; only heads have an id.
    both = heads.unionByName(others, allowMissingColumns=True)
    return (
        both.groupBy("row")
        .agg(
            *[F.max(c).alias(c) for c in ("doc_id", "held_out", "n_tokens")],
            (F.max("n_known") + F.coalesce(F.sum("known"), F.lit(0))).alias("n_known"),
            (F.max("base") + F.coalesce(F.sum("unit"), F.lit(0.0))).alias("base_score"),
            (F.max("score") + F.coalesce(F.sum("unit"), F.lit(0.0))).alias("score"),
        )
        .select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tree.total).cast("long").alias("train_tokens"), "base_score", "score")
    )
