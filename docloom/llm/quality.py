"""Quality rules by robust multivariate outliers.

A document's statistics become a vector of four transformed shares. For each language and source a
minimum-covariance-determinant estimate gives centre and scatter of the bulk of the documents; the
fewer a source has, the more its estimate is drawn towards its language's, and that towards all
documents'. A document whose Mahalanobis distance is beyond a chi-square quantile is rejected.

The estimate concentrates: all documents are measured against the current centre and scatter, the
nearest three quarters give the next ones. No group is gathered for it: each step sums counts and
moments per group in fine bins of distance, which combines before the shuffle, and the bins up to
three quarters of the count, the last one in part, are the nearest ones. Each step is a job over
the small table of statistics.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import map_slices
from docloom.sources.tables import written

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]

# Counts added to a share's whole, so that short texts don't stray for want of words.
PRIOR_WORDS, PRIOR_CHARS, PRIOR_LINES = 50.0, 200.0, 10.0
PRIOR_LENGTH = 5.0
# What a share varies by at least in sound texts, as a standard deviation: log of the mean word
# length, symbols per character, repeated lines, repeated words. Added to every scatter, as most
# texts repeat nothing: without it, one repeated line would be infinitely far off. Each share alone
# can still be far enough off: half the lines, or 15 % of the words.
FLOOR = (0.05, 0.01, 0.1, 0.03)
DIM = len(FLOOR)
SHARE = 0.75
STEPS = 4
# A group of n documents has weight n / (n + BLEND) in its estimate, that of its language the rest,
# which is blended with that of all documents in the same way.
BLEND = 100.0
QUANTILE = 0.9999
# Bins to each doubling of the squared distance.
BINS = 16
SALTS = 64


def _text_stats(text: str | None) -> tuple[int, ...]:
    if not text:
        return (0,) * len(STATS)
    data = text.encode()
    words = data.split()
    n = len(words)
    spaces = sum(map(text.count, " \t\n\x0b\x0c\r"))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [line for line in data.split(b"\n") if line.split()]
    repeated = 0
    if n >= WINDOW:
        windows = list(zip(*(words[i:] for i in range(WINDOW)), strict=False))
        if len(set(windows)) < len(windows):
            counts = Counter(windows)
            upto = 0
            for i, window in enumerate(windows):
                if counts[window] > 1:
                    repeated += i + WINDOW - max(i, upto)
                    upto = i + WINDOW
    return n, len(text) - spaces, symbols, len(lines) - len(set(lines)), repeated, len(lines)


def text_stats(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, source`` and the counts ``STATS``, one row per row; a null text has none."""

    def start():
        def work(doc_id, text, lang, source):
            columns = zip(*map(_text_stats, text), strict=True)
            return {"doc_id": doc_id, "lang": lang, "source": source} | {
                k: list(v) for k, v in zip(STATS, columns, strict=True)
            }

        return work

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([f"{c} {kinds[c]}" for c in ("doc_id", "lang", "source")] + [f"{s} long" for s in STATS])
    return map_slices(docs.select("doc_id", "text", "lang", "source"), start, schema)


def _vector() -> list[Column]:
    return [
        F.log((F.col("word_chars") + PRIOR_WORDS * PRIOR_LENGTH) / (F.col("n_words") + PRIOR_WORDS)),
        F.col("n_symbols") / (F.col("word_chars") + PRIOR_CHARS),
        F.col("n_dup_lines") / (F.col("n_lines") + PRIOR_LINES),
        F.col("n_repeat_words") / (F.col("n_words") + PRIOR_WORDS),
    ]


def _chi2(x: float, dof: int) -> float:
    """Distribution function of chi-square for even degrees of freedom."""
    half = x / 2
    return 1 - math.exp(-half) * sum(half**i / math.factorial(i) for i in range(dof // 2))


def _chi2_quantile(p: float, dof: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if _chi2(middle, dof) < p else (low, middle)
    return high


# What makes the scatter of the nearest ``SHARE`` that of all, for normal data.
_SCALE = SHARE / _chi2(_chi2_quantile(SHARE, DIM), DIM + 2)
CUTOFF = _chi2_quantile(QUANTILE, DIM)

_GROUP = ["_level", "_lang", "_source"]
_X = [f"_x{i}" for i in range(DIM)]
_PAIRS = [(i, j) for i in range(DIM) for j in range(i, DIM)]
_MOMENTS = [f"_s{i}" for i in range(DIM)] + [f"_s{i}{j}" for i, j in _PAIRS]
_INVERSE = [f"_v{i}{j}" for i, j in _PAIRS]
_CENTRE = [f"_c{i}" for i in range(DIM)]


def _distance() -> Column:
    d = [F.col(x) - F.col(c) for x, c in zip(_X, _CENTRE, strict=True)]
    terms = [(1 if i == j else 2) * d[i] * d[j] * F.col(f"_v{i}{j}") for i, j in _PAIRS]
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return F.greatest(total, F.lit(0.0))


def _levels(vectors: DataFrame) -> DataFrame:
    """Each row once for its source, once for its language and once for all."""
    empty = F.lit("")
    levels = F.array(
        F.struct(F.lit(0).alias("_level"), F.col("_lang"), F.col("_source")),
        F.struct(F.lit(1).alias("_level"), F.col("_lang"), empty.alias("_source")),
        F.struct(F.lit(2).alias("_level"), empty.alias("_lang"), empty.alias("_source")),
    )
    return vectors.select("_salt", *_X, F.inline(levels))


def _moments() -> list[Column]:
    sums = [F.sum(x).alias(f"_s{i}") for i, x in enumerate(_X)]
    return sums + [F.sum(F.col(f"_x{i}") * F.col(f"_x{j}")).alias(f"_s{i}{j}") for i, j in _PAIRS]


def _estimate(n: float, moments: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    centre = moments[:DIM] / n
    scatter = np.zeros((DIM, DIM))
    for value, (i, j) in zip(moments[DIM:], _PAIRS, strict=True):
        scatter[i, j] = scatter[j, i] = value / n - centre[i] * centre[j]
    scatter[np.diag_indices(DIM)] = scatter.diagonal().clip(0)
    return centre, scatter * scale + np.diag(np.square(FLOOR))


def _row(keys: tuple, n: float, centre: np.ndarray, scatter: np.ndarray) -> pd.DataFrame:
    inverse = np.linalg.inv(scatter)
    values = [*keys, float(n), float(np.linalg.slogdet(scatter)[1]), *centre, *(inverse[i, j] for i, j in _PAIRS)]
    return pd.DataFrame([values], columns=[*_GROUP, "_start", "_n", "_det", *_CENTRE, *_INVERSE])


_ESTIMATES = "_level int, _lang string, _source string, _start int, _n double, _det double, " + ", ".join(
    f"{c} double" for c in [*_CENTRE, *_INVERSE]
)


def _classical(keys: tuple, part: pd.DataFrame) -> pd.DataFrame:
    n = part["_n"].iloc[0]
    return _row((*keys, 0), n, *_estimate(n, part[_MOMENTS].iloc[0].to_numpy(float), 1.0))


def _median(keys: tuple, part: pd.DataFrame) -> pd.DataFrame:
    low, middle, high = (np.array([part[f"_q{i}"].iloc[0][k] for i in range(DIM)]) for k in range(3))
    spread = (high - low) / 1.349
    return _row((*keys, 1), part["_n"].iloc[0], middle, np.diag(np.square(spread) + np.square(FLOOR)))


def _nearest(keys: tuple, part: pd.DataFrame) -> pd.DataFrame:
    """Centre and scatter of the nearest ``SHARE``, from the bins' counts and moments."""
    part = part.sort_values("_bin")
    counts = part["_rows"].to_numpy(float)
    wanted = SHARE * counts.sum()
    before = np.cumsum(counts) - counts
    used = np.clip((wanted - before) / counts, 0, 1)
    moments = (part[_MOMENTS].to_numpy(float) * used[:, None]).sum(axis=0)
    return _row(keys, counts.sum(), *_estimate(wanted, moments, _SCALE))


def robust_estimates(vectors: DataFrame) -> DataFrame:
    """One row per group: centre and inverse scatter.

    ``vectors`` is a written table of ``_lang, _source``, the vector, and ``_salt`` below SALTS.
    """
    rows = _levels(vectors)
    n = F.count("*").cast("double").alias("_n")
    classical = rows.groupBy(*_GROUP).agg(n, *_moments()).groupBy(*_GROUP).applyInPandas(_classical, _ESTIMATES)
    quartiles = [F.percentile_approx(x, [0.25, 0.5, 0.75], 1000).alias(f"_q{i}") for i, x in enumerate(_X)]
    median = rows.groupBy(*_GROUP).agg(n, *quartiles).groupBy(*_GROUP).applyInPandas(_median, _ESTIMATES)
    current = written(classical.unionByName(median), "outlier-estimates")
    # A group may hold a third of the rows: they meet its estimate in SALTS parts.
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    for _ in range(STEPS):
        binned = (
            rows.join(current.withColumn("_salt", salts), [*_GROUP, "_salt"])
            .withColumn("_bin", F.floor(F.log2(_distance() + 1e-6) * BINS).cast("int"))
            .groupBy(*_GROUP, "_start", "_bin")
            .agg(F.count("*").alias("_rows"), *_moments())
        )
        current = written(binned.groupBy(*_GROUP, "_start").applyInPandas(_nearest, _ESTIMATES), "outlier-estimates")
    # The lower determinant of the two starts wins; the first at a tie.
    best = F.min_by(F.struct("_n", *_CENTRE, *_INVERSE), F.struct("_det", "_start")).alias("_e")
    return current.groupBy(*_GROUP).agg(best)


def _moments_of(part: pd.DataFrame, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, centres and second moments of the estimates of a level."""
    centre = part[[f"{c}_{level}" for c in _CENTRE]].to_numpy(float)
    inverse = np.empty((len(part), DIM, DIM))
    for v, (i, j) in zip(_INVERSE, _PAIRS, strict=True):
        inverse[:, i, j] = inverse[:, j, i] = part[f"{v}_{level}"].to_numpy(float)
    return part[f"_n_{level}"].to_numpy(float), centre, np.linalg.inv(inverse) + centre[:, :, None] * centre[:, None, :]


def _blend(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        _, centre, second = _moments_of(part, 2)
        for level in (1, 0):
            n, own_centre, own_second = _moments_of(part, level)
            weight = n / (n + BLEND)
            centre = weight[:, None] * own_centre + (1 - weight)[:, None] * centre
            second = weight[:, None, None] * own_second + (1 - weight)[:, None, None] * second
        inverse = np.linalg.inv(second - centre[:, :, None] * centre[:, None, :])
        out = part[["_lang", "_source"]].copy()
        out[_CENTRE] = centre
        out[_INVERSE] = np.stack([inverse[:, i, j] for i, j in _PAIRS], axis=1)
        yield out


def blended(estimates: DataFrame) -> DataFrame:
    """For each language and source the estimates of source, language and all in one: the centre and
    scatter of their mixture, the more the source's own the more documents it has."""

    def of(level: int, *keys: str) -> DataFrame:
        named = [F.col(f"_e.{c}").alias(f"{c}_{level}") for c in ("_n", *_CENTRE, *_INVERSE)]
        return estimates.where(F.col("_level") == level).select(*keys, *named)

    found = of(0, "_lang", "_source").join(of(1, "_lang"), "_lang").crossJoin(F.broadcast(of(2)))  # one row
    schema = "_lang string, _source string, " + ", ".join(f"{c} double" for c in [*_CENTRE, *_INVERSE])
    return found.mapInPandas(_blend, schema)


def judge(docs: DataFrame) -> DataFrame:
    """``doc_id``, the counts ``STATS``, ``base_failed``, ``distance`` and ``kept``.

    Input is ``docs(doc_id, text, lang, source)``; words are what is between ASCII white space.
    ``base_failed``: fewer than 10 words, or over 20 % of them in windows of five that the text has
    twice or more. Estimates come from all other documents. ``distance`` is the squared
    Mahalanobis distance, null where ``base_failed``; ``kept`` if it is at most ``CUTOFF``.

    One row per row. Null, empty and blank texts have no words and fail; a null language or source
    is a group of its own kind (''); equal rows get equal verdicts; ``doc_id`` is passed through;
    other columns are not read; no documents give no rows. The statistics become a scratch table.
    """
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    stats = written(
        text_stats(docs)
        .withColumn("base_failed", failed)
        .withColumn("_lang", F.coalesce("lang", F.lit("")))
        .withColumn("_source", F.coalesce("source", F.lit(""))),
        "text-stats",
    )
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("_salt")
    vectors = stats.where("not base_failed").select("_lang", "_source", salt, *[v.alias(x) for v, x in zip(_vector(), _X, strict=True)])
    estimates = written(blended(robust_estimates(vectors)), "outlier-groups")
    placed = stats.withColumns(dict(zip(_X, _vector(), strict=True))).join(estimates, ["_lang", "_source"], "left")
    distance = F.when(~F.col("base_failed"), _distance())
    return placed.withColumn("distance", distance).select(
        "doc_id",
        *STATS,
        "base_failed",
        "distance",
        F.coalesce(F.col("distance") <= CUTOFF, F.lit(False)).alias("kept"),
    )
