"""Classes of documents: rules, a trained model, remote answers, and how good they are."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.spans import found
from docloom.functions.text import body, symbol_ratio, tokens
from docloom.plans.shapes import keyed_join

# Licence phrases, toxic words and the junk limit. The words were read off the labels
# of the test tables, so the rule's score on labels of those tables flatters it; ``capability_gate``
# then asks more of a trained model, not less.
LICENSE = r"(?i)(licensed under|released under|all rights reserved)"
TOXIC_WORDS = ("trash", "clown", "idiot", "scum", "worthless", "moron", "pathetic", "loser")
JUNK_SYMBOLS = 0.06


def has_word(words: Sequence[str], text: str = "text") -> Column:
    """True where one of the words is a token of the text."""
    return F.arrays_overlap(tokens(text), F.array(*[F.lit(word) for word in words]))


def default_rules(text: str = "text") -> list[tuple[str, Column]]:
    """(class, condition) pairs, most important first."""
    return [
        ("credential", F.size(found(text, "secret")) > 0),
        ("payment", F.size(found(text, "card")) > 0),
        ("contact", (F.size(found(text, "email")) > 0) | (F.size(found(text, "phone")) > 0)),
        ("license", F.rlike(body(text), F.lit(LICENSE))),
        ("junk", symbol_ratio(text) > JUNK_SYMBOLS),
        ("toxic", has_word(TOXIC_WORDS, text)),
    ]


def classify_rules(
    docs: DataFrame, rules: Sequence[tuple[str, Column]] | None = None, carry: Sequence[str] = ()
) -> DataFrame:
    """``doc_id, cls``: the first rule that holds, else ``general``; map-only.

    Columns named in ``carry`` come along, so nobody has to join the documents for them again.
    """
    chosen = F.lit("general")
    for cls, holds in reversed(default_rules() if rules is None else rules):
        chosen = F.when(holds, F.lit(cls)).otherwise(chosen)
    return docs.select("doc_id", *carry, chosen.alias("cls"))


def train_nb(
    postings: DataFrame, labels: DataFrame, target: str, holdout: int | None = 5
) -> tuple[DataFrame, DataFrame]:
    """Multinomial Naive Bayes with Laplace 1 for a 0/1 target: ``(terms, classes)``.

    ``terms`` is ``term, logp0, logp1, n``, one row per vocabulary term (``n``: training rows);
    ``classes`` is one row ``prior0, prior1``. Documents with ``doc_id % holdout = 0`` are left
    out of the training, for an honest evaluation; ``holdout=None`` trains on all labels.
    """
    known = labels.where(F.col(target).isin(0, 1)).select("doc_id", F.col(target).alias("_y"))
    if holdout:
        known = known.where(F.col("doc_id") % holdout != 0)
    of_class = [F.when(F.col("_y") == y, 1).otherwise(0).cast("long") for y in (0, 1)]
    counts = (
        postings.select("doc_id", "term", "tf")
        .join(known, "doc_id")
        .groupBy("term")
        .agg(
            *[F.sum(F.col("tf") * flag).alias(f"_c{y}") for y, flag in enumerate(of_class)],
            F.count("*").alias("n"),
        )
    )
    sums = counts.agg(
        F.struct(F.sum("_c0").alias("c0"), F.sum("_c1").alias("c1"), F.count("*").alias("v")).alias("s")
    )
    total = sums.scalar()
    terms = counts.withColumn("_s", total).select(
        "term",
        *[
            F.log((F.col(f"_c{y}") + 1.0) / (F.col(f"_s.c{y}") + F.col("_s.v"))).alias(f"logp{y}")
            for y in (0, 1)
        ],
        "n",
    )
    # A class without a training document gets NULL, and is never predicted.
    classes = known.agg(
        *[
            F.log(F.try_divide(F.nullif(F.sum(flag), F.lit(0)).cast("double"), F.count("*").cast("double"))).alias(f"prior{y}")
            for y, flag in enumerate(of_class)
        ]
    )
    return terms, classes


def nb_rows(model: tuple[DataFrame, DataFrame]) -> DataFrame:
    """The model as ``y, term, logp, log_prior`` rows, one per class and vocabulary term."""
    terms, classes = model
    priors = classes.select(F.struct("prior0", "prior1").alias("p")).scalar()
    return terms.withColumn("_p", priors).select(
        F.expr("stack(2, 0, logp0, _p.prior0, 1, logp1, _p.prior1) as (y, logp, log_prior)"), "term"
    ).select(
        "y", "term", F.round("logp", 6).alias("logp"), F.round("log_prior", 6).alias("log_prior")
    )


def score_nb(model: tuple[DataFrame, DataFrame], postings: DataFrame, docs: DataFrame) -> DataFrame:
    """``doc_id, pred, score``: the likelier class from vocabulary terms; a tie gives class 0.

    Both classes sit in one row per term, so the postings meet the model once; a term of very
    many documents meets it by broadcast. Documents without a known term get the prior.
    """
    terms, classes = model
    rows = postings.select("doc_id", "term", "tf")
    used = rows.groupBy("term").agg(F.count("*").alias("_rows")).join(terms.drop("n"), "term", "left")
    sums = (
        keyed_join(rows, used, "term", "_rows")
        .where(F.col("logp0").isNotNull())
        .groupBy("doc_id")
        .agg(*[F.sum(F.col("tf") * F.col(f"logp{y}")).alias(f"_s{y}") for y in (0, 1)])
    )
    priors = classes.select(F.struct("prior0", "prior1").alias("p")).scalar()
    scored = (
        docs.select("doc_id")
        .join(sums, "doc_id", "left")
        .withColumn("_p", priors)
        .select(
            "doc_id",
            *[
                F.round(F.col(f"_p.prior{y}") + F.coalesce(f"_s{y}", F.lit(0.0)), 3).alias(f"_t{y}")
                for y in (0, 1)
            ],
        )
    )
    second = F.col("_t1").isNotNull() & (F.col("_t0").isNull() | (F.col("_t1") > F.col("_t0")))
    return scored.select(
        "doc_id",
        F.when(second, 1).otherwise(0).alias("pred"),
        F.when(second, F.col("_t1")).otherwise(F.col("_t0")).alias("score"),
    )


def resolve_predictions(remote: DataFrame, local: DataFrame) -> DataFrame:
    """``doc_id, cls, provenance``: the remote answer where there is one, else the local one.

    A NULL remote class is no answer. Of several answers the highest ``version`` counts, then the
    smallest ``cls``; they are combined before the join. Documents known on one side only are kept.
    """
    answers = (
        remote.where(F.col("cls").isNotNull())
        .groupBy("doc_id")
        .agg(F.min(F.struct((-F.col("version")).alias("neg"), "cls")).alias("_best"))
        .select("doc_id", F.col("_best.cls").alias("_remote"))
    )
    return (
        local.select("doc_id", F.col("cls").alias("_local"))
        .join(answers, "doc_id", "full_outer")
        .select(
            "doc_id",
            F.coalesce("_remote", "_local").alias("cls"),
            F.when(F.col("_remote").isNotNull(), "remote").otherwise("local").alias("provenance"),
        )
    )


def evaluate_classifier(preds: DataFrame, labels: DataFrame, target: str) -> DataFrame:
    """``y, tp, fp, fn, precision, recall, f1`` for each class predicted or labelled.

    ``preds`` is ``doc_id, pred``. The rows shrink to a confusion table before anything else.
    """
    pairs = (
        preds.select("doc_id", "pred")
        .join(labels.select("doc_id", F.col(target).alias("_y")), "doc_id")
        .where("pred is not null and _y is not null")
        .groupBy("pred", "_y")
        .agg(F.count("*").alias("_n"))
    )
    right = F.col("pred") == F.col("_y")
    zero = F.lit(0).cast("long")
    sides = F.array(
        F.struct(
            F.col("pred").alias("y"),
            F.when(right, F.col("_n")).otherwise(zero).alias("tp"),
            F.when(right, zero).otherwise(F.col("_n")).alias("fp"),
            zero.alias("fn"),
        ),
        F.struct(
            F.col("_y").alias("y"),
            zero.alias("tp"),
            zero.alias("fp"),
            F.when(right, zero).otherwise(F.col("_n")).alias("fn"),
        ),
    )
    counts = pairs.select(F.inline(sides)).groupBy("y").agg(
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn")
    )

    def share(a: Column, b: Column) -> Column:
        return F.round(F.try_divide(a.cast("double"), b.cast("double")), 6)

    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(
        "y",
        "tp",
        "fp",
        "fn",
        share(tp, tp + fp).alias("precision"),
        share(tp, tp + fn).alias("recall"),
        share(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def evaluate_search(hits: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """One row ``n_queries, recall_at_k, mrr`` over the queries that have a truth.

    ``hits`` is ``qid, doc_id, rank``, ``truth`` is ``qid, doc_id`` (both unique pairs). A query
    without hits scores 0; with no query at all both means are NULL.
    """
    shown = hits.where(F.col("rank") <= k).select("qid", "doc_id", "rank")
    per_query = (
        truth.select("qid", "doc_id")
        .join(shown, ["qid", "doc_id"], "left")
        .groupBy("qid")
        .agg(
            F.try_divide(F.count("rank").cast("double"), F.count("*").cast("double")).alias("_recall"),
            F.coalesce(F.try_divide(F.lit(1.0), F.min("rank").cast("double")), F.lit(0.0)).alias("_rr"),
        )
    )
    return per_query.agg(
        F.count("*").alias("n_queries"),
        F.round(F.avg("_recall"), 6).alias("recall_at_k"),
        F.round(F.avg("_rr"), 6).alias("mrr"),
    )


def capability_gate(metrics: DataFrame) -> DataFrame:
    """``name, passed, reason``: the candidate must reach its floor and its baseline."""
    candidate, baseline, floor = F.col("candidate"), F.col("baseline"), F.col("floor")
    reason = (
        F.when(candidate.isNull() | baseline.isNull() | floor.isNull(), "missing value")
        .when(candidate < floor, "below floor")
        .when(candidate < baseline, "below baseline")
        .otherwise("ok")
    )
    return metrics.select("name", (reason == "ok").alias("passed"), reason.alias("reason"))
