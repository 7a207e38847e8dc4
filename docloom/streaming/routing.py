"""External-use routing on a stream of documents."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from docloom.operators.sensitive import route_external, sensitivity_label

# How long a held document waits for its confirmation.
PATIENCE_MS = 30 * 24 * 3600 * 1000
# What is known of a document: its level, answers for and against, changes told so far, the last decision.
STATE = "level string, approvals long, refusals long, told int, decision string"


def document_stream(
    spark: SparkSession, folder: str, schema: StructType, glob: str = "*.parquet", files_per_batch: int = 1000
) -> DataFrame:
    """Documents arriving as parquet files in a folder."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )


def route_external_stream(docs_stream: DataFrame, confirmations: DataFrame) -> DataFrame:
    """``doc_id, level, decision`` for each arriving document.

    Stateless: labels come from the row, the confirmations are a static table joined per batch.
    """
    return route_external(docs_stream, confirmations)


def route_and_release_stream(
    docs_stream: DataFrame, confirmations_stream: DataFrame, patience_ms: int = PATIENCE_MS
) -> DataFrame:
    """``doc_id, level, decision, change``: decisions on two streams, with documents held until answered.

    A document is told ``eligible``, ``held`` or, if its confirmations came first,
    ``eligible_confirmed``; a held one is told ``eligible_confirmed`` once, as soon as there are
    only approvals. A refusal, or an answer of NULL, holds it for good; one that comes after the
    release changes nothing, as the document may have left. ``change`` counts what was told of a
    document, from 1. Documents and answers may come in any order and batch; documents that come
    again are told again only if their level changed.

    Each ``doc_id`` has a small state: no texts. Once the stream has moved on by ``patience_ms`` since
    its last news, a timer drops it, so a document nobody answers isn't kept for ever; it stays
    held, whatever comes later. Time is that of the batch in which something arrived.
    """
    labelled = sensitivity_label(docs_stream).select("doc_id", "level", F.lit(None).cast("boolean").alias("approved"))
    # An answer of NULL is none of approval, so it refuses.
    answers = confirmations_stream.select(
        "doc_id", F.lit(None).cast("string").alias("level"), F.coalesce("approved", F.lit(False)).alias("approved")
    )

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        level, approvals, refusals, told, decision = state.get if state.exists else (None, 0, 0, 0, None)
        arrived = 0
        for batch in batches:
            arrived = max(arrived, int(batch["arrived"].max().timestamp() * 1000))
            known = batch["level"].dropna()
            level = known.iloc[-1] if len(known) else level
            answered = batch.loc[batch["level"].isna(), "approved"].astype(bool)
            approvals += int(answered.sum())
            refusals += int((~answered).sum())
        now = decision
        if level == "none":
            now = "eligible"
        elif level is not None and decision != "eligible_confirmed":
            now = "eligible_confirmed" if approvals and not refusals else "held"
        if now != decision:
            told += 1
            yield pd.DataFrame({"doc_id": [key[0]], "level": [level], "decision": [now], "change": [told]})
        state.update((level, approvals, refusals, told, now))
        state.setTimeoutTimestamp(arrived + patience_ms)

    return (
        labelled.unionByName(answers)
        .withColumn("arrived", F.current_timestamp())
        .withWatermark("arrived", "0 seconds")
        .groupBy("doc_id")
        .applyInPandasWithState(
            follow, "doc_id bigint, level string, decision string, change int", STATE, "append", GroupStateTimeout.EventTimeTimeout
        )
    )


def last_decisions(told: DataFrame) -> DataFrame:
    """``doc_id, level, decision``: the last that was told of each document."""
    last = told.groupBy("doc_id").agg(F.max(F.struct("change", "level", "decision")).alias("_last"))
    return last.select("doc_id", "_last.level", "_last.decision")


def start_routing(decisions: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append decisions to a parquet folder, taking what has arrived and then stopping."""
    return (
        decisions.writeStream.format("parquet")
        .outputMode("append")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
