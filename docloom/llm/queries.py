"""The operators of this subpackage as registered queries over whole tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import chat, collocations, decontaminate, lexical, neardup, pieces, pii, quality, sharding, suffixtree, tokencounts, toxicity, warc
from docloom.llm.common import documents
from docloom.sources.tables import fresh_path

PIECES, WORDS = "piece_bpe_32k.model", "word_bpe_49k.json"
SHARDS = [f"shard-{i:03d}" for i in range(256)]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.find_contamination(documents(spark, folder), _table(spark, folder, "benchmark"))
    return decontaminate.digests(found)


def op2_chat(spark: SparkSession, folder: str) -> DataFrame:
    turns = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]")
    two = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        said.alias("text"),
    )
    return chat.digests(chat.read_chat(chat.format_chat(turns.unionByName(two))))


def op3_warc(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    warc.write_archives(_table(spark, folder, "pages"), path)
    return warc.digests(warc.assemble_captures(spark, path))


def op4_sharding(spark: SparkSession, folder: str) -> DataFrame:
    ids = _table(spark, folder, "documents").select("doc_id")
    return sharding.place(ids, F.col("doc_id"), SHARDS).select("doc_id", "slot", "shard")


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, folder, "labels"))).drop("evidence")


def op6_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, folder))


def op7_pieces(spark: SparkSession, folder: str) -> DataFrame:
    model = pieces.read_model(public_tokenizers.path(PIECES))
    encoded = pieces.encode(documents(spark, folder), model)
    return pieces.digests(pieces.decode(encoded, model))


def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    tokenizer = pieces.read_model(public_tokenizers.path(WORDS))
    return tokencounts.count_tokens(documents(spark, folder), tokenizer, fresh_path(spark, "token-counts"))


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(_table(spark, folder, "documents")).drop("n_lines")


def op10_suffix_tree(spark: SparkSession, folder: str) -> DataFrame:
    return suffixtree.score(documents(spark, folder))


def op11_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.search(documents(spark, folder), _table(spark, folder, "benchmark"))


def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(_table(spark, folder, "documents")).drop("first")


def op13_private(spark: SparkSession, folder: str) -> DataFrame:
    return pii.digests(pii.find_private(documents(spark, folder)))


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": op1_decontamination,
        "op2_chat": op2_chat,
        "op3_warc": op3_warc,
        "op4_sharding": op4_sharding,
        "op5_toxicity": op5_toxicity,
        "op6_near_duplicates": op6_near_duplicates,
        "op7_pieces": op7_pieces,
        "op8_token_counts": op8_token_counts,
        "op9_quality": op9_quality,
        "op10_suffix_tree": op10_suffix_tree,
        "op11_lexical_search": op11_lexical_search,
        "op12_collocations": op12_collocations,
        "op13_private": op13_private,
    }
