"""Token counts through a cache of content digests.

The cache is a Parquet folder of ``content, tokenizer, n_tokens``: the SHA-256 of the normalised
text, the digest of the tokenizer's version, and the count. Texts are brought together by digest,
which combines copies before the shuffle; those that the cache doesn't hold are encoded once and
appended; every document then gets its count by a join on digests.

The normalised text has its runs of ASCII white space made one space and none at either end. The
tokenizers that ``drops_space`` accepts drop white space, so this changes no count; for any other
the text itself is the key.
"""

from __future__ import annotations

import hashlib
import json
import os
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from docloom.llm.common import map_slices
from docloom.sources.tables import written

COUNTS = StructType(
    [
        StructField("content", StringType()),
        StructField("tokenizer", StringType()),
        StructField("n_tokens", LongType()),
    ]
)
# Bytes of the words whose counts a task remembers, and words it looks up at once.
TABLE_BYTES, WORDS = 56 << 20, 20_000
# What a remembered word takes besides its letters, about.
ENTRY = 100


def version_digest(tokenizer: bytes) -> str:
    """Digest of the tokenizer's file and of the library's version."""
    import tokenizers

    return hashlib.sha256(tokenizers.__version__.encode() + b"\n" + tokenizer).hexdigest()


@cache
def drops_space(tokenizer: bytes) -> bool:
    """Whether counts add up over the words between spaces.

    So it is when the text is cut into matches of a pattern that matches no white space, what is
    between them is dropped, and no step adds or merges anything across words.
    """
    spec = json.loads(tokenizer)
    steps = spec["pre_tokenizer"] or {}
    steps = steps.get("pretokenizers", [steps])
    first = steps[0] if steps else {}
    rest = all(s.get("type") == "ByteLevel" and not s["add_prefix_space"] and not s["use_regex"] for s in steps[1:])
    norm = spec["normalizer"] or {}
    norms = {n["type"] for n in norm.get("normalizers", [norm] if norm else [])}
    branches = first.get("pattern", {}).get("Regex", "\\s").split("|")
    no_space = all(b in _SPACELESS for b in branches)
    return (
        first.get("type") == "Split"
        and first["behavior"] == "Removed"
        and first["invert"]
        and no_space
        and rest
        and norms <= {"NFC", "Replace", "Lowercase"}
        and not any(t["lstrip"] or t["rstrip"] or " " in t["content"] for t in spec["added_tokens"])
    )


# Pattern branches known to match no white space.
_SPACELESS = {"'s", "'t", "'re", "'ve", "'m", "'ll", "'d", r"[\p{L}]+", r"[\p{N}]", r"[^\s\p{L}\p{N}]+"}


def normalised(text: Column, tokenizer: bytes) -> Column:
    text = F.coalesce(text, F.lit(""))
    if not drops_space(tokenizer):
        return text
    return F.trim(F.regexp_replace(text, r"[\x09-\x0D ]+", " "))


def _counter(tokenizer: bytes):
    """A function from a list of normalised texts to their numbers of tokens."""
    # One thread: tasks are what runs side by side, and each thread of a pool holds memory of its own.
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    library = Tokenizer.from_buffer(tokenizer)
    library.no_truncation()
    library.no_padding()

    def lengths(texts: list[str]) -> list[int]:
        return [len(e.ids) for e in library.encode_batch_fast(texts, add_special_tokens=False)]

    if not drops_space(tokenizer):
        return lengths
    table: dict[str, int] = {"": 0}
    held = 0

    def learn(words: list[str]) -> None:
        nonlocal held
        unseen = list({w for w in words if w not in table})
        held += sum(map(len, unseen)) + ENTRY * len(unseen)
        if held > TABLE_BYTES:
            table.clear()
            unseen = list(set(words))
            held = sum(map(len, unseen)) + ENTRY * len(unseen)
        table.update(zip(unseen, lengths(unseen), strict=True))

    def count(texts: list[str]) -> list[int]:
        totals = [0] * len(texts)
        run: list[tuple[int, list[str]]] = []
        size = 0

        def add_up() -> None:
            learn([w for _, words in run for w in words])
            for i, words in run:
                totals[i] += sum(map(table.__getitem__, words))

        for i, text in enumerate(texts):
            words = text.split(" ")
            for at in range(0, len(words), WORDS):
                run.append((i, words[at : at + WORDS]))
                size += len(run[-1][1])
                if size >= WORDS:
                    add_up()
                    run, size = [], 0
        add_up()
        return totals

    return count


def _stored(docs: DataFrame, cache_path: str, version: str) -> DataFrame:
    spark = docs.sparkSession
    # An empty table of the schema is written first, so that there is always something to read.
    spark.createDataFrame([], COUNTS).write.mode("append").parquet(cache_path)
    cached = spark.read.schema(COUNTS).parquet(cache_path).where(F.col("tokenizer") == version)
    # Two jobs may have appended the same digest; their counts are equal.
    return cached.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer: bytes, cache_path: str, limit: int = 2048) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for ``docs(doc_id, text)``.

    ``cache_path`` is a folder that all executors share; what is missing there is appended by a
    job of its own before this returns. No special tokens are added, nothing is cut or padded.

    One row per row. A null text is an empty text: 0 bytes, 0 tokens. Null and repeated ``doc_id``
    are passed through; equal texts share one cache row; other columns are not read.
    """
    version = version_digest(tokenizer)
    text = normalised(F.col("text"), tokenizer)
    keyed = docs.select("doc_id", "text").withColumn("content", F.sha2(text.cast("binary"), 256))
    contents = keyed.groupBy("content").agg(F.any_value(text).alias("text"))
    looked_up = contents.join(_stored(docs, cache_path, version), "content", "left")
    misses = looked_up.select("content", F.when(F.col("n_tokens").isNull(), F.col("text")).alias("text"), "n_tokens")

    def start():
        count = _counter(tokenizer)

        def work(content, text, n_tokens):
            fresh = [n is None for n in n_tokens]
            counted = iter(count([t for t, f in zip(text, fresh, strict=True) if f]))
            n_tokens = [next(counted) if f else n for n, f in zip(n_tokens, fresh, strict=True)]
            return {"content": content, "n_tokens": n_tokens, "fresh": fresh}

        return work

    # One row per different text of the input, made once, then appended and joined.
    counts = written(map_slices(misses, start, "content string, n_tokens long, fresh boolean"), "content-counts")
    fresh = counts.where("fresh").select("content", F.lit(version).alias("tokenizer"), "n_tokens")
    fresh.write.mode("append").parquet(cache_path)
    sized = keyed.select(
        "doc_id", "content", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    )
    return sized.join(counts.drop("fresh"), "content").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
