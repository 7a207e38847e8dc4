"""SentencePiece encoding and decoding through a table of distinct chunks.

A chunk is a run of white-space markers with what follows up to the next marker. Where no piece of
the model has a marker behind another character, no merge crosses the start of a chunk, so the ids
of a text are those of its chunks, in order. Each task keeps a table of distinct chunks, segments
a chunk when it first meets it, and joins the ids back by position.

The table belongs to a task and is emptied when it grows past ``TABLE`` chunks: chunks are then
segmented again, which changes no result. Nothing is shuffled. Chunks and their ids are byte strings
there, a fraction of what lists of numbers take, and a task holds few texts' chunks at once.
"""

from __future__ import annotations

import re
from functools import cache
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import map_slices

MARK = "▁"
TABLE = 400_000
# Texts whose chunks or ids a task holds as objects at once.
TEXTS = 64
# Of a text in UTF-8 whose markers are blanks.
_CHUNK = re.compile(b" +[^ ]*")


@cache
def _processor(model: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


@cache
def chunks_are_safe(model: bytes) -> bool:
    """Whether the model segments chunks independently: a dummy marker in front, texts taken as
    they are, and markers only at the start of pieces. A model's own control words stand apart
    from chunks, so models with user-defined pieces are taken whole."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(model)
    norm = proto.normalizer_spec
    user_defined = proto.SentencePiece.Type.USER_DEFINED
    return (
        proto.trainer_spec.model_type == proto.trainer_spec.BPE
        and norm.add_dummy_prefix
        and norm.escape_whitespaces
        and not norm.remove_extra_whitespaces
        and not norm.precompiled_charsmap
        and not proto.trainer_spec.treat_whitespace_as_suffix
        and all(p.type != user_defined and MARK not in p.piece.lstrip(MARK) for p in proto.pieces)
    )


def _segmenter(model: bytes):
    """A function from a list of texts to the list of their ids."""
    processor = _processor(model)
    if not chunks_are_safe(model):
        return lambda texts: processor.encode(texts, num_threads=1)
    table: dict[bytes, bytes] = {}
    lone = np.array([processor.piece_to_id(MARK)], np.int32).tobytes()

    def encode(texts: list[str]) -> list[list[int]]:
        # The marker put in front of a text that is not empty is part of its first chunk.
        chunked = [_CHUNK.findall(b" " + t.replace(MARK, " ").encode()) if t else [] for t in texts]
        unseen = list({c for chunks in chunked for c in chunks if c not in table})
        if len(table) + len(unseen) > TABLE:
            table.clear()
            unseen = list({c for chunks in chunked for c in chunks})
        # The library puts one marker in front by itself; that leaves nothing of a lone one.
        ids = processor.encode([c[1:].decode() for c in unseen], num_threads=1)
        table.update((c, np.array(i, np.int32).tobytes()) for c, i in zip(unseen, ids, strict=True))
        if b" " in table:
            table[b" "] = lone
        return [np.frombuffer(b"".join([table[c] for c in chunks]), np.int32).tolist() for chunks in chunked]

    return encode


def read_model(path: str) -> bytes:
    """The model's bytes, which go to the tasks with their code: executors need no such file."""
    return Path(path).read_bytes()


def encode(docs: DataFrame, model: bytes) -> DataFrame:
    """``doc_id, ids`` for ``docs(doc_id, text)``, without begin and end ids.

    One row per row. A null text is an empty text, which has no ids. A text of any length is
    encoded whole. Null and repeated ``doc_id`` are passed through; other columns are not read.
    """

    def start():
        segment = _segmenter(model)
        return lambda doc_id, text: {"doc_id": doc_id, "ids": segment([t or "" for t in text])}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_slices(docs.select("doc_id", "text"), start, f"doc_id {kind}, ids array<int>", TEXTS)


def decode(encoded: DataFrame, model: bytes) -> DataFrame:
    """``doc_id, ids, text`` for ``encoded(doc_id, ids)``. Null ids are no ids, and no ids are ''."""

    def start():
        processor = _processor(model)

        def work(doc_id, ids):
            ids = [x or [] for x in ids]
            return {"doc_id": doc_id, "ids": ids, "text": [processor.decode(x) for x in ids]}

        return work

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return map_slices(
        encoded.select("doc_id", "ids"), start, f"doc_id {kind}, ids array<int>, text string", TEXTS
    )


def digests(decoded: DataFrame) -> DataFrame:
    """Counts and digests of what ``decode`` returns."""
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(listed.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
