"""What several operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# Rows a Python worker holds as objects at once.
SLICE = 256

# Lower-cases A-Z and makes every ASCII byte but letters and digits a space; others stay.
WORD_BYTES = bytes(b if b >= 0x80 else ord(chr(b).lower()) if chr(b).isalnum() else 0x20 for b in range(256))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")


def fold(doc_id: Column, folds: int) -> Column:
    """Remainder of the CRC-32 of the id as text. A null id is in fold 0."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)), F.lit(0))


def release() -> None:
    """Give what a task no longer needs back to the machine: its worker lives on, beside the next ones."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # an allocator without it
        pass


def map_slices(
    df: DataFrame,
    fn: Callable[[], Callable[..., dict[str, list]]],
    schema: str,
    rows: int = SLICE,
) -> DataFrame:
    """Run Python over ``df`` in small slices of rows.

    ``fn()`` is called once a task and gives the function that takes one list per column and
    returns one list per column of ``schema``, of any equal length. What it held is given back
    to the machine when the task ends.
    """
    fields = StructType.fromDDL(schema)
    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = fn()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                out = work(*(column.to_pylist() for column in part.columns))
                arrays = [pa.array(out[f.name], type=f.type) for f in arrow]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)
                del part, out, arrays
            del batch
        del work
        release()

    return df.mapInArrow(run, fields)


def ascii_words(text: str | None) -> list[bytes]:
    """Lower-cased A-Z words between ASCII white space, as UTF-8."""
    return text.encode().lower().split() if text else []
