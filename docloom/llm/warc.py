"""WARC archives: writing pages as records, and assembling captures from records.

Each page becomes three records: the response (or a revisit, where an equal payload is stored
elsewhere), the request, and metadata. Request and metadata name the response in
``WARC-Concurrent-To``. Reading parses records wherever they are, and joins the three kinds through
these identifiers into one nested row per capture.

Archives are gzip files that Spark's text sink writes with ``\\r\\n\\r\\n`` behind each row, the end
that the format wants, and are read as binary files, so they may lie wherever Spark can write. A
file is read whole by one task; files are small because each write task makes its own.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# Payloads from this many bytes on are stored once.
REVISIT_BYTES = 1000
ROWS_PER_FILE = 2_000
_DATE = "2026-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _uuid(*parts: Column) -> Column:
    """An identifier made from the capture's own data, so that a task run again gives the same."""
    h = F.md5(F.concat_ws("\n", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """A header line; nothing where the value is null. Line ends in a value are percent-encoded."""
    plain = F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), plain, F.lit("\r\n")), F.lit(""))


def _record(kind: Column, record_id: Column, lines: list[Column], block: Column) -> Column:
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", kind),
        _line("WARC-Record-ID", record_id),
        _line("WARC-Date", F.lit(_DATE)),
        *lines,
        _line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    )


def plan_captures(pages: DataFrame) -> DataFrame:
    """``page_id, url, payload, digest, refers_to, nth``: which page's response each page revisits.

    Of pages with equal payloads of at least ``REVISIT_BYTES`` the one with the largest
    ``page_id`` is stored. Payloads are compared by digest; only ids and digests are grouped.
    ``nth`` tells rows apart that repeat a page: it counts where the join has already put them.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    full = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    large = full.where((F.octet_length("payload") >= REVISIT_BYTES) & F.col("page_id").isNotNull()).select("page_id", "digest")
    stored = large.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    again = large.join(stored, "digest").where(F.col("page_id") != F.col("refers_to"))
    again = again.groupBy("page_id", "digest").agg(F.max("refers_to").alias("refers_to"))
    nth = F.row_number().over(Window.partitionBy("page_id", "digest").orderBy("digest"))
    return full.join(again, ["page_id", "digest"], "left").withColumn("nth", nth)


def capture_records(planned: DataFrame) -> DataFrame:
    """One string column: the three records of each capture."""
    response_id = _uuid(F.lit("response"), F.col("page_id"), F.col("digest"), F.col("nth"))
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length("payload").cast("string"),
        F.lit("\r\n\r\n"),
    )
    url = _line("WARC-Target-URI", F.col("url"))
    response = _record(
        F.when(revisit, "revisit").otherwise("response"),
        response_id,
        [
            url,
            _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
            _line("WARC-Profile", F.when(revisit, F.lit(_PROFILE))),
            _line("WARC-Refers-To", F.when(revisit, _uuid(F.lit("response"), F.col("refers_to"), F.col("digest"), F.lit(1)))),
            _line("Content-Type", F.lit("application/http; msgtype=response")),
        ],
        F.when(revisit, http).otherwise(F.concat(http, F.col("payload"))),
    )
    beside = _line("WARC-Concurrent-To", response_id)
    request = _record(
        F.lit("request"),
        _uuid(F.lit("request"), F.col("page_id"), F.col("digest"), F.col("nth")),
        [url, beside, _line("Content-Type", F.lit("application/http; msgtype=request"))],
        F.lit("GET / HTTP/1.1\r\n\r\n"),
    )
    metadata = _record(
        F.lit("metadata"),
        _uuid(F.lit("metadata"), F.col("page_id"), F.col("digest"), F.col("nth")),
        [url, beside, _line("Content-Type", F.lit("application/warc-fields"))],
        F.concat(
            _line("page-id", F.col("page_id").cast("string")),
            _line("refers-to-page-id", F.col("refers_to").cast("string")),
        ),
    )
    return planned.select(F.concat_ws("\r\n\r\n", response, request, metadata).alias("value"))


def write_archives(pages: DataFrame, path: str) -> None:
    """Write ``pages(page_id, url, html)`` as gzipped WARC files.

    A null html is an empty payload, a null url has no target header. Pages without ``page_id``
    are stored in full. A row that occurs twice is two captures. Other columns are not read.
    """
    records = capture_records(plan_captures(pages))
    (
        records.write.option("lineSep", "\r\n\r\n")
        .option("compression", "gzip")
        .option("maxRecordsPerFile", ROWS_PER_FILE)
        .text(path)
    )


def _parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive."""
    data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")[1:]
        headers = dict(line.split(": ", 1) for line in lines)
        size = int(headers["Content-Length"])
        yield headers, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


_RECORD = (
    "record_id string, kind string, concurrent_to string, refers_to string, url string, "
    "digest string, fields map<string,string>, payload binary"
)
# Bytes of payload in one batch to Spark.
_BATCH = 16 << 20


def read_records(spark: SparkSession, path: str, kinds: tuple[str, ...]) -> DataFrame:
    """The records of the given kinds in the archives of a folder."""
    schema = StructType.fromDDL(_RECORD)
    arrow = to_arrow_schema(schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for content in batch.column(0):
                for headers, block in _parse(content.as_py()):
                    if headers["WARC-Type"] not in kinds:
                        continue
                    fields, payload = block, b""
                    if headers["Content-Type"].startswith("application/http"):
                        fields, _, payload = block.partition(b"\r\n\r\n")
                    pairs = [x.partition(": ")[::2] for x in fields.decode().split("\r\n") if ": " in x]
                    digest = headers.get("WARC-Payload-Digest", "").removeprefix("sha1:") or None
                    held.append(
                        (headers["WARC-Record-ID"], headers["WARC-Type"], headers.get("WARC-Concurrent-To"),
                         headers.get("WARC-Refers-To"), headers.get("WARC-Target-URI"), digest, pairs, payload)
                    )
                    size += len(payload)
                    if size > _BATCH or len(held) >= 5_000:
                        yield _table(held)
                        held, size = [], 0
        if held:
            yield _table(held)

    def _table(held: list) -> pa.RecordBatch:
        columns = [pa.array(c, type=f.type) for c, f in zip(zip(*held, strict=True), arrow, strict=True)]
        return pa.RecordBatch.from_arrays(columns, schema=arrow)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(rows, schema)


def assemble_captures(spark: SparkSession, path: str) -> DataFrame:
    """``capture_id, url, response, request, metadata``: one nested row per capture.

    The response or revisit stands first; request and metadata are those that name it, null where
    there is none. Record identifiers are unique, as the format wants. Archives without records
    give no rows.
    """

    def only(kinds: tuple[str, ...], key: str, *columns: str) -> DataFrame:
        found = read_records(spark, path, kinds)
        return found.select(F.col(key).alias("capture_id"), F.struct(*columns).alias(kinds[-1]))

    main = read_records(spark, path, ("revisit", "response")).select(
        F.col("record_id").alias("capture_id"), "url", F.struct("kind", "digest", "refers_to", "fields", "payload").alias("response")
    )
    request = only(("request",), "concurrent_to", "record_id", "fields")
    metadata = only(("metadata",), "concurrent_to", "record_id", "fields")
    return main.join(request, "capture_id", "left").join(metadata, "capture_id", "left")


def digests(captures: DataFrame) -> DataFrame:
    """What the archives say of each page; digests of payloads that are there are made anew."""
    stored = F.col("response.kind") == "response"
    http_length = F.element_at("response.fields", F.lit("Content-Length")).cast("long")
    refers = F.try_element_at("metadata.fields", F.lit("refers-to-page-id")).cast("long")
    return captures.select(
        F.try_element_at("metadata.fields", F.lit("page-id")).cast("long").alias("page_id"),
        F.when(stored, F.length("response.payload").cast("long")).otherwise(http_length).alias("payload_bytes"),
        F.when(stored, F.sha1("response.payload")).otherwise(F.col("response.digest")).alias("payload_digest"),
        F.col("response.kind").alias("record_type"),
        refers.alias("refers_to"),
    )
