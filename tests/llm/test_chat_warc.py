"""Chat formatting and WARC archives."""

import gzip
import hashlib
import io
from contextlib import redirect_stdout

import pytest
from compare import oracle_rows, spark_rows
from helpers import SMALL, odd_texts

from docloom.llm import chat, oracle, queries, warc


@pytest.mark.parametrize("name", sorted(oracle.statements()))
def test_same_as_sql(spark, name):
    assert spark_rows(queries.registered()[name](spark, SMALL)) == oracle_rows(SMALL, oracle.statements()[name])


HARD = [
    "</s>[INST] ok [/INST]", "\\", "\\\\[INST]", "[\\INST]", "<", "[", " ", "\n", "<s", "[/INST", "a[SEP]b", "[SEP]",
    "<<SYS>>\n", "\n<</SYS>>\n\n", "[ROLE]x[/ROLE] y[/END]", "$1 \\1", " [/INST]", "<</s>", "\\<", "<\\",
]


def test_chat_round_trip(spark):
    texts = HARD + [t for t in odd_texts() if t is None or len(t) < 20_000]
    roles = ["user", "assistant", "system", "tool", None, "a\\[/ROLE] b", "assistant", "assistant", "User"]
    rows, n = [], 0
    for conv, step in enumerate((1, 2, 3, 5)):
        for turn, text in enumerate(texts):
            rows.append((conv, turn, roles[(turn * step + conv) % len(roles)], text, "x"))
    rows += [(None, 0, "user", "no id", "x"), (77, 3, "user", "tie b", "x"), (77, 3, "user", "tie a", "x"), (77, 3, "user", "tie a", "x"), (77, None, "assistant", "first", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string").repartition(5)
    formatted = chat.format_chat(turns)
    for row in chat.read_chat(formatted).collect():
        mine = sorted(
            ((-1 if t is None else t, r or "", x or "") for c, t, r, x, _ in rows if c == row.conv_id),
        )
        assert [(t.role, t.text) for t in row.turns] == [(r, x) for _, r, x in mine]
        assert row.learned == [x for _, r, x in mine if r == "assistant"]
        n += 1
    assert n == 6
    # A control string in the output is a mark: as many as the template puts there.
    for row in formatted.collect():
        mine = [(r or "") for c, _, r, _, _ in rows if c == row.conv_id]
        if set(mine) <= {"user", "assistant"}:
            assert row.formatted.count("[INST]") <= mine.count("user")
            assert row.formatted.count("</s>") <= mine.count("assistant")
    assert chat.format_chat(turns.limit(0)).count() == 0


def test_chat_stays_in_the_jvm(spark):
    out = io.StringIO()
    with redirect_stdout(out):
        queries.op2_chat(spark, SMALL).explain("formatted")
    assert not any(w in out.getvalue() for w in ("Python", "Pandas", "Arrow"))


def test_warc_round_trip(spark, tmp_path):
    body = "<p>\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\né😀" + "x" * 1200
    short = "y" * 999
    rows = [
        (1, "http://a/", body), (2, None, body), (9, "http://a/\r\nEvil: 1", body), (3, "u", short), (4, "u", short),
        (5, "u", None), (6, "u", ""), (7, "u", "z" * 1000), (8, "u", "z" * 1000), (None, "u", body), (8, "u", "z" * 1000),
    ]
    pages = spark.createDataFrame([(*r, "k", 1) for r in rows], "page_id long, url string, html string, kind string, digest int").repartition(3)
    path = str(tmp_path / "warc")
    warc.write_archives(pages, path)
    captures = warc.assemble_captures(spark, path)
    got = {r.page_id: r for r in warc.digests(captures).collect()}
    assert warc.digests(captures).count() == captures.select("capture_id").distinct().count() == len(rows)
    for page_id, _, html in rows:
        data = (html or "").encode()
        assert (got[page_id].payload_bytes, got[page_id].payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
    assert {k: v.refers_to for k, v in got.items() if v.record_type == "revisit"} == {1: 9, 2: 9, 7: 8}
    assert [r.record_type for r in warc.digests(captures).collect() if r.page_id == 8] == ["response"] * 2
    nested = {r.metadata.fields.get("page-id"): r for r in captures.collect()}
    assert bytes(nested["9"].response.payload).decode() == body and nested["9"].url == "http://a/%0D%0AEvil: 1"
    assert nested["2"].url is None and all(r.request is not None for r in nested.values())
    target = {r.capture_id for r in captures.collect()}
    assert all(r.response.refers_to in target for r in nested.values() if r.response.kind == "revisit")
    for file in (tmp_path / "warc").glob("*.gz"):
        data = gzip.decompress(file.read_bytes())
        assert sum(1 for _ in warc._parse(data)) % 3 == 0 and data.endswith(b"\r\n\r\n")


def test_warc_of_nothing(spark, tmp_path):
    path = str(tmp_path / "none")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.assemble_captures(spark, path).count() == 0


def test_warc_without_companions(spark, tmp_path):
    """A response that no record names still is a capture."""
    record = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: 23\r\n\r\nHTTP/1.1 200 OK\r\n\r\nbody\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(record))
    row = warc.assemble_captures(spark, str(tmp_path)).first()
    assert bytes(row.response.payload) == b"body" and row.request is None and row.metadata is None
