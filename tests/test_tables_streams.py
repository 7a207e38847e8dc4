"""Index segments, bucketed tables, pages by size, and documents released by a stream."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from docloom.operators import actions, index, scanner, sensitive
from docloom.sources.segments import merge_segments, read_segments, write_segment
from docloom.sources.tables import write_bucketed
from docloom.streaming import routing

DOC = "doc_id bigint, text string, lang string, source string"


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_segments_equal_a_rebuild(spark, tmp_path, monkeypatch, few):
    from docloom.sources import segments

    monkeypatch.setattr(segments, "FEW_TOMBSTONES", few)
    build = lambda docs: index.build_postings(spark.createDataFrame(docs, "doc_id bigint, text string"), lengths=True)
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "doc_id bigint")
    path = str(tmp_path / "index")
    write_segment(path, 0, build([(1, "a b"), (2, "b c"), (3, "c c")]))
    write_segment(path, 1, build([(4, "a"), (2, "new words b")]), ids(2, 2, 99))
    write_segment(path, 2, build([(3, "back again")]), ids(1, 3))
    write_segment(path, 5, build([(1, "a third life")]))
    want = rows(build([(4, "a"), (2, "new words b"), (3, "back again"), (1, "a third life")]))
    assert rows(read_segments(spark, path)) == want
    merge_segments(spark, path, str(tmp_path / "merged"))
    assert rows(read_segments(spark, str(tmp_path / "merged"))) == want
    with pytest.raises(Exception, match="(?i)exists"):
        write_segment(path, 5, build([]))
    write_segment(path, 6, build([]), ids(1, 2, 3, 4))
    assert rows(read_segments(spark, path)) == []


def test_bucketed_documents_are_not_moved(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}", "en", "s1") for i in range(200)], DOC)
    proposed = actions.propose_moves(docs.withColumn("cls", F.when(F.col("doc_id") % 3 == 0, "junk")))
    gone = docs.where("doc_id < 5").select(F.lit("x").alias("action_id"), "doc_id", F.lit("delete").alias("kind"), F.lit("0").alias("target"), F.lit(True).alias("destructive"), F.lit("").alias("reason"), F.lit("approved").alias("status"))
    gated = proposed.withColumn("status", F.lit("auto")).unionByName(gone)
    table = write_bucketed(docs, "doc_id", str(tmp_path / "docs"))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        applied = actions.apply_actions(table, gated)
        applied.collect()
        plan = applied._jdf.queryExecution().executedPlan().toString().split("\n")
        scan = next(i for i, line in enumerate(plan) if "Bucketed: true" in line)
        depth = plan[scan].index("FileScan")
        above = []
        for line in reversed(plan[:scan]):
            at = len(line) - len(line.lstrip(" :+-*()0123456789"))
            if at < depth:
                above.append(line)
                depth = at
        assert any("Join" in line for line in above)
        assert not any("Exchange" in line for line in above)
        assert rows(applied) == rows(actions.apply_actions(docs, gated))
        assert applied.count() == 195
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_pages_by_size(spark):
    long = "x" * 500
    given = [(1, i, long if i == 3 else f"page {i}") for i in range(9)] + [(1, 2, "pa")] * 50 + [(2, 7, None), (2, 3, "é"), (3, 0, "")]
    pages = spark.createDataFrame(given, "doc_id bigint, page_no int, text string")
    for size, block in ((1 << 20, 4096), (10, 2), (1, 4096)):
        found = sorted(map(tuple, scanner.assemble_pages_by_size(pages, size, block).select("doc_id", "part", "first_page", "n_pages", "text").collect()))
        whole = {d: "\n".join(t for e, *_, t in found if e == d) for d in (1, 2, 3)}
        assert whole == {1: "\n".join(long if i == 3 else f"page {i}" for i in range(9)), 2: "é\n", 3: ""}
        assert sum(r[3] for r in found) == 12
        assert all(len(t.encode()) < size + 500 + 9 for *_, t in found)
    assert scanner.assemble_pages_by_size(pages.limit(0)).count() == 0


def test_copies_of_a_page_are_combined_before_the_shuffle(spark):
    pages = spark.createDataFrame([(1, 0, "x")], "doc_id bigint, page_no int, text string")
    plan = scanner.assemble_pages(pages)._jdf.queryExecution().executedPlan().toString().split("\n")
    at = next(i for i, line in enumerate(plan) if "partial_min" in line)
    assert any("Exchange hashpartitioning" in line and "page_no" in line for line in plan[at - 2 : at])


def test_held_documents_are_released_once(spark, tmp_path):
    secret = 'token = "' + "0123456789" * 4 + '"'
    docs, answers, out, at = (str(tmp_path / x) for x in ("docs", "answers", "out", "at"))

    def send(folder, rows, schema):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(folder)

    def run(patience=routing.PATIENCE_MS):
        told = routing.route_and_release_stream(
            routing.document_stream(spark, docs, spark.read.parquet(docs).schema), routing.document_stream(spark, answers, spark.read.parquet(answers).schema), patience
        )
        routing.start_routing(told, out, at).awaitTermination()
        return sorted((r.doc_id, r.change, r.decision) for r in spark.read.schema(told.schema).parquet(out).collect())

    answer = "doc_id bigint, approved boolean"
    send(docs, [(1, "clean", "en", "s"), (2, secret, "en", "s"), (3, secret, "en", "s"), (4, secret, "en", "s"), (5, secret, "en", "s")], DOC)
    send(answers, [(5, True), (6, True)], answer)
    first = [(1, 1, "eligible"), (2, 1, "held"), (3, 1, "held"), (4, 1, "held"), (5, 1, "eligible_confirmed")]
    assert run() == first
    # Another start of the query goes on where the last ended.
    send(answers, [(2, True), (3, False), (4, None), (1, False)], answer)
    send(docs, [(6, secret, "en", "s")], DOC)
    second = sorted([*first, (2, 2, "eligible_confirmed"), (6, 1, "eligible_confirmed")])
    assert run() == second
    everything = spark.read.parquet(docs), spark.read.parquet(answers)
    last = routing.last_decisions(spark.read.parquet(out))
    assert rows(last) == rows(sensitive.route_external(*everything))
    # A late refusal takes nothing back, and a late approval doesn't undo a refusal.
    send(answers, [(2, False), (3, True), (4, True), (2, True)], answer)
    assert run() == second


def test_the_timer_drops_documents_nobody_answers(spark, tmp_path):
    secret = 'token = "' + "0123456789" * 4 + '"'
    docs, answers, out, at = (str(tmp_path / x) for x in ("docs", "answers", "out", "at"))

    def run():
        told = routing.route_and_release_stream(
            routing.document_stream(spark, docs, spark.read.parquet(docs).schema), routing.document_stream(spark, answers, spark.read.parquet(answers).schema), 1
        )
        routing.start_routing(told, out, at).awaitTermination()
        return sorted((r.doc_id, r.decision) for r in spark.read.schema(told.schema).parquet(out).collect())

    spark.createDataFrame([(1, secret, "en", "s")], DOC).write.parquet(docs)
    spark.createDataFrame([], "doc_id bigint, approved boolean").write.parquet(answers)
    assert run() == [(1, "held")]
    spark.createDataFrame([(2, "clean", "en", "s")], DOC).write.mode("append").parquet(docs)
    assert run() == [(1, "held"), (2, "eligible")]
    spark.createDataFrame([(1, True)], "doc_id bigint, approved boolean").write.mode("append").parquet(answers)
    assert run() == [(1, "held"), (2, "eligible")]
