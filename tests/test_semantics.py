"""Edge cases: empty input, NULL text, ties, missing confirmations, invariants."""

import hashlib

import pytest
from pyspark.sql import functions as F

from docloom.functions.text import lines
from docloom.operators import actions, classify, conversations, index, scanner, search, sensitive

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
TURNS = "conv_id bigint, turn bigint, role string, text string"
POSTINGS = "term string, doc_id bigint, tf bigint"
PROPOSALS = "action_id string, doc_id bigint, kind string, target string, destructive boolean, reason string"
FOLDER = "/root/testdata/sf0.001"


def make(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def documents(spark, *texts):
    return make(spark, DOCS, *[(i, t, "en", "s0", len(t or "")) for i, t in enumerate(texts)])


def test_empty_input_gives_an_empty_table_with_its_schema(spark):
    docs, turns, post = (make(spark, s) for s in (DOCS, TURNS, POSTINGS))
    props = make(spark, PROPOSALS)
    labels = make(spark, "doc_id bigint, quality int, toxic int")
    conf = make(spark, "doc_id bigint, approved boolean")
    queries = make(spark, "qid int, term string")
    vecs = make(spark, "vec_id bigint, embedding array<float>")
    qvecs = make(spark, "qid bigint, embedding array<double>")
    pages = make(spark, "doc_id bigint, page_no int, text string")
    hits = make(spark, "qid int, doc_id bigint, score double, rank int")
    classes = make(spark, "doc_id bigint, cls string")
    gated = actions.gate_actions(props, make(spark, "action_id string, approved boolean"))
    model = classify.train_nb(post, labels, "toxic")
    results = {
        "conv_id,part,n_turns,first_role,last_role,transcript": conversations.conversation_threads(turns),
        "conv_id,turn,role,ctx": conversations.context_window(turns),
        "conv_id,turn,term,weight": conversations.context_query_terms(turns, post),
        "term,doc_id,tf": index.build_postings(docs),
        "term,df,cf,idf": index.term_stats(post),
        "doc_id,term,weight,rank": index.keywords_topk(post),
        "doc_id,n_chars,n_words,n_lines,symbol_ratio,uniq_line_ratio": index.doc_profile(docs),
        "doc_id": search.boolean_search(post, all=["a"]),
        "qid,doc_id,score,rank": search.bm25_search(post, queries),
        "qid,doc_id,score,rank ": search.metadata_search(docs, hits, 3, lang="en"),
        "doc_id,item_id": search.phrase_search(docs, make(spark, "item_id bigint, text string", (1, "a b"))),
        "qid,vec_id,score,rank": search.vector_search(vecs, qvecs),
        "qid,vec_id,score,rank ": search.vector_search(vecs, qvecs, few=-1),
        "conv_id,turn,doc_id,score,rank": search.contextual_search(turns, post),
        "lang,source,n": search.search_facets(docs, hits),
        "doc_id,cls": classify.classify_rules(docs),
        "y,term,logp,log_prior": classify.nb_rows(model),
        "doc_id,pred,score": classify.score_nb(model, post, docs),
        "doc_id,cls,provenance": classify.resolve_predictions(
            make(spark, "doc_id bigint, cls string, version int"), classes
        ),
        "y,tp,fp,fn,precision,recall,f1": classify.evaluate_classifier(
            make(spark, "doc_id bigint, pred int"), labels, "toxic"
        ),
        "name,passed,reason": classify.capability_gate(
            make(spark, "name string, candidate double, baseline double, floor double")
        ),
        "doc_id,kind,ord,value_hash,value_masked": sensitive.find_sensitive_spans(docs),
        "doc_id,n_spans,kinds,level": sensitive.sensitivity_label(docs),
        "doc_id,text,lang,source,n_chars": sensitive.mask_sensitive(docs, "text"),
        "doc_id,level,decision": sensitive.route_external(docs, conf),
        "source,decision,n": sensitive.egress_audit(sensitive.route_external(docs, conf), docs),
        "action_id,doc_id,kind,target,destructive,reason": actions.propose_moves(docs, classes),
        "action_id,doc_id,kind,target,destructive,reason ": actions.propose_tags(index.keywords_topk(post)),
        "action_id,doc_id,kind,target,destructive,reason  ": actions.propose_dedup(docs),
        "action_id,doc_id,kind,target,destructive,reason,status": gated,
        "doc_id,text,lang,source,n_chars,tags": actions.apply_actions(docs, gated),
        "kind,status,n": actions.action_summary(gated),
        "doc_id,part,n_pages,text": scanner.assemble_pages(pages),
        "doc_id,page_no": scanner.missing_pages(pages),
        "doc_id,text,n_dropped": scanner.clean_ocr_text(docs),
    }
    for columns, df in results.items():
        assert df.columns == columns.strip().split(",")
        assert df.collect() == [], columns
    scores = classify.evaluate_search(hits, make(spark, "qid int, doc_id bigint"), 3).collect()
    assert [tuple(r) for r in scores] == [(0, None, None)]


def test_null_and_blank_texts(spark):
    docs = documents(spark, None, "", " \n ", "Ünï 42!")
    got = {r["doc_id"]: tuple(r)[1:] for r in index.doc_profile(docs).collect()}
    assert got[0] == got[1] == (0, 0, 1, None, None)
    assert got[2] == (3, 0, 2, 0.0, 0.5)
    assert got[3] == (7, 2, 1, round(1 / 7, 6), 1.0)
    assert {tuple(r) for r in index.build_postings(docs).collect()} == {("ünï", 3, 1), ("42", 3, 1)}
    assert {r["level"] for r in sensitive.sensitivity_label(docs).collect()} == {"none"}
    assert {r["cls"] for r in classify.classify_rules(documents(spark, None, "")).collect()} == {"general"}
    masked = {r["doc_id"]: r["text"] for r in sensitive.mask_sensitive(docs, "text").collect()}
    assert masked[0] is None and masked[1] == ""
    cleaned = {r["doc_id"]: tuple(r)[1:] for r in scanner.clean_ocr_text(docs).collect()}
    assert cleaned == {0: ("", 0), 1: ("", 0), 2: (" \n ", 0), 3: ("Ünï 42!", 0)}
    assert actions.propose_dedup(docs).count() == 0


def test_spans(spark):
    texts = [
        "x@y.com9z@w.org a.b@c.d e@f.co",
        "4111111111111111 4111111111111112 é4111111111111111 14111111111111111",
        'TOKEN = "' + "a" * 40 + '" and +1 (555) 123-4567 at 10.0.0.1',
        "no" * 3000,
    ]
    docs = documents(spark, *texts)
    got = {}
    for r in sensitive.find_sensitive_spans(docs).collect():
        got.setdefault((r["doc_id"], r["kind"]), {})[r["ord"]] = (r["value_hash"], r["value_masked"])
    digest = lambda v: hashlib.sha256(v.encode()).hexdigest()
    want = {
        (0, "email"): ["x@y.com", "9z@w.org", "e@f.co"],
        (1, "card"): ["4111111111111111", "4111111111111111"],
        (2, "secret"): ['TOKEN = "' + "a" * 40 + '"'],
        (2, "phone"): ["+1 (555) 123-4567"],
        (2, "ip"): ["10.0.0.1"],
    }
    assert got == {
        key: {i: (digest(v), v[:2] + "*" * (len(v) - 2)) for i, v in enumerate(values)}
        for key, values in want.items()
    }
    labels = {r["doc_id"]: (r["n_spans"], r["kinds"], r["level"]) for r in sensitive.sensitivity_label(docs).collect()}
    assert labels == {
        0: (3, "email", "medium"), 1: (2, "card", "high"), 2: (3, "ip,phone,secret", "high"), 3: (0, "", "none"),
    }
    masked = {r["doc_id"]: r["text"] for r in sensitive.mask_sensitive(docs, "text").collect()}
    assert masked[0] == "[EMAIL][EMAIL] a.b@c.d [EMAIL]"
    assert masked[1] == "[CARD] 4111111111111112 é[CARD] 14111111111111111"
    assert masked[2] == "[SECRET] and [PHONE] at [IP]"


def test_long_run_without_at_sign_stays_fast(spark):
    docs = documents(spark, "a" * 300_000 + " x@y.com")
    assert sensitive.sensitivity_label(docs).first()["kinds"] == "email"


def test_confirmations(spark):
    docs = documents(spark, *["a@b.com"] * 5, "calm")
    conf = make(
        spark, "doc_id bigint, approved boolean",
        (0, True), (1, True), (1, False), (2, None), (3, True), (3, None), (5, False),
    )
    got = {r["doc_id"]: r["decision"] for r in sensitive.route_external(docs, conf).collect()}
    assert got == {0: "eligible_confirmed", 1: "held", 2: "held", 3: "held", 4: "held", 5: "eligible"}
    audit = sensitive.egress_audit(sensitive.route_external(docs, conf), docs).collect()
    assert [r["n"] for r in audit if r["source"] == "*" and r["decision"] == "*"] == [6]


def test_gate_and_apply(spark):
    docs = documents(spark, *"abcdefg")
    props = make(
        spark, PROPOSALS,
        ("a1", 0, "delete", "9", True, ""), ("a2", 1, "delete", "9", True, ""), ("a3", 2, "delete", "9", True, ""),
        ("a4", 3, "delete", "9", True, ""), ("a5", 0, "move", "x", False, ""), ("b2", 4, "move", "late", False, ""),
        ("b1", 4, "move", "early", False, ""), ("c1", 4, "tag", "t2", False, ""), ("c2", 4, "tag", "t1", False, ""),
    )
    answers = make(
        spark, "action_id string, approved boolean",
        ("a1", True), ("a2", True), ("a2", False), ("a3", True), ("a3", None),
    )
    gated = actions.gate_actions(props, answers)
    status = {r["action_id"]: r["status"] for r in gated.collect()}
    assert [status[f"a{i}"] for i in range(1, 6)] == ["approved", "rejected", "pending", "pending", "auto"]
    after = {r["doc_id"]: (r["source"], r["tags"]) for r in actions.apply_actions(docs, gated).collect()}
    assert 0 not in after and len(after) == 6
    assert after[4] == ("early", "t1,t2") and after[1] == ("s0", "")


def test_dedup_keeps_the_lowest(spark):
    docs = documents(spark, "Same text", "other", "same  TEXT!", "same text", "", "!!")
    got = sorted((r["doc_id"], r["target"]) for r in actions.propose_dedup(docs).collect())
    assert got == [(2, "0"), (3, "0")]


def test_documents_are_conserved(spark):
    import __spark_entry__ as contract

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    gated = contract.queries()["gate_actions"](spark, FOLDER).cache()
    deleted = gated.where("kind = 'delete' and status = 'approved'").select("doc_id").distinct().count()
    assert docs.count() == actions.apply_actions(docs, gated).count() + deleted


def test_no_raw_value_leaves(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    masked = sensitive.mask_sensitive(docs, "text")
    assert sensitive.find_sensitive_spans(masked).count() == 0
    assert sensitive.find_sensitive_spans(docs).count() > 0


def test_pages_round_trip(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    pages = docs.select("doc_id", F.posexplode(lines("text")).alias("page_no", "text"))
    back = scanner.assemble_pages(pages).select("doc_id", "text")
    assert docs.select("doc_id", "text").exceptAll(back).count() == 0
    parts = scanner.assemble_pages(pages, part_pages=2)
    # Every part tells how many pages the document has.
    assert parts.select("doc_id", "n_pages").distinct().agg(F.sum("n_pages")).first()[0] == pages.count()
    assert parts.count() == pages.selectExpr("doc_id", "page_no div 2").distinct().count()


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_page_gaps(spark, block):
    pages = make(spark, "doc_id bigint, page_no int, text string",
                 (1, 0, "a"), (1, 4, "b"), (1, 4, "bb"), (2, 7, "c"), (3, 0, "d"))
    got = sorted(map(tuple, scanner.missing_pages(pages, block).collect()))
    assert got == [(1, 1), (1, 2), (1, 3)] + [(2, i) for i in range(7)]
    best = {(r["doc_id"], r["text"]) for r in scanner.assemble_pages(pages).collect()}
    assert (1, "a\nbb") in best


def test_clean_lines(spark):
    docs = documents(spark, "b\na\n\nb\n\n####\na\nc#")
    row = scanner.clean_ocr_text(docs).first()
    assert (row["text"], row["n_dropped"]) == ("b\na\n\n\nc#", 3)


def test_remote_answers(spark):
    remote = make(spark, "doc_id bigint, cls string, version int",
                  (1, "old", 1), (1, "new", 2), (2, None, 3), (3, "b", 1), (3, "a", 1), (9, "far", 1))
    local = make(spark, "doc_id bigint, cls string", (1, "l"), (2, "l"), (3, "l"), (4, "l"))
    got = {r["doc_id"]: (r["cls"], r["provenance"]) for r in classify.resolve_predictions(remote, local).collect()}
    assert got == {1: ("new", "remote"), 2: ("l", "local"), 3: ("a", "remote"), 4: ("l", "local"), 9: ("far", "remote")}


def test_gate_reasons(spark):
    metrics = make(spark, "name string, candidate double, baseline double, floor double",
                   ("a", 0.9, 0.8, 0.5), ("b", 0.4, 0.1, 0.5), ("c", 0.7, 0.8, 0.5), ("d", None, 0.1, 0.1), ("e", 0.5, 0.5, 0.5))
    got = {r["name"]: (r["passed"], r["reason"]) for r in classify.capability_gate(metrics).collect()}
    assert got == {"a": (True, "ok"), "b": (False, "below floor"), "c": (False, "below baseline"),
                   "d": (False, "missing value"), "e": (True, "ok")}


def test_naive_bayes_prior_and_tie(spark):
    post = make(spark, POSTINGS, ("a", 1, 2), ("b", 2, 2), ("zz", 3, 1), ("a", 4, 1), ("b", 4, 1))
    labels = make(spark, "doc_id bigint, y int", (1, 0), (2, 1))
    docs = make(spark, "doc_id bigint", (1,), (2,), (3,), (4,))
    model = classify.train_nb(post, labels, "y", holdout=None)
    got = {r["doc_id"]: (r["pred"], r["score"]) for r in classify.score_nb(model, post, docs).collect()}
    assert (got[1][0], got[2][0]) == (0, 1)
    assert got[3] == (0, -0.693) and got[4][0] == 0


def test_boolean_search(spark):
    post = make(spark, POSTINGS, ("a", 1, 1), ("b", 1, 1), ("a", 2, 1), ("c", 2, 1), ("b", 3, 1), ("c", 3, 1))
    found = lambda **kw: sorted(r[0] for r in search.boolean_search(post, **kw).collect())
    assert found(all=["a"]) == [1, 2]
    assert found(all=["a", "b"]) == [1]
    assert found(any=["b", "c"], none=["a"]) == [3]
    assert found(none=["a"]) == []
    assert found(all=["nope"]) == []
