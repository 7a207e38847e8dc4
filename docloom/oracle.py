"""DuckDB SQL giving the result each registered query must give."""

from __future__ import annotations

SECRET = r'(?i)(token|secret|password|api_key) = "[0-9a-f]{40}"'
CARD = r"\b[0-9]{16}\b"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"\+?[0-9]{1,3} \([0-9]{3}\) [0-9]{3}-[0-9]{4}"
IP = r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b"
TOKEN_GAP = r"[^\p{L}\p{N}]+"
SYMBOL = r"[^\p{L}\p{N}\s]"
LICENSE = r"(?i)(licensed under|released under|all rights reserved)"
TOXIC_WORDS = ("trash", "clown", "idiot", "scum", "worthless", "moron", "pathetic", "loser")
ALL_TERMS, ANY_TERMS, NONE_TERMS = ["the", "of"], ["tion", "thon", "ing"], ["thed", "la"]
TOP = 10
GATE_FLOOR = 0.5


def _tokens(text: str) -> str:
    return f"list_filter(string_split_regex(lower({text}), '{TOKEN_GAP}'), lambda x: x <> '')"


def _norm(text: str) -> str:
    return f"(' ' || trim(lower(regexp_replace({text}, '{TOKEN_GAP}', ' ', 'g'))) || ' ')"


def _symbols(text: str) -> str:
    kept = f"length(regexp_replace({text}, '{SYMBOL}', '', 'g'))"
    return f"round((length({text}) - {kept})::double / nullif(length({text}), 0), 6)"


def _listed(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


_LUHN = (
    "list_sum(list_transform(range(1, 17), lambda i: case when i % 2 = 0 then substr({v}, i, 1)::int"
    " when 2 * substr({v}, i, 1)::int > 9 then 2 * substr({v}, i, 1)::int - 9"
    " else 2 * substr({v}, i, 1)::int end)) % 10 = 0"
)


def _luhn(value: str) -> str:
    return _LUHN.replace("{v}", value)


_TOK = f"tok as (select doc_id, unnest({_tokens('text')}) as term from documents)"
_POST = f"{_TOK}, post as (select term, doc_id, count(*) as tf from tok group by term, doc_id)"
_SIZES = (
    "dl as (select doc_id, sum(tf) as dl from post group by doc_id),"
    " tot as (select count(*) as n, avg(dl) as avgdl from dl),"
    " df as (select term, count(*) as df, sum(tf)::bigint as cf from post group by term)"
)
_KEY = (
    f"{_POST}, {_SIZES}, kw as (select doc_id, term, weight, rank::int as rank from ("
    "select doc_id, term, weight, row_number() over (partition by doc_id order by weight desc, term) as rank"
    " from (select p.doc_id, p.term, round(p.tf * ln(tot.n::double / df.df), 6) as weight"
    " from post p join df using (term), tot)) )"
)
_BM25 = (
    "sum({w} * ln(1 + (tot.n - df.df + 0.5) / (df.df + 0.5))"
    " * p.tf * 2.2 / (p.tf + 1.2 * (1 - 0.75 + 0.75 * dl.dl / tot.avgdl)))"
)


def _passages(k: int, where: str = "true") -> str:
    return (
        f"{_POST}, {_SIZES},"
        f" q as (select item_id as qid, unnest(list_distinct({_tokens('text')})) as term from benchmark),"
        f" sc as (select q.qid, p.doc_id, round({_BM25.replace('{w}', '1.0')}, 6) as score"
        " from q join post p using (term) join df using (term) join dl using (doc_id), tot"
        f" where {where} group by q.qid, p.doc_id),"
        " hits as (select * from (select qid, doc_id, score, row_number() over"
        f" (partition by qid order by score desc, doc_id)::int as rank from sc) where rank <= {k})"
    )


_TRUTH = (
    f"truth as (select b.item_id as qid, d.doc_id from (select doc_id, {_norm('text')} as t from documents) d"
    f" join (select item_id, {_norm('text')} as t from benchmark) b on contains(d.t, b.t) where b.t <> '  ')"
)
_KINDS = {"secret": SECRET, "card": CARD, "email": EMAIL, "phone": PHONE, "ip": IP}


def _values(kind: str) -> str:
    found = f"regexp_extract_all(text, '{_KINDS[kind]}')"
    if kind == "card":
        return f"list_filter({found}, lambda v: {_luhn('v')})"
    return found


_SPANS = "spans as (" + " union all ".join(
    f"select doc_id, '{kind}' as kind, unnest(range(len(v))) as ord, unnest(v) as value"
    f" from (select doc_id, {_values(kind)} as v from documents)"
    for kind in _KINDS
) + ")"
_LEVELS = (
    f"{_SPANS}, per as (select doc_id, count(*) as n, string_agg(distinct kind, ',' order by kind) as kinds,"
    " bool_or(kind in ('secret', 'card')) as high from spans group by doc_id),"
    " lab as (select d.doc_id, d.source, coalesce(per.n, 0) as n_spans, coalesce(per.kinds, '') as kinds,"
    " case when per.high then 'high' when per.n > 0 then 'medium' else 'none' end as level"
    " from documents d left join per using (doc_id))"
)
_CONF = "conf as (select doc_id, quality = 1 and toxic = 0 as approved from labels)"
_ROUTED = (
    f"{_LEVELS}, {_CONF}, routed as (select lab.doc_id, lab.source, level, case when level = 'none' then 'eligible'"
    " when approved then 'eligible_confirmed' else 'held' end as decision"
    " from lab left join conf using (doc_id))"
)
_TOXIC = f"len(list_intersect({_tokens('text')}, [{_listed(TOXIC_WORDS)}])) > 0"
_CLASSES = (
    "cls as (select doc_id, source, case"
    f" when len({_values('secret')}) > 0 then 'credential' when len({_values('card')}) > 0 then 'payment'"
    f" when len({_values('email')}) > 0 or len({_values('phone')}) > 0 then 'contact'"
    f" when regexp_matches(text, '{LICENSE}') then 'license' when {_symbols('text')} > 0.06 then 'junk'"
    f" when {_TOXIC} then 'toxic' else 'general' end as cls from documents)"
)


def _nb(target: str) -> str:
    return (
        f"{_POST}, tr as (select doc_id, {target} as y from labels where doc_id % 5 <> 0),"
        " c as (select term, coalesce(sum(tf) filter (y = 0), 0) as c0, coalesce(sum(tf) filter (y = 1), 0) as c1"
        " from post join tr using (doc_id) group by term),"
        " s as (select sum(c0) as s0, sum(c1) as s1, count(*) as v from c),"
        " lp as (select term, ln((c0 + 1.0)::double / (s0 + v)) as l0, ln((c1 + 1.0)::double / (s1 + v)) as l1 from c, s),"
        " pr as (select ln(count(*) filter (y = 0)::double / count(*)) as p0,"
        " ln(count(*) filter (y = 1)::double / count(*)) as p1 from tr),"
        " su as (select doc_id, sum(tf * l0) as a0, sum(tf * l1) as a1 from post join lp using (term) group by doc_id),"
        " sb as (select doc_id, round(p0 + coalesce(a0, 0), 3) as t0, round(p1 + coalesce(a1, 0), 3) as t1"
        " from documents left join su using (doc_id), pr),"
        " nb as (select doc_id, case when t1 > t0 then 1 else 0 end as pred, greatest(t0, t1) as score from sb)"
    )


def _scores(pairs: str) -> str:
    """Scores per class from a relation of (pred, y) rows."""
    return (
        f"select y, tp, fp, fn, round(tp::double / nullif(tp + fp, 0), 6) as precision,"
        " round(tp::double / nullif(tp + fn, 0), 6) as recall,"
        " round(2.0::double * tp / nullif(2 * tp + fp + fn, 0), 6) as f1 from ("
        " select k.y, count(*) filter (p.pred = k.y and p.y = k.y) as tp,"
        " count(*) filter (p.pred = k.y and p.y <> k.y) as fp,"
        " count(*) filter (p.pred <> k.y and p.y = k.y) as fn"
        f" from (select pred as y from {pairs} union select y from {pairs}) k, {pairs} p group by k.y)"
    )


def _action(kind: str, target: str, destructive: str, reason: str, source: str) -> str:
    return (
        f"select sha256('{kind}:' || doc_id || ':' || {target}) as action_id, doc_id, '{kind}' as kind,"
        f" ({target})::varchar as target, {destructive} as destructive, {reason} as reason from {source}"
    )


_MOVES = _action("move", "cls", "false", "'class ' || cls", "cls where source <> cls")
_TAGS = _action("tag", "term", "false", "'top keyword'", "kw where rank = 1")
_COPIES = (
    f"copies as (select doc_id, min(doc_id) over (partition by {_norm('text')}) as kept"
    f" from documents where {_norm('text')} <> '  ')"
)
_DELETES = _action("delete", "kept", "true", "'same text'", "copies where doc_id <> kept")
_GATED = (
    f"{_KEY}, {_CLASSES}, {_COPIES}, {_CONF},"
    f" prop as ({_MOVES} union all {_TAGS} union all {_DELETES}),"
    " gated as (select prop.*, case when not destructive then 'auto' when approved then 'approved'"
    " when not approved then 'rejected' else 'pending' end as status from prop left join conf using (doc_id))"
)
_LINES = "unnest(string_split(text, chr(10))) as text, unnest(range(len(string_split(text, chr(10))))) as page_no"
_SAID = "role || ':' || text"
_ASKED = (
    f"asked as (select conv_id, turn, row_number() over (partition by conv_id order by turn) as u,"
    f" list_distinct({_tokens('text')}) as own from conversations where role = 'user'),"
    " used as (select a.conv_id, a.turn, unnest(p.own) as term, pow(0.5, a.u - p.u) as w"
    " from asked a join asked p on a.conv_id = p.conv_id and p.u between a.u - 2 and a.u),"
    " wt as (select conv_id, turn, term, sum(w) as weight from used group by conv_id, turn, term),"
    " cq as (select conv_id, turn, term, weight from wt join df using (term))"
)


def statements() -> dict[str, str]:
    masked = f"regexp_replace(text, '{SECRET}', '[SECRET]', 'g')"
    glued = (
        f"array_to_string(list_transform(list_zip(string_split_regex(a, '{CARD}'), regexp_extract_all(a, '{CARD}')),"
        f" lambda z: z[1] || coalesce(case when {_luhn('z[2]')} then '[CARD]' else z[2] end, '')), '')"
    )
    return {
        "conversation_threads": "with w as (select conv_id, count(*) as n_turns, arg_min(role, turn) as first_role,"
        " arg_max(role, turn) as last_role from conversations group by conv_id)"
        f" select conv_id, (turn // 3)::bigint as part, n_turns, first_role, last_role,"
        f" string_agg({_SAID}, chr(10) order by turn) as transcript"
        " from conversations join w using (conv_id) group by conv_id, part, n_turns, first_role, last_role",
        "context_window": "select conv_id, turn, role, coalesce(array_to_string(list("
        f"{_SAID}) over (partition by conv_id order by turn rows between 3 preceding and 1 preceding), chr(10)), '')"
        " as ctx from conversations",
        "context_query_terms": f"with {_POST}, {_SIZES}, {_ASKED} select * from cq",
        "build_postings": f"with {_POST} select term, doc_id, tf from post",
        "index_segments": f"with {_POST} select term, doc_id, tf from post where doc_id % 11 <> 0",
        "term_stats": f"with {_POST}, {_SIZES} select term, df, cf, round(ln(n::double / df), 6) as idf from df, tot",
        "keywords_topk": f"with {_KEY} select doc_id, term, weight, rank from kw where rank <= 5",
        "doc_profile": f"select doc_id, length(text) as n_chars, len({_tokens('text')}) as n_words,"
        f" len(string_split(text, chr(10))) as n_lines, {_symbols('text')} as symbol_ratio,"
        " case when length(text) > 0 then round(len(list_distinct(string_split(text, chr(10))))::double"
        " / len(string_split(text, chr(10))), 6) end as uniq_line_ratio from documents",
        "boolean_search": f"with {_TOK}, sets as (select doc_id, list(distinct term) as t from tok group by doc_id)"
        f" select doc_id from sets where list_has_all(t, [{_listed(ALL_TERMS)}])"
        f" and list_has_any(t, [{_listed(ANY_TERMS)}]) and not list_has_any(t, [{_listed(NONE_TERMS)}])",
        "bm25_search": f"with {_passages(TOP)} select * from hits",
        "metadata_search": f"with {_CLASSES}, may as (select doc_id from documents join cls using (doc_id)"
        " where lang = 'en' and cls = 'general'),"
        f" {_passages(TOP, 'p.doc_id in (select doc_id from may)')} select * from hits",
        "phrase_search": f"with {_TRUTH} select doc_id, qid as item_id from truth",
        "vector_search": "with e as (select vec_id, label, unnest(embedding)::double as v,"
        " unnest(range(len(embedding))) as i from embeddings),"
        " c as (select label::bigint as qid, i, avg(v) as v from e group by label, i),"
        " s as (select c.qid, e.vec_id, round(sum(e.v * c.v) / (sqrt(sum(e.v * e.v)) * sqrt(sum(c.v * c.v))), 6) as score"
        " from e join c using (i) group by c.qid, e.vec_id)"
        " select * from (select qid, vec_id, score, row_number() over (partition by qid order by score desc, vec_id)::int"
        f" as rank from s) where rank <= {TOP}",
        "contextual_search": f"with {_POST}, {_SIZES}, {_ASKED},"
        f" sc as (select cq.conv_id, cq.turn, p.doc_id, round({_BM25.replace('{w}', 'cq.weight')}, 6) as score"
        " from cq join post p using (term) join df using (term) join dl using (doc_id), tot"
        " group by cq.conv_id, cq.turn, p.doc_id)"
        " select * from (select conv_id, turn, doc_id, score, row_number() over"
        " (partition by conv_id, turn order by score desc, doc_id)::int as rank from sc) where rank <= 5",
        "search_facets": f"with {_TOK}, sets as (select doc_id, list(distinct term) as t from tok group by doc_id),"
        f" h as (select doc_id from sets where list_has_all(t, [{_listed(ALL_TERMS)}])"
        f" and list_has_any(t, [{_listed(ANY_TERMS)}]) and not list_has_any(t, [{_listed(NONE_TERMS)}]))"
        " select case when grouping(lang) = 1 then '*' else lang end as lang,"
        " case when grouping(source) = 1 then '*' else source end as source, count(*) as n"
        " from h join documents using (doc_id) group by rollup (lang, source)",
        "classify_rules": f"with {_CLASSES} select doc_id, cls from cls",
        "train_nb": f"with {_nb('quality')} select 0 as y, term, round(l0, 6) as logp, round(p0, 6) as log_prior"
        " from lp, pr union all select 1, term, round(l1, 6), round(p1, 6) from lp, pr",
        "score_nb": f"with {_nb('quality')} select doc_id, pred, score from nb",
        "resolve_predictions": f"with {_CLASSES}, r as (select doc_id, case when quality = 0 then 'junk' end as cls,"
        " 2 as v from labels union all select doc_id, case when toxic = 1 then 'toxic' when quality = 0 then 'junk' end,"
        " 1 from labels), best as (select doc_id, cls from (select doc_id, cls, row_number() over"
        " (partition by doc_id order by v desc, cls) as n from r where cls is not null) where n = 1)"
        " select doc_id, coalesce(best.cls, cls.cls) as cls,"
        " case when best.cls is not null then 'remote' else 'local' end as provenance"
        " from cls full outer join best using (doc_id)",
        "evaluate_classifier": f"with pairs as (select case when {_TOXIC} then 1 else 0 end as pred, toxic as y"
        " from documents join labels using (doc_id)) " + _scores("pairs"),
        "evaluate_search": f"with {_passages(TOP)}, {_TRUTH},"
        " per as (select t.qid, count(h.rank)::double / count(*) as rec, coalesce(1.0::double / min(h.rank), 0) as rr"
        " from truth t left join hits h on t.qid = h.qid and t.doc_id = h.doc_id group by t.qid)"
        " select count(*) as n_queries, round(avg(rec), 6) as recall_at_k, round(avg(rr), 6) as mrr from per",
        "capability_gate": f"with {_nb('toxic')},"
        " pn as (select pred, toxic as y from nb join labels using (doc_id) where doc_id % 5 = 0),"
        f" pw as (select case when {_TOXIC} then 1 else 0 end as pred, toxic as y"
        " from documents join labels using (doc_id) where doc_id % 5 = 0),"
        f" m as (select (select f1 from ({_scores('pn')}) where y = 1) as candidate,"
        f" (select f1 from ({_scores('pw')}) where y = 1) as baseline)"
        " select 'toxic' as name, reason = 'ok' as passed, reason from (select case"
        " when candidate is null or baseline is null then 'missing value'"
        f" when candidate < {GATE_FLOOR} then 'below floor' when candidate < baseline then 'below baseline'"
        " else 'ok' end as reason from m)",
        "find_sensitive_spans": f"with {_SPANS} select doc_id, kind, ord, sha256(value) as value_hash,"
        " substr(value, 1, 2) || repeat('*', length(value) - 2) as value_masked from spans",
        "sensitivity_label": f"with {_LEVELS} select doc_id, n_spans, kinds, level from lab",
        "mask_sensitive": f"select doc_id, regexp_replace(regexp_replace(regexp_replace({glued},"
        f" '{EMAIL}', '[EMAIL]', 'g'), '{PHONE}', '[PHONE]', 'g'), '{IP}', '[IP]', 'g') as text"
        f" from (select doc_id, {masked} as a from documents)",
        "route_external": f"with {_ROUTED} select doc_id, level, decision from routed",
        "route_and_release_stream": f"with {_ROUTED} select doc_id, level, decision from routed",
        "route_external_stream": f"with {_ROUTED} select doc_id, level, decision from routed",
        "egress_audit": f"with {_ROUTED} select case when grouping(source) = 1 then '*' else source end as source,"
        " case when grouping(decision) = 1 then '*' else decision end as decision, count(*) as n"
        " from routed group by cube (source, decision)",
        "propose_moves": f"with {_CLASSES} {_MOVES}",
        "propose_tags": f"with {_KEY} {_TAGS}",
        "propose_dedup": f"with {_COPIES} {_DELETES}",
        "gate_actions": f"with {_GATED} select * from gated",
        "apply_actions": f"with {_GATED}, ok as (select * from gated where status in ('auto', 'approved')),"
        " per as (select doc_id, bool_or(kind = 'delete') as del,"
        " arg_min(target, action_id) filter (kind = 'move') as space,"
        " string_agg(distinct target, ',' order by target) filter (kind = 'tag') as tags from ok group by doc_id)"
        " select doc_id, text, lang, coalesce(space, source) as source, n_chars, coalesce(tags, '') as tags"
        " from documents left join per using (doc_id) where not coalesce(del, false)",
        "action_summary": f"with {_GATED} select kind, status, count(*) as n from gated group by kind, status",
        "assemble_pages": f"with p as (select doc_id, {_LINES} from documents)"
        " select doc_id, (page_no // 5)::bigint as part, any_value(n) as n_pages,"
        " string_agg(text, chr(10) order by page_no) as text"
        " from p join (select doc_id, count(*) as n from p group by doc_id) using (doc_id) group by doc_id, part",
        "assemble_pages_by_size": f"with p as (select doc_id, {_LINES} from documents),"
        " z as (select *, coalesce(sum(strlen(text)) over (partition by doc_id order by page_no"
        " rows between unbounded preceding and 1 preceding), 0) // 2000 as part from p)"
        " select doc_id, part::bigint as part, min(page_no)::int as first_page, count(*) as n_pages,"
        " string_agg(text, chr(10) order by page_no) as text from z group by doc_id, part",
        "missing_pages": f"with p as (select doc_id, {_LINES} from documents),"
        f" f as (select * from p where coalesce({_symbols('text')}, 0) <= 0.06),"
        " m as (select doc_id, unnest(range(max(page_no) + 1)) as page_no from f group by doc_id)"
        " select m.doc_id, m.page_no from m anti join f on m.doc_id = f.doc_id and m.page_no = f.page_no",
        "clean_ocr_text": f"with p as (select doc_id, {_LINES} from documents),"
        " r as (select doc_id, page_no, text, row_number() over (partition by doc_id, text order by page_no) as n,"
        f" {_symbols('text')} as ratio from p),"
        " k as (select *, (n = 1 or trim(text) = '') and coalesce(ratio, 0) <= 0.5 as keep from r)"
        " select doc_id, coalesce(string_agg(text, chr(10) order by page_no) filter (keep), '') as text,"
        " count(*) filter (not keep) as n_dropped from k group by doc_id",
    }
