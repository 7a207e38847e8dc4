"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1 = f"""
with d as (select doc_id, {_WORDS.format("coalesce(text, '')")} as w from documents),
b as (select item_id, {_WORDS.format("coalesce(text, '')")} as w from benchmark),
grams as (
  select distinct item_id, least(10, len(w)) as size,
    array_to_string(w[i : i + least(10, len(w)) - 1], ' ') as gram
  from b, lateral (select unnest(range(1, len(w) - least(10, len(w)) + 2)) as i) where len(w) > 0
),
sizes as (select distinct size from grams),
found as (
  select d.doc_id, p.i, s.size, g.item_id
  from d, sizes s, lateral (select unnest(range(1, len(d.w) - s.size + 2)) as i) p
  join grams g on g.size = s.size and g.gram = array_to_string(d.w[p.i : p.i + s.size - 1], ' ')
),
hit as (
  select doc_id, count(distinct j) as n_hit
  from (select doc_id, unnest(range(i, i + size)) as j from found) group by doc_id
),
items as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
  from (select distinct doc_id, item_id::varchar as item from found) group by doc_id
)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit,
  coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (doc_id) left join items using (doc_id)
"""

# How long the formatted text is follows from the template: the marks of each role and a backslash
# for every backslash and every control string of a text.
OP2 = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
),
m as (
  select *, lag(role) over (partition by conv_id order by turn nulls first, role, text) as before,
    length(text)
      + len(regexp_extract_all(text, '\\|</?s>|\[/?INST\]|<</?SYS>>|\[/?ROLE\]|\[/END\]|\[SEP\]')) as chars
  from t
)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  (3 + sum(chars + case when before = role then 5
    else case role when 'user' then 15 when 'assistant' then 5 when 'system' then 19
      else 20 + length(role) end end))::bigint as formatted_chars
from m group by conv_id
"""

OP3 = """
with p as (
  select page_id, coalesce(html, '') as html, strlen(coalesce(html, '')) as size from pages
),
h as (
  select page_id, size, sha1(html) as digest,
    case when size >= 1000 then max(page_id) over (partition by html) end as stored from p
)
select page_id, size::bigint as payload_bytes, digest as payload_digest,
  case when stored <> page_id then 'revisit' else 'response' end as record_type,
  case when stored <> page_id then stored end as refers_to
from h
"""


_TERMS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP11 = f"""
with tok as (select doc_id, unnest({_TERMS.format("coalesce(text, '')")}) as term from documents),
post as (select doc_id, term, count(*)::bigint as tf from tok group by all),
lens as (select doc_id, sum(tf)::bigint as n from post group by doc_id),
tot as (select count(*)::bigint as docs, sum(n)::bigint as words from lens),
w as (
  select term, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w
  from post, tot group by term, docs
),
q as (select distinct item_id, unnest({_TERMS.format("coalesce(text, '')")}) as term from benchmark),
m as (select doc_id, 100 - 90 + (90 * n * docs) // words as m from lens, tot),
s as (
  select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score
  from q join post using (term) join w using (term) join m using (doc_id) group by all
)
select item_id, (row_number() over (partition by item_id order by score desc, doc_id))::int as rank, doc_id, score
from s where score > 0 qualify rank <= 10
"""


OP12 = r"""
with p as (
  select coalesce(lang, 'und') as lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents
),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from p),
tot as (select lang, sum(len(w))::bigint as n from w group by lang),
g as (
  select lang, w[i : i + s - 1] as g
  from w, (select unnest(range(1, 6)) as s) z, lateral (select unnest(range(1, len(w) - s + 2)) as i) y
),
f as (select lang, g, count(*)::bigint as a from g group by all having count(*) >= 100),
cut as (
  select c.lang, c.g, c.a, k, l.a as l, r.a as r, n, ((1000::hugeint * c.a * n) // (l.a::hugeint * r.a))::bigint as score
  from f c join tot using (lang), lateral (select unnest(range(1, len(c.g))) as k) x
  join f l on l.lang = c.lang and l.g = c.g[1:k] join f r on r.lang = c.lang and r.g = c.g[k + 1 :]
),
best as (select * from cut qualify row_number() over (partition by lang, g order by score, k) = 1),
inside as (
  select f.lang, f.g[i : i + s - 1] as g, max(a) as longest
  from f, lateral (select unnest(range(2, len(f.g))) as s) z, lateral (select unnest(range(1, len(f.g) - s + 2)) as i) y
  group by all
),
kept as (
  select best.*, array_to_string(best.g, ' ') as phrase
  from best left join inside using (lang, g) where longest is null or 100 * longest < 100 * a
)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
from kept qualify rank <= 2000
"""


def statements() -> dict[str, str]:
    return {"op1_decontamination": OP1, "op2_chat": OP2, "op3_warc": OP3, "op11_lexical_search": OP11, "op12_collocations": OP12}
