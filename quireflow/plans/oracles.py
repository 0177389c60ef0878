"""SQL of the sections and of the spatial pages, written apart from their implementation: folds are recursive."""

from __future__ import annotations

LINES = """
lines as (
  select doc_id, row_number() over (partition by doc_id order by n) - 1 as i, line
  from (select doc_id, unnest(string_split(text, chr(10))) as raw, generate_subscripts(string_split(text, chr(10)), 1) as n,
               regexp_replace(raw, '^\\s+|\\s+$', '', 'g') as line from documents)
  where line <> ''),
blocks as (
  select doc_id, i * 2 as pos, line as text, i // 5 + 1 as page, false as marker from lines
  union all
  select doc_id, i * 2 - 1, '--- Page ' || (i // 5 + 1) || ' ---', i // 5 + 1, true from lines where i % 5 = 0),
numbered as (select *, row_number() over (partition by doc_id order by pos) - 1 as ordinal from blocks)"""


def moved(path: str) -> str:
    """The list ``path`` of six headings behind heading ``title`` of level ``lvl``."""
    return "[" + ", ".join(f"case when lvl > {k} then {path}[{k}] when lvl = {k} then title end" for k in range(1, 7)) + "]"


def shown(path: str) -> str:
    return f"coalesce(nullif(array_to_string(list_filter({path}, lambda x: x is not null), ' > '), ''), 'Document section')"


NONE = "([null, null, null, null, null, null]::varchar[])"


def pages(group: str, of: str) -> str:
    """``group`` and source, the page ranges of the rows of ``of``."""
    return f"""select {group}, 'Page ' || string_agg(case when a = b then a::varchar else a || '-' || b end, ', ' order by a) as source from (
 select {group}, min(page) as a, max(page) as b from (select *, page - row_number() over (partition by {group} order by page) as k from (select distinct {group}, page from {of} where page is not null)) group by {group}, k) group by {group}"""


def sections(parent: int, child: int, overlap: int) -> str:
    """CTEs ``parents`` and ``kids`` of the blocks ``numbered`` (doc_id, ordinal, text, page, marker)."""
    return rf"""
heads as materialized (select *, nullif(length(regexp_extract(text, '^(#{{1,6}})\s+[^\n]+$', 1)), 0) as lvl, trim(regexp_extract(text, '^#{{1,6}}\s+([^\n]+)$', 1)) as title, length(text) as len,
  not marker and not regexp_matches(text, '^#{{1,6}}\s+[^\n]+$') and regexp_matches(lower(text), '[0-9a-z\x{{ac00}}-\x{{d7a3}}]') as body from numbered),
fold as (
 select doc_id, -1::bigint as ordinal, 0 as sec, 0::bigint as size, false as has, null::bigint as last_mark, {NONE} as path, 'Document section' as name, {NONE} as own, 0 as n_heads, false as top,
  false as split, false as carry, null::bigint as lead, null::varchar as text, null::bigint as page, false as marker, false as body from (select distinct doc_id from numbered)
 union all
 select doc_id, ordinal, sec + split::int, case when split then coalesce(length('--- Page ' || lead || ' ---') + 2, 0) + len when ordinal = 0 then len else size + 2 + len end,
  body or (has and not split), case when marker then page end, new_path, case when lvl is not null and (split or name = 'Document section') then {shown("new_path")} else name end,
  case when lvl is null then (case when split then {NONE} else own end) when split then {moved(NONE)} else {moved("own")} end,
  (case when split then 0 else n_heads end) + (lvl is not null)::int, coalesce(lvl = 1, false) or (top and not split), split, carry, lead, text, page, marker, body
 from (select *, case when carry then last_mark when split then page end as lead, case when lvl is null then path else {moved("path")} end as new_path
  from (select *, split and lvl is not null and last_mark is not null as carry
   from (select f.doc_id, h.ordinal, f.sec, f.size, f.has, f.last_mark, f.path, f.name, f.own, f.n_heads, f.top, h.text, h.page, h.marker, h.body, h.lvl, h.title, h.len,
     f.has and (case when h.lvl is not null then h.lvl <= 2 else not h.marker and f.size + h.len > {parent} end) as split
    from fold f join heads h on h.doc_id = f.doc_id and h.ordinal = f.ordinal + 1)))),
steps as materialized (select *, lead(carry, 1, false) over (partition by doc_id order by ordinal) as gone from fold where ordinal >= 0),
full_ as (select doc_id, sec from steps group by all having bool_or(body)),
placed as materialized (
 select doc_id, sec, row_number() over (partition by doc_id, sec order by pos) as r, text, page, marker, body, length(text) as len from (
  select doc_id, sec, ordinal * 2 as pos, text, page, marker, body from steps where not gone
  union all select doc_id, sec, ordinal * 2 - 1, '--- Page ' || lead || ' ---', lead, true, false from steps where split and lead is not null) semi join full_ using (doc_id, sec)),
ends as (select doc_id, sec, last(name order by ordinal) as name, last(own order by ordinal) as own, last(n_heads order by ordinal) as n_heads, last(top order by ordinal) as top from steps group by all),
titles as (select doc_id, sec, case when n_heads = 0 or (not top and name <> 'Document section') then name else {shown("own")} end as title from ends),
parents as (select doc_id, sec::bigint as parent_idx, any_value(title) as title, string_agg(text, e'\n\n' order by r) as content from placed join titles using (doc_id, sec) group by doc_id, sec),
kid_fold as (
 select doc_id, sec, 0::bigint as r, 0 as kid, 0::bigint as size, false as has, false as split, null::varchar as text, null::bigint as page, false as marker, false as body from (select distinct doc_id, sec from placed)
 union all
 select doc_id, sec, r, kid + split::int, case when split then coalesce(length('--- Page ' || page || ' ---') + 2, 0) + len when r = 1 then len else size + 2 + len end, body or (has and not split), split, text, page, marker, body
 from (select f.doc_id, f.sec, p.r, f.kid, f.size, f.has, p.text, p.page, p.marker, p.body, p.len, f.has and not p.marker and f.size + p.len > {child} as split
  from kid_fold f join placed p on p.doc_id = f.doc_id and p.sec = f.sec and p.r = f.r + 1)),
kid_blocks as materialized (
 select doc_id, sec, kid, r * 2 as pos, text, page, marker, body from kid_fold where r > 0
 union all select doc_id, sec, kid, r * 2 - 1, '--- Page ' || page || ' ---', page, true, false from kid_fold where split and page is not null),
kid_texts as (select doc_id, sec, kid, string_agg(text, e'\n\n' order by pos) as content,
  trim(regexp_replace(regexp_replace(coalesce(string_agg(text, e'\n\n' order by pos) filter (where not marker), ''), '(?m)^#{{1,6}}\s+', '', 'g'), '\s+', ' ', 'g')) as plain from kid_blocks group by all having bool_or(body)),
kid_pages as ({pages("doc_id, sec, kid", "kid_blocks")}),
parent_pages as ({pages("doc_id, sec", "placed")}),
kids as (select doc_id, sec::bigint as parent_idx, kid::bigint as child_idx, title, coalesce(kp.source, pp.source, 'Unknown page') as source,
  coalesce(case when length(before) <= {overlap} then before else '...' || ltrim(right(before, {overlap})) end, '') as previous_context, content
 from (select *, lag(plain) over (partition by doc_id, sec order by kid) as before from kid_texts) join titles using (doc_id, sec) left join kid_pages kp using (doc_id, sec, kid) left join parent_pages pp using (doc_id, sec))"""


#: Conversations as Markdown, and its blocks.
TURNS = r"""
md as (select conv_id as doc_id, string_agg('--- Page ' || (turn + 1) || e' ---\n\n' || repeat('#', (turn % 3 + 1)::int) || ' ' || role || coalesce(e'\n\n' || text, ''), e'\n\n' order by turn) as raw from conversations group by conv_id),
normal as materialized (select doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, '\r\n?', chr(10), 'g'), '[ \t\f\x0b\x{a0}]+(\n|$)', '\1', 'g'), '\n{3,}', e'\n\n', 'g'), '^\s+|\s+$', '', 'g') as normal from md),
parts as (select doc_id, list_filter(list_transform(regexp_split_to_array(normal, '\n\s*\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') as p from normal),
flat as (select doc_id, unnest(p) as text, generate_subscripts(p, 1) - 1 as ordinal from parts),
marked as (select *, regexp_matches(text, '^--- Page [0-9]+ ---$') as marker from flat),
numbered as materialized (select doc_id, ordinal, text, marker, last_value(case when marker then regexp_extract(text, '[0-9]+')::bigint end ignore nulls) over (partition by doc_id order by ordinal) as page from marked)"""

KIDS = "select doc_id, parent_idx, child_idx, title, source, previous_context, content from kids"
ITEMS = r"""
i as (select p_partkey // 40 as page_no, p_partkey % 40 as idx, p_partkey % 4 * 130 + p_size % 20 as x0, 1000 - (p_partkey % 40) // 8 * 150 - (case when p_partkey // 4 % 2 = 0 then 0 else 40 end) - p_partkey % 7 as y0,
  p_partkey // 4 % 2 = 0 as up, p_name, p_size, (1950 + p_size)::varchar as year, ['Founded', 'Students', 'Faculty', 'Dorms', 'Budget'][(p_partkey % 40) // 8 + 1] as label, 'No. ' || p_size as figure from part),
t as (select *, case when page_no % 2 = 0 then (case when up then year else '- ' || p_name end) else (case when up then label else figure end) end as text from i)"""
LEADS = """
leads as (select page_no, string_agg(case when k = 1 and length(text) <= 60 then '## ' || text else text end, e'\\n\\n' order by idx) || e'\\n\\n' as lead
 from (select t.*, row_number() over (partition by t.page_no order by t.idx) as k from t join firsts using (page_no) where t.idx < first) group by page_no)"""
PAIRED = """
l as (select * from i where page_no % 2 = 1 and up), v as (select * from i where page_no % 2 = 1 and not up),
ok as (select page_no from i where page_no % 2 = 1 group by page_no having count(*) filter (where up) >= 4 and count(*) filter (where not up) >= 4),
met as (select l.page_no, l.idx as label_idx, v.idx as value_idx, row_number() over (partition by l.page_no, l.idx order by abs(l.y0 - v.y0) + abs(l.x0 - v.x0) / 2.0, v.idx) as near, dense_rank() over (partition by l.page_no order by l.idx) as nth
 from l join v on l.page_no = v.page_no and l.y0 - v.y0 > 0 and l.y0 - v.y0 < 95 and (abs(l.x0 - v.x0) <= 95 or v.x0 between l.x0 - 20 and l.x0 + 80 or l.x0 between v.x0 - 20 and v.x0 + 80) where l.page_no in (select page_no from ok)),
greedy as (
 select page_no, 0::bigint as nth, []::bigint[] as used, null::bigint as label_idx, null::bigint as value_idx from (select distinct page_no from met)
 union all
 select page_no, nth, case when value_idx is null then used else list_append(used, value_idx) end, label_idx, value_idx from (
  select g.page_no, m.nth, any_value(g.used) as used, any_value(m.label_idx) as label_idx, arg_min(m.value_idx, m.near) filter (where not list_contains(g.used, m.value_idx)) as value_idx
  from greedy g join met m on m.page_no = g.page_no and m.nth = g.nth + 1 group by g.page_no, m.nth)),
pairs as (select g.page_no, label_idx, value_idx, l.label, v.figure as value, l.x0 + 30 as cx, l.y0 + 6 as cy from greedy g join l on l.page_no = g.page_no and l.idx = label_idx join v on v.page_no = g.page_no and v.idx = value_idx)"""

SECTIONS = {
    "parent_sections": f"with recursive {LINES}, {sections(1500, 400, 80)} select doc_id, parent_idx, title, content from parents",
    "child_sections": f"with recursive {LINES}, {sections(1500, 400, 80)} {KIDS}",
    "heading_sections": f"with recursive {TURNS}, {sections(1500, 400, 80)} {KIDS}",
    "chunked_document": rf"""
with recursive {TURNS}, {sections(4500, 900, 180)},
texts as (select doc_id, parent_idx, e'<<<PARENT_BREAK>>>\n\n' || string_agg(e'<<<CHILD_BREAK>>>\n\nSection: ' || title || e'\n\nSource: ' || source || case when previous_context = '' then '' else e'\n\n> Previous context: ' || previous_context end
  || e'\n\nContent:\n\n' || content, e'\n\n' order by child_idx) as text from kids group by doc_id, parent_idx),
whole as (select doc_id, string_agg(text, e'\n\n' order by parent_idx) as text from texts group by doc_id)
select doc_id, case when contains(normal, '<<<PARENT_BREAK>>>') or contains(normal, '<<<CHILD_BREAK>>>') then normal else coalesce(regexp_replace(regexp_replace(text, '[ \t]+(\n|$)', '\1', 'g'), '\n{{3,}}', e'\n\n', 'g'), normal) end as chunked
from normal left join whole using (doc_id)""",
    "timeline_pages": rf"""
with {ITEMS},
e as (select * from i where page_no % 2 = 0 and not up), y as (select * from i where page_no % 2 = 0 and up),
ok as (select page_no from i where page_no % 2 = 0 group by page_no having count(*) filter (where up) >= 4 and count(*) filter (where not up) >= 4),
m as (select e.page_no, e.idx, e.p_name as event, y.year, row_number() over (partition by e.page_no, e.idx order by abs(y.y0 - e.y0) + abs(y.x0 - e.x0) / 2.0, y.idx) as k
 from e join y on e.page_no = y.page_no and y.y0 - e.y0 >= 0 and y.y0 - e.y0 < 145 and (abs(y.x0 - e.x0) <= 125 or e.x0 between y.x0 - 20 and y.x0 + 80 or y.x0 between e.x0 - 20 and e.x0 + 80) where e.page_no in (select page_no from ok)),
u as (select page_no, year, event, min(idx) as idx from m where k = 1 group by all),
g as (select page_no, year, string_agg(event, '; ' order by idx) as events from u group by page_no, year),
w as (select page_no, string_agg('- ' || year || ': ' || events, e'\n\n' order by year::int) as body from g group by page_no having count(*) >= 4),
firsts as (select page_no, min(idx) as first from t where page_no % 2 = 0 group by page_no), {LEADS}
select page_no, coalesce(lead, '') || body as markdown from w left join leads using (page_no)""",
    "metric_pairs": f"with recursive {ITEMS}, {PAIRED} select page_no, label_idx, value_idx, label, value from pairs",
    "metric_pages": rf"""
with recursive {ITEMS}, {PAIRED},
w as (select page_no, e'| 항목 | 내용 |\n| --- | --- |\n' || string_agg('| ' || label || ' | ' || value || ' |', chr(10) order by cy desc, cx, label_idx) as body from pairs group by page_no having count(*) >= 4),
firsts as (select page_no, min(least(label_idx, value_idx)) as first from pairs group by page_no), {LEADS}
select page_no, coalesce(lead, '') || body as markdown from w left join leads using (page_no)""",
}
