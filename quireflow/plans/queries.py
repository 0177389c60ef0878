"""Registered queries over the driver's tables, one for each group of operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, gates, layout, tables, tree, validate
from ..operators.fallback import convert
from ..options import ChunkingOptions
from ..sources.shared import staged
from . import adapters as X
from .oracles import LINES, SECTIONS
from .convert import rendered

SMALL = ChunkingOptions(parent_max_chars=1500, child_target_chars=400, child_overlap_chars=80)


def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.table(spark, sf_dir, "documents").select("doc_id", T.normalize_markdown(F.col("text")).alias("normal"))


def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.table(spark, sf_dir, "pages").select("page_id", T.clean_text(F.col("html")).alias("clean"))


def content_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.table(spark, sf_dir, "documents").select("doc_id", T.fingerprint(F.col("text")).alias("fingerprint"))


def split_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = X.document_markdown(spark, sf_dir)
    rows = docs.select("doc_id", F.posexplode(chunking.blocks_of(T.normalize_markdown(F.col("markdown")))).alias("ordinal", "b"))
    return rows.select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), "b.text", F.col("b.page").cast("long").alias("page"), "b.marker")


def source_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a line of some length."""
    docs = X.document_markdown(spark, sf_dir)
    blocks = F.filter(chunking.blocks_of(F.col("markdown")), lambda b: b["len"] > 100)
    return docs.select("doc_id", chunking.pages_of(blocks).alias("source"))


def parent_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = X.document_markdown(spark, sf_dir)
    d = chunking.with_sections(docs, SMALL).select("doc_id", F.posexplode("parents").alias("parent_idx", "p"))
    return d.select("doc_id", F.col("parent_idx").cast("long").alias("parent_idx"), "p.title", "p.content")


def children_of(docs: DataFrame) -> DataFrame:
    return chunking.children(docs, SMALL).withColumns({n: F.col(n).cast("long") for n in ("parent_idx", "child_idx")})


def child_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return children_of(X.document_markdown(spark, sf_dir))


def heading_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return children_of(X.conversation_markdown(spark, sf_dir))


def chunked_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunked(X.conversation_markdown(spark, sf_dir))


def render_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendered(X.conversation_elements(spark, sf_dir)).select("doc_id", "markdown")


def element_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = tree.flattened(X.conversation_elements(spark, sf_dir))
    return nodes.select("doc_id", F.col("path")[0].cast("long").alias("ordinal"), "type", "content", F.col("page_no").cast("long").alias("page_no"), F.col("heading_level").cast("long").alias("heading_level"))


def list_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendered(X.page_lists(spark, sf_dir)).select("doc_id", "markdown")


def table_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.order_matrices(spark, sf_dir).select("order_key", tables.render(F.col("matrix")).alias("markdown"))


def table_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.order_matrices(spark, sf_dir, X.WIDE).select("order_key", tables.render(F.col("matrix")).alias("markdown"))


def header_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of two header rows, the upper one with gaps: parts by flag and status, below the line numbers."""
    m = X.order_matrices(spark, sf_dir)
    rows = F.slice("matrix", 2, 2)
    return m.filter(F.size("matrix") > 2).select("order_key", F.array_join(tables.deduped(tables.labels(rows)), "|").alias("labels"))


def context_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = X.order_matrices(spark, sf_dir)
    filled = tables.context_filled(F.slice("matrix", F.lit(2), F.size("matrix")))
    return m.select("order_key", F.posexplode(filled).alias("n", "row")).select("order_key", F.col("n").cast("long").alias("n"), F.array_join("row", "|").alias("cells"))


def header_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of matrices with as many header rows as the order has lines, five at most."""
    m = X.order_matrices(spark, sf_dir)
    n = F.least(F.size("matrix") - 1, F.lit(5))
    stacked = F.concat(F.array_repeat(F.element_at("matrix", 1), n), F.slice("matrix", F.lit(2), F.size("matrix")))
    return m.select("order_key", tables.header_depth(stacked).cast("long").alias("depth"))


def timeline_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = layout.timeline_pairs(X.spatial_items(spark, sf_dir))
    return pairs.select("page_no", F.col("idx").cast("long").alias("idx"), "event", "year")


def timeline_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.timelines(X.spatial_items(spark, sf_dir)).select("page_no", "markdown")


def metric_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.metric_pairs(X.spatial_items(spark, sf_dir)).select("page_no", F.col("label_idx").cast("long").alias("label_idx"), F.col("value_idx").cast("long").alias("value_idx"), "label", "value")


def metric_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.metric_grids(X.spatial_items(spark, sf_dir)).select("page_no", "markdown")


def quality_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    md = F.col("fallback")
    return X.gate_cases(spark, sf_dir).select(
        "doc_id", gates.meaningful(md).alias("meaningful"), gates.presentable(md).alias("presentable"), gates.unresolved(md).alias("unresolved"),
        gates.has_separators(md).alias("separated"), gates.enough_pages(md).alias("enough"),
    )


def gate_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = X.gate_cases(spark, sf_dir)
    hybrid = gates.choose_rendered(F.col("rendered"), F.col("fallback"), F.col("allow_unresolved"))
    native = gates.choose_native(F.col("rendered"), F.col("fallback"))
    d = cases.select("doc_id", hybrid.alias("h"), native.alias("n"))
    return d.select("doc_id", F.col("h.ok").alias("hybrid_ok"), F.col("h.error").alias("hybrid_error"), F.col("n.ok").alias("native_ok"), F.col("n.error").alias("native_error"))


def fallback_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = X.table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 2 == 0).alias("use_ocr"))
    return convert(docs, X.CaseExtractor(), keep=staged)


def validate_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.validated(X.binary_documents(spark, sf_dir)).select("doc_id", "name", "reject_reason")


QUERIES = {
    f.__name__: f
    for f in (
        normalize_text, clean_text, content_fingerprint, split_blocks, source_pages, parent_sections, child_sections, heading_sections, chunked_document, render_pages, element_flatten,
        list_render, table_grid, table_records, header_labels, context_fill, header_depth, timeline_pairs, timeline_pages, metric_pairs, metric_pages, quality_gates, gate_decision,
        fallback_chain, validate_input,
    )
}

ORACLE = SECTIONS | {
    "normalize_text": r"""
select doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t\f\x0b\x{a0}]+(\n|$)', '\1', 'g'), '\n{3,}', e'\n\n', 'g'), '^\s+|\s+$', '', 'g') as normal from documents""",
    "clean_text": r"""
select page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '^\s+|\s+$', '', 'g') as clean from pages""",
    "content_fingerprint": r"select doc_id, regexp_replace(lower(text), '[^0-9A-Za-z\x{ac00}-\x{d7a3}]+', '', 'g') as fingerprint from documents",
    "split_blocks": f"with {LINES} select doc_id, ordinal, text, page, marker from numbered",
    "source_pages": f"""
with {LINES},
p as (select distinct doc_id, page from lines l join (select doc_id as d, i as j, i // 5 + 1 as page from lines) x on l.doc_id = d and l.i = j where length(line) > 100),
g as (select doc_id, min(page) as a, max(page) as b from (select *, page - row_number() over (partition by doc_id order by page) as k from p) group by doc_id, k)
select d.doc_id, coalesce('Page ' || string_agg(case when a = b then a::varchar else a || '-' || b end, ', ' order by a), '') as source
from documents d left join g on d.doc_id = g.doc_id group by d.doc_id""",
    "render_pages": r"""
with t as (
 select conv_id, turn, role, regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '^\s+|\s+$', '', 'g') as body,
  case when turn % 9 > 6 then (case when 8 + conv_id % 12 >= 16 then 2 when 8 + conv_id % 12 >= 11 then 3 else 4 end) else greatest(1, turn % 9) end as level
 from conversations)
select conv_id::varchar as doc_id, string_agg('--- Page ' || (turn + 1) || ' ---' || e'\n\n' || repeat('#', level::int) || ' ' || role || case when body = '' then '' else e'\n\n' || body end, e'\n\n' order by turn) as markdown
from t group by conv_id""",
    "element_flatten": r"""
with t as (select *, row_number() over (partition by conv_id order by turn) - 1 as i from conversations)
select conv_id::varchar as doc_id, i * 2 as ordinal, 'heading' as type, role as content, turn + 1 as page_no,
 (case when turn % 9 > 6 then (case when 8 + conv_id % 12 >= 16 then 2 when 8 + conv_id % 12 >= 11 then 3 else 4 end) else greatest(1, turn % 9) end)::bigint as heading_level from t
union all
select conv_id::varchar, i * 2 + 1, 'paragraph', regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '^\s+|\s+$', '', 'g'), turn + 1, null from t""",
    "list_render": r"""
with x as (select page_id, regexp_extract_all(html, '<li>(?:<a [^>]*>)?([^<]*)', 1) as items from pages),
l as (select page_id, unnest(items) as raw, generate_subscripts(items, 1) as n, regexp_replace(regexp_replace(regexp_replace(raw, '[ \t]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '^\s+|\s+$', '', 'g') as item from x)
select p.page_id::varchar as doc_id, coalesce(string_agg((case when p.page_id % 2 = 0 then n || '. ' else '- ' end) || item, chr(10) order by n) filter (where item <> ''), '') as markdown
from pages p left join l on p.page_id = l.page_id group by p.page_id""",
    "table_grid": r"""
with r as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey::varchar, l_returnflag, l_linestatus, l_suppkey::varchar) as n from lineitem)
select l_orderkey as order_key, e'| orderkey | linenumber | partkey | returnflag | linestatus |\n| --- | --- | --- | --- | --- |\n' ||
 string_agg('| ' || (case when n = 1 then l_orderkey::varchar else '' end) || ' | ' || l_linenumber || ' | ' || l_partkey || ' | ' || l_returnflag || ' | ' || l_linestatus || ' |', chr(10) order by n) as markdown
from r group by l_orderkey""",
    "table_records": r"""
select l_orderkey as order_key, e'**Table records:**\n' || string_agg('- orderkey: ' || l_orderkey || '; linenumber: ' || l_linenumber || '; partkey: ' || l_partkey || '; returnflag: ' || l_returnflag ||
 '; linestatus: ' || l_linestatus || '; suppkey: ' || l_suppkey || '; partkey 2: ' || l_partkey || '; linenumber 2: ' || l_linenumber || '; suppkey 2: ' || l_suppkey || '; returnflag 2: ' || l_returnflag ||
 '; orderkey 2: ' || l_orderkey || '; linestatus 2: ' || l_linestatus || '; partkey 3: ' || l_partkey, chr(10) order by l_linenumber, l_partkey::varchar, l_returnflag, l_linestatus, l_suppkey::varchar) as markdown
from lineitem group by l_orderkey""",
    "header_labels": r"""
with r as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey::varchar, l_returnflag, l_linestatus, l_suppkey::varchar) as n from lineitem),
p as (select a.l_orderkey, a.l_orderkey::varchar as c1, case when a.l_linenumber = b.l_linenumber then a.l_linenumber::varchar else a.l_linenumber || ' > ' || b.l_linenumber end as c2,
 case when a.l_partkey = b.l_partkey then a.l_partkey::varchar else a.l_partkey || ' > ' || b.l_partkey end as c3, case when a.l_returnflag = b.l_returnflag then a.l_returnflag else a.l_returnflag || ' > ' || b.l_returnflag end as c4,
 case when a.l_linestatus = b.l_linestatus then a.l_linestatus else a.l_linestatus || ' > ' || b.l_linestatus end as c5
 from r a join r b on a.l_orderkey = b.l_orderkey and a.n = 1 and b.n = 2),
u as (select l_orderkey, unnest([1, 2, 3, 4, 5]) as k, unnest([c1, c2, c3, c4, c5]) as c from p),
d as (select l_orderkey, k, c, row_number() over (partition by l_orderkey, c order by k) as m from u)
select l_orderkey as order_key, string_agg(case when m = 1 then c else c || ' ' || m end, '|' order by k) as labels from d group by l_orderkey""",
    "context_fill": r"""
select l_orderkey as order_key, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey::varchar, l_returnflag, l_linestatus, l_suppkey::varchar) - 1 as n,
 l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_returnflag || '|' || l_linestatus as cells from lineitem""",
    "header_depth": "select l_orderkey as order_key, least(count(*), 5) as depth from lineitem group by l_orderkey",
    "timeline_pairs": r"""
with i as (select p_partkey // 40 as page_no, p_partkey % 40 as idx, (p_partkey % 40) % 4 * 130 + p_size % 20 as x0,
  1000 - (p_partkey % 40) // 8 * 150 - (case when ((p_partkey % 40) // 4) % 2 = 0 then 0 else 40 end) - p_partkey % 7 as y0, ((p_partkey % 40) // 4) % 2 = 0 as up, p_name, p_size from part),
e as (select * from i where page_no % 2 = 0 and not up), y as (select * from i where page_no % 2 = 0 and up),
ok as (select page_no from i where page_no % 2 = 0 group by page_no having count(*) filter (where up) >= 4 and count(*) filter (where not up) >= 4),
m as (select e.page_no, e.idx, e.p_name as event, (1950 + y.p_size)::varchar as year, row_number() over (partition by e.page_no, e.idx order by abs(y.y0 - e.y0) + abs(y.x0 - e.x0) / 2.0, y.idx) as k
 from e join y on e.page_no = y.page_no and y.y0 - e.y0 >= 0 and y.y0 - e.y0 < 145 and (abs(y.x0 - e.x0) <= 125 or e.x0 between y.x0 - 20 and y.x0 + 80 or y.x0 between e.x0 - 20 and e.x0 + 80)
 where e.page_no in (select page_no from ok))
select page_no, idx, event, year from m where k = 1""",
    "quality_gates": r"""
select doc_id, doc_id % 8 in (0, 2, 5, 7) as meaningful, doc_id % 8 not in (3, 6) as presentable, doc_id % 8 in (1, 2) as unresolved, doc_id % 8 not in (6, 7) as separated, doc_id % 8 <> 5 and doc_id % 8 <> 3 as enough from documents""",
    "gate_decision": r"""
with c as (select doc_id, doc_id % 3 <> 0 as there, (doc_id // 3) % 8 as r, doc_id % 8 as f, doc_id % 5 = 0 as allow from documents),
s as (select *, r in (0, 2, 5, 7) as rm, r not in (3, 6) as rp, r in (1, 2) as ru, f in (0, 2, 5, 7) as fm, f not in (3, 6) as fp, f in (1, 2) as fu, case when there then r else f end as v from c),
d as (select *, case when there and allow and rp then 1 when there and rm and not ru then 1 when there and rm then 2 when allow and fp then 1 when fm and not fu then 1 else 3 end as h,
 case when v not in (0, 2, 5, 7) then 1 when v in (1, 2) then 2 when v in (3, 5) then 3 else 0 end as n from s)
select doc_id, h = 1 as hybrid_ok, case h when 2 then 'visual pages without OCR text or image description' when 3 then 'no usable text or image description; OCR fallback required' end as hybrid_error,
 n = 0 as native_ok, case n when 1 then 'no Markdown' when 2 then 'visual pages without OCR text or image description' when 3 then 'too few content pages' end as native_error from d""",
    "fallback_chain": r"""
with c as (select doc_id, doc_id % 7 as n, doc_id % 2 = 0 as ocr, 'auto extraction broke; native: native extraction broke' as b, 'no usable text or image description; OCR fallback required; native: no Markdown' as o from documents),
s as (select *, n < 4 or (n = 4 and not ocr) or (n in (4, 5) and ocr) as ok from c)
select doc_id, ok,
 case when n = 0 then 'native text of ' || doc_id || ' by input' when n = 1 then 'auto text of ' || doc_id || ' by input' when n = 2 then 'auto text of ' || doc_id || ' by light' when n = 3 then 'auto text of ' || doc_id || ' by light/full'
  when n = 4 and not ocr then '> Image-only page. No embedded text layer was available.' when n = 4 then 'full text of ' || doc_id || ' by rasterized' when n = 5 and ocr then 'full text of ' || doc_id || ' by light/full/rasterized' end as markdown,
 case when not ok then 'failed after fallback attempts: original: ' || b || '; qpdf-repaired: ' || b || '; repaired: ' || b || case when ocr then '; rasterized-ocr: full extraction broke' else '' end end as error
from s""",
    "validate_input": r"""
select doc_id, case doc_id % 4 when 0 then 'bad_name_' || doc_id || '.pdf' when 1 then source || ' scan.PDF' when 2 then 'document.pdf' else 'report ' || doc_id || '.pdf' end as name,
 case doc_id % 5 when 1 then case when regexp_matches(text, '^[ \t\n\r\x0b\f]*%PDF-') then null else 'no PDF signature' end when 2 then 'empty input' when 3 then 'text-decoded or corrupted' end as reject_reason from documents""",
}
