"""The whole flow: bytes to checked Markdown to chunks, and element trees to Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_markdown
from ..operators.chunking import chunked
from ..operators.fallback import RESULT, Extractor, convert
from ..operators.layout import metric_grids, timelines
from ..operators.tree import element_pages
from ..operators.validate import validated
from ..options import Options
from ..sources.shared import staged


def page_texts(pages: DataFrame) -> DataFrame:
    """doc_id, page_no, markdown: a timeline, else a grid of figures, else the page's flow.

    ``pages`` is read several times; the caller has staged it.
    """
    placed = pages.filter("page_no > 0").select("doc_id", "page_no", F.explode("items").alias("i")).select("doc_id", "page_no", "i.*")
    keys = ["doc_id", "page_no"]
    t, m = timelines(placed).withColumnRenamed("markdown", "timeline"), metric_grids(placed).withColumnRenamed("markdown", "metrics")
    joined = pages.drop("items").join(t, keys, "left").join(m, keys, "left")
    return joined.select(*keys, F.coalesce(F.nullif("timeline", F.lit("")), F.nullif("metrics", F.lit("")), "flow").alias("markdown"))


def documents_of(texts: DataFrame) -> DataFrame:
    """doc_id and rendered: pages in order under their separators, or the text of page 0 alone."""
    rows = texts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_no", "markdown"))).alias("pages"))
    head = lambda p: F.concat(F.lit("--- Page "), p["page_no"].cast("string"), F.lit(" ---"))
    page = lambda p: F.when(p["page_no"] == 0, p["markdown"]).otherwise(F.concat_ws("\n\n", head(p), F.nullif(p["markdown"], F.lit(""))))
    return rows.select("doc_id", F.array_join(F.transform("pages", page), "\n\n").alias("rendered"))


def rendered(docs: DataFrame) -> DataFrame:
    """doc_id, ok and markdown of element trees (doc_id, element_json, fallback_md).

    A tree without any text gives its fallback; a text that is no JSON fails.
    """
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("string"))
    pages = staged(element_pages(docs), "pages")
    broken = pages.filter("page_no is null").select("doc_id", F.lit(True).alias("broken")).distinct()
    made = documents_of(page_texts(pages.filter("page_no is not null")))
    joined = docs.select("doc_id", "fallback_md").join(made, "doc_id", "left").join(broken, "doc_id", "left")
    text = F.coalesce(F.nullif("rendered", F.lit("")), "fallback_md", F.lit(""))
    ok = F.col("broken").isNull()
    return joined.select("doc_id", ok.alias("ok"), F.when(ok, normalize_markdown(text)).alias("markdown"))


def chunks_of(results: DataFrame, options: Options) -> DataFrame:
    """Successful results with their Markdown chunked, if the options say so."""
    if not options.chunk:
        return results
    text = chunked(results.filter("ok").select("doc_id", "markdown"), options.chunking)
    return results.drop("markdown").join(text.withColumnRenamed("chunked", "markdown"), "doc_id", "left").select(*RESULT)


def converted(uploads: DataFrame, extractor: Extractor, options: Options = Options(), keep=None) -> DataFrame:
    """doc_id, ok, markdown, error of every upload (doc_id, filename, content, use_ocr)."""
    options = options.checked()
    checked = validated(uploads, options)
    rejected = checked.filter("reject_reason is not null").select("doc_id", F.lit(False).alias("ok"), F.lit(None).cast("string").alias("markdown"), F.col("reject_reason").alias("error"))
    taken = convert(checked.filter("reject_reason is null").select("doc_id", "use_ocr"), extractor, options, keep)
    return chunks_of(taken, options).unionByName(rejected)
