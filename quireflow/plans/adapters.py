"""Reference-shaped inputs made of the driver's tables, all by deterministic rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip
from ..operators.gates import IMAGE_ONLY, VISUAL_PAGE

LINES_A_PAGE = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and markdown: each line with any text is a block, five to a page."""
    lines = F.filter(F.transform(F.split("text", "\n"), strip), lambda x: x != "")
    page = lambda i: F.concat(F.lit("--- Page "), (F.floor(i / LINES_A_PAGE) + 1).cast("string"), F.lit(" ---\n\n"))
    blocks = F.transform(lines, lambda x, i: F.when(i % LINES_A_PAGE == 0, F.concat(page(i), x)).otherwise(x))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(blocks, "\n\n").alias("markdown"))


def conversation_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, element_json and fallback_md: a page for each turn, with its role as heading and its text below.

    Heading levels and font sizes run through all cases.
    """
    page = F.col("turn") + 1
    head = F.struct(F.lit("heading").alias("type"), F.col("role").alias("content"), page.alias("page number"), (F.col("turn") % 9).alias("heading level"), (8 + F.col("conv_id") % 12).alias("font size"))
    body = F.struct(F.lit("paragraph").alias("type"), F.col("text").alias("content"), page.alias("page number"), F.lit(None).cast("long").alias("heading level"), F.lit(None).cast("long").alias("font size"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array(head, body).alias("pair"))
    trees = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "pair"))).alias("turns"))
    kids = F.flatten(F.transform("turns", lambda t: t["pair"]))
    return trees.select(F.col("conv_id").cast("string").alias("doc_id"), F.to_json(F.struct(kids.alias("kids"))).alias("element_json"), F.lit("").alias("fallback_md"))


def conversation_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and markdown with headings: turns under their roles, two levels deep."""
    turn = F.concat_ws("\n\n", F.concat(F.lit("--- Page "), (F.col("turn") + 1).cast("string"), F.lit(" ---")), F.concat(F.repeat(F.lit("#"), (F.col("turn") % 3 + 1).cast("int")), F.lit(" "), F.col("role")), "text")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", turn.alias("md"))
    listed = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "md"))).alias("t"))
    return listed.select(F.col("conv_id").alias("doc_id"), F.array_join(F.transform("t", lambda t: t["md"]), "\n\n").alias("markdown"))


def page_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, element_json and fallback_md: the items of a web page as one list, ordered on every other page."""
    items = F.transform(F.regexp_extract_all("html", F.lit(r"<li>(?:<a [^>]*>)?([^<]*)"), F.lit(1)), lambda x: F.struct(F.lit("list item").alias("type"), x.alias("content")))
    style = F.when(F.col("page_id") % 2 == 0, "decimal").otherwise("bullet")
    kids = F.array(F.struct(F.lit("list").alias("type"), style.alias("numbering style"), items.alias("list items")))
    return table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("doc_id"), F.to_json(F.struct(kids.alias("kids"))).alias("element_json"), F.lit("").alias("fallback_md"))


#: Columns of an order's matrix; the order's key stands in its first line only.
NARROW = ("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus")
WIDE = (*NARROW, "l_suppkey", "l_partkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_orderkey", "l_linestatus", "l_partkey")


def order_matrices(spark: SparkSession, sf_dir: str, columns: tuple[str, ...] = NARROW) -> DataFrame:
    """order_key and matrix: a header, then a row for each line of the order."""
    text = lambda c: F.col(c).cast("string")
    row = F.array(*[text(c) for c in columns])
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", row.alias("row"))
    rows = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "row"))).alias("rows"))
    shown = F.transform("rows", lambda r, i: F.when(i == 0, r["row"]).otherwise(F.concat(F.array(F.lit("")), F.slice(r["row"], 2, len(columns)))))
    header = F.array(*[F.lit(c.removeprefix("l_")) for c in columns])
    return rows.select(F.col("l_orderkey").alias("order_key"), F.concat(F.array(header), shown).alias("matrix"))


def spatial_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items on pages of forty parts: years and events on even pages, labels and figures on odd ones."""
    n = F.col("p_partkey")
    idx, page = n % 40, F.floor(n / 40)
    column, row = idx % 4, F.floor(idx / 8)
    upper = F.floor(idx / 4) % 2 == 0
    text = (
        F.when((page % 2 == 0) & upper, (F.lit(1950) + F.col("p_size")).cast("string")).when(page % 2 == 0, F.concat(F.lit("- "), "p_name"))
        .when(upper, F.element_at(F.array(*[F.lit(x) for x in ("Founded", "Students", "Faculty", "Dorms", "Budget")]), (row + 1).cast("int"))).otherwise(F.concat(F.lit("No. "), F.col("p_size").cast("string")))
    )
    x0 = (column * 130 + F.col("p_size") % 20).cast("double")
    y0 = (1000 - row * 150 - F.when(upper, 0).otherwise(40) - n % 7).cast("double")
    figure = (page % 2 == 1) & ~upper
    return table(spark, sf_dir, "part").select(
        F.lit("parts").alias("doc_id"), page.cast("long").alias("page_no"), idx.cast("int").alias("idx"), text.alias("text"), F.when(figure, "heading").otherwise("paragraph").alias("type"),
        x0.alias("x0"), y0.alias("y0"), (x0 + 60).alias("x1"), (y0 + 12).alias("y1"), F.when(figure, 16.0).otherwise(10.0).alias("font_size"),
    )


def gate_case(n: Column, text: Column) -> Column:
    """Markdown that goes through the gates' cases."""
    page = "--- Page 1 ---\n\n"
    return (
        F.when(n % 8 == 0, F.concat(F.lit(page), text)).when(n % 8 == 1, F.lit(page + IMAGE_ONLY)).when(n % 8 == 2, F.concat(F.lit(page + "# Title\n\n"), F.lit(VISUAL_PAGE)))
        .when(n % 8 == 3, F.lit("--- Page 1 ---\n\n--- Page 2 ---")).when(n % 8 == 4, F.lit(page + "![x](y.png)\n\n|  |  |\n| --- | --- |"))
        .when(n % 8 == 5, F.concat(F.lit("--- Page 1 ---\n\n--- Page 2 ---\n\n--- Page 3 ---\n\n--- Page 4 ---\n\n"), text)).when(n % 8 == 6, F.lit("")).otherwise(text)
    )


def gate_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, rendered (null: no elements), fallback and allow_unresolved."""
    n = F.col("doc_id")
    rendered = F.when(n % 3 != 0, gate_case(F.floor(n / 3), F.col("text")))
    return table(spark, sf_dir, "documents").select("doc_id", rendered.alias("rendered"), gate_case(n, F.col("text")).alias("fallback"), (n % 5 == 0).alias("allow_unresolved"))


def binary_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, filename and content: with and without a signature, empty, and decoded as text."""
    n = F.col("doc_id")
    body = F.when(n % 5 == 0, F.concat(F.lit(" \n%PDF-1.7\n"), "text")).when(n % 5 == 1, F.col("text")).when(n % 5 == 2, F.lit("")).when(n % 5 == 3, F.concat(F.lit("%PDF-"), F.repeat(F.lit("�"), 120))).otherwise(F.concat(F.lit("%PDF-1.4"), "text"))
    name = F.when(n % 4 == 0, F.concat(F.lit("../bad:name?"), n.cast("string"), F.lit(".pdf"))).when(n % 4 == 1, F.concat("source", F.lit(" scan.PDF"))).when(n % 4 == 2, F.lit("")).otherwise(F.concat(F.lit("report "), n.cast("string"), F.lit(".doc")))
    return table(spark, sf_dir, "documents").select("doc_id", name.alias("filename"), F.encode(body, "UTF-8").alias("content"))


class CaseExtractor:
    """An extractor that answers by rules on the documents' numbers: no files, every path of the chain."""

    def extract(self, docs: DataFrame, source: tuple[str, ...], mode: str) -> DataFrame:
        n = F.col("doc_id") % 7
        text = F.concat(F.lit(f"{mode} text of "), F.col("doc_id").cast("string"), F.lit(" by " + ("/".join(source) or "input")))
        good = {
            ("native", ()): n == 0,
            ("auto", ()): n == 1,
            ("auto", ("light",)): n == 2,
            ("auto", ("light", "full")): n == 3,
        }.get((mode, source), F.lit(False)) | (F.lit(mode == "full") & n.isin(4, 5))
        markdown = F.when(good, text).when(n == 4, F.lit(IMAGE_ONLY))
        error = F.when(~good & (n != 4), F.lit(f"{mode} extraction broke"))
        return docs.select("doc_id", error.alias("error"), markdown.alias("markdown"), F.lit(None).cast("string").alias("rendered"))
