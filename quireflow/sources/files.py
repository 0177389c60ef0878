"""Sources and sinks: uploaded files, extraction artifacts, responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MARKDOWN, ELEMENTS = ("md", "markdown"), ("json",)


def uploads(spark: SparkSession, path: str, use_ocr: bool = False) -> DataFrame:
    """doc_id (the path), filename, content and use_ocr of every file below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("doc_id"), F.element_at(F.split("path", "/"), -1).alias("filename"), "content", F.lit(use_ocr).alias("use_ocr"))


def first_of(kind: Column, *wanted: str) -> Column:
    """The content of the lexicographically first file of a kind; null without one."""
    return F.decode(F.min_by(F.when(kind.isin(*wanted), F.col("content")), F.when(kind.isin(*wanted), F.col("path"))), "UTF-8")


def artifacts(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the folder below ``path``), markdown and element_json: the first file of either kind, at any depth."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    root = path.rstrip("/").removeprefix("file://") + "/"
    below = F.substring_index(F.col("path"), root, -1)
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)\z", 1))
    wanted = files.withColumns({"doc_id": F.element_at(F.split(below, "/"), 1), "kind": kind}).filter(kind.isin(*MARKDOWN, *ELEMENTS))
    return wanted.groupBy("doc_id").agg(first_of(F.col("kind"), *MARKDOWN).alias("markdown"), first_of(F.col("kind"), *ELEMENTS).alias("element_json"))


def responses(results: DataFrame) -> DataFrame:
    """doc_id, success and markdown: a failure is an empty text, whatever its error."""
    ok = F.coalesce("ok", F.lit(False))
    return results.select("doc_id", ok.alias("success"), F.when(ok, F.coalesce("markdown", F.lit(""))).otherwise(F.lit("")).alias("markdown"))
