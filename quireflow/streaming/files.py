"""Uploads as a stream: files are checked and named as they arrive; every step works on a row alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunking import children
from ..operators.validate import validated
from ..options import Options

FILES = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, path: str, options: Options = Options()) -> DataFrame:
    """doc_id, name and reject_reason of each new file below ``path``."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").load(path)
    named = files.select(F.col("path").alias("doc_id"), F.element_at(F.split("path", "/"), -1).alias("filename"), "content")
    return validated(named, options).select("doc_id", "name", "reject_reason")


def arriving_chunks(spark: SparkSession, path: str, options: Options = Options()) -> DataFrame:
    """The children of each new Markdown file below ``path``."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(path)
    return children(files.select(F.col("path").alias("doc_id"), F.decode("content", "UTF-8").alias("markdown")), options.chunking)
