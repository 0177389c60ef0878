"""The staged chain of extraction attempts: each stage sees only the documents that are still open.

An extractor is anything with ``extract(docs, source, mode)``: it takes a table (doc_id, use_ocr) and returns
one row per document with the artifacts of one attempt, doc_id, error, markdown (its Markdown file, null:
none) and rendered (the rendering of its elements, null: none).  ``source`` is the chain of repairs that the
input went through, ``mode`` native, auto or full.  A non-null error is a failure of the attempt itself.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..options import Options
from ..sources.shared import staged
from .gates import choose_native, choose_rendered, needs_ocr

ORIGINAL, LIGHT, FULL, RASTER = "original", "qpdf-repaired", "repaired", "rasterized"
NOT_SELECTED = "OCR is needed, but OCR was not selected"
NO_ANSWER = "the extractor gave no answer"
OCR_OFF = "OCR fallback is disabled"
AFTER_OCR = "failed after OCR fallback attempt: "
AFTER_ALL = "failed after fallback attempts: "
RESULT = ["doc_id", "ok", "markdown", "error"]


class Extractor(Protocol):
    def extract(self, docs: DataFrame, source: tuple[str, ...], mode: str) -> DataFrame: ...


Keep = Callable[[DataFrame, str], DataFrame]


def answers(docs: DataFrame, extractor: Extractor, source: tuple[str, ...], mode: str) -> DataFrame:
    """One row for each of ``docs`` with the extractor's answer; a document without any gets an error."""
    given = extractor.extract(docs.select("doc_id", "use_ocr"), source, mode).select("doc_id", "error", "markdown", "rendered", F.lit(True).alias("answered")).dropDuplicates(["doc_id"])
    joined = docs.join(given, "doc_id", "left")
    return joined.withColumn("error", F.when(F.col("answered").isNull(), F.lit(NO_ANSWER)).otherwise(F.col("error"))).drop("answered")


def attempt(docs: DataFrame, extractor: Extractor, source: tuple[str, ...], options: Options, keep: Keep, mode: str | None = None) -> DataFrame:
    """doc_id, ok, markdown, error: the text layer first, then the layout-aware extractor for what failed.

    With a mode of its own an attempt goes to the latter at once.  Both messages are kept if both fail.
    """
    first = docs.select("doc_id", "use_ocr", F.lit(None).cast("string").alias("native_error"))
    done = None
    if options.native_first and mode is None:
        tried = answers(docs.select("doc_id", "use_ocr"), extractor, source, "native")
        result = F.when(F.col("error").isNull(), choose_native(F.col("rendered"), F.col("markdown")))
        native = keep(tried.select("doc_id", "use_ocr", result.alias("r"), F.coalesce(F.col("error"), result["error"]).alias("native_error")), "native")
        done = native.filter("native_error is null").select("doc_id", F.lit(True).alias("ok"), "r.markdown", F.lit(None).cast("string").alias("error"))
        first = native.filter("native_error is not null").select("doc_id", "use_ocr", "native_error")
    first = keep(first, "open")
    tried = answers(first, extractor, source, mode or options.hybrid_mode)
    result = F.when(F.col("error").isNull(), choose_rendered(F.col("rendered"), F.col("markdown"), ~F.col("use_ocr")))
    error = F.coalesce(F.col("error"), result["error"])
    message = F.when(error.isNotNull(), F.concat_ws("; native: ", error, "native_error"))
    hybrid = tried.select("doc_id", error.isNull().alias("ok"), result["markdown"].alias("markdown"), message.alias("error"))
    return hybrid if done is None else done.unionByName(hybrid)


def convert(docs: DataFrame, extractor: Extractor, options: Options = Options(), keep: Keep | None = None) -> DataFrame:
    """doc_id, ok, markdown, error of every document (doc_id, use_ocr), by the chain of stages.

    Stages: as it is; after a light repair; after a full repair; rasterized and recognised.  A failure that asks
    for text recognition ends the chain: with that one attempt, or at once where recognition was not selected
    or is off.  ``keep(df, name)`` materialises a stage's result, so that no attempt is made twice: by default in the shared folder.
    """
    keep = keep or staged
    pending = docs.select("doc_id", "use_ocr", F.expr("cast(array() as array<string>)").alias("errors"))
    results = []

    def fail(df: DataFrame, message) -> DataFrame:
        return df.select("doc_id", F.lit(False).alias("ok"), F.lit(None).cast("string").alias("markdown"), message.alias("error"))

    def with_error(df: DataFrame, label: str, error) -> DataFrame:
        return df.withColumn("errors", F.array_append("errors", F.concat(F.lit(f"{label}: "), error)))

    def recognised(df: DataFrame, source: tuple[str, ...], label: str, prefix: str) -> None:
        """One attempt on the rasterized source; what fails then has failed."""
        tried = keep(df.join(attempt(df, extractor, (*source, "rasterized"), options, keep, "full"), "doc_id"), label)
        results.append(tried.filter("ok").select(*RESULT))
        failed = with_error(tried.filter("not ok"), label, F.col("error"))
        results.append(fail(failed, F.concat(F.lit(prefix), F.array_join("errors", "; "))))

    source: tuple[str, ...] = ()
    stages = [(ORIGINAL, True, None), (LIGHT, options.light_repair, "light"), (FULL, options.full_repair, "full")]
    for label, on, repair in stages:
        if not on:
            continue
        source = (*source, repair) if repair else source
        tried = keep(pending.join(attempt(pending, extractor, source, options, keep), "doc_id"), label)
        results.append(tried.filter("ok").select(*RESULT))
        failed = with_error(tried.filter("not ok"), label, F.col("error"))
        ocr = failed.filter(needs_ocr(F.col("error")))
        results.append(fail(ocr.filter(~F.col("use_ocr")), F.lit(NOT_SELECTED)))
        asked = ocr.filter("use_ocr").select("doc_id", "use_ocr", "errors")
        if options.rasterize:
            recognised(asked, source, f"{label}-ocr", AFTER_OCR)
        else:
            results.append(fail(with_error(asked, f"{label}-ocr", F.lit(OCR_OFF)), F.concat(F.lit(AFTER_OCR), F.array_join("errors", "; "))))
        pending = failed.filter(~needs_ocr(F.col("error"))).select("doc_id", "use_ocr", "errors")
    last = pending.filter("use_ocr") if options.rasterize else None
    if last is not None:
        recognised(last, source, f"{RASTER}-ocr", AFTER_ALL)
        pending = pending.filter(~F.col("use_ocr"))
    results.append(fail(pending, F.concat(F.lit(AFTER_ALL), F.array_join("errors", "; "))))
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out
