"""Input checks and names of uploaded documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..options import Options

#: U+FFFD as UTF-8, and how much of it shows that a binary was decoded as text.
REPLACEMENT, LEAST_REPLACEMENTS, LEAST_SHARE = "\xef\xbf\xbd", 100, 0.01
EMPTY, TOO_LARGE, NO_SIGNATURE, CORRUPTED = "empty input", "input exceeds max_bytes", "no PDF signature", "text-decoded or corrupted"


def latin1(content: Column) -> Column:
    """Each byte as a character, so that patterns see bytes."""
    return F.decode(content, "ISO-8859-1")


def looks_corrupted(content: Column) -> Column:
    n = F.regexp_count(latin1(content), F.lit(REPLACEMENT))
    return (n >= LEAST_REPLACEMENTS) & (n * 3 / F.greatest(F.length(content), F.lit(1)) > LEAST_SHARE)


def reject_reason(content: Column, options: Options = Options()) -> Column:
    """The first rule that the bytes break; null if none.  Null content is empty."""
    found = F.when(content.isNull() | (F.length(content) == 0), F.lit(EMPTY)).when(F.length(content) > options.max_bytes, F.lit(TOO_LARGE))
    if options.require_signature:
        found = found.when(~latin1(content).rlike(r"\A[ \t\n\r\x0B\f]*%PDF-"), F.lit(NO_SIGNATURE))
    return found.when(looks_corrupted(content), F.lit(CORRUPTED))


def safe_name(name: Column) -> Column:
    """The last part of a path, with runs of unusual characters as one underscore and the suffix .pdf."""
    given = F.coalesce(F.nullif(name, F.lit("")), F.lit("document.pdf"))
    base = F.regexp_extract(F.regexp_replace(given, r"/+\z", ""), r"([^/]*)\z", 1)
    clean = F.regexp_replace(F.regexp_replace(F.when(base == ".", F.lit("")).otherwise(base), r"[^A-Za-z0-9_ .-]+", "_"), r"\A[ .]+|[ .]+\z", "")
    clean = F.coalesce(F.nullif(clean, F.lit("")), F.lit("document.pdf"))
    stem = F.regexp_replace(clean, r"(?<=.)\.[^.]+\z", "")
    return F.when(F.lower(clean).endswith(".pdf"), clean).otherwise(F.concat(F.coalesce(F.nullif(stem, F.lit("")), F.lit("document")), F.lit(".pdf")))


def validated(docs: DataFrame, options: Options = Options()) -> DataFrame:
    """``docs`` (doc_id, filename, content) with ``name`` and ``reject_reason``."""
    return docs.withColumns({"name": safe_name(F.col("filename")), "reject_reason": reject_reason(F.col("content"), options)})
