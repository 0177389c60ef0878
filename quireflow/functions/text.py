"""Text functions as column expressions, with the meaning that Unicode-aware scripting languages give them.

``WS`` is Unicode white space with the four information separators; a line ends at LF only; digits are those
of any script.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

WS = r"[\s\x1c-\x1f]"
#: Unicode classes; with LF as the only line end; the same, with anchors at lines.
U, UD, UM = "(?U)", "(?Ud)", "(?Udm)"
#: Latin letters, digits and Hangul syllables: what counts as content.
CONTENT = "[0-9A-Za-z가-힣]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"{U}\A{WS}+|{WS}+\z", "")


def lstrip(c: Column) -> Column:
    return F.regexp_replace(c, rf"{U}\A{WS}+", "")


def collapse(c: Column) -> Column:
    return F.regexp_replace(c, rf"{U}{WS}+", " ")


def unix_lines(c: Column) -> Column:
    return F.regexp_replace(c, r"\r\n?", "\n")


def matches(c: Column, pattern: str) -> Column:
    """Whether the whole of ``c`` is ``pattern``."""
    return c.rlike(rf"{UD}\A(?:{pattern})\z")


def normalize_markdown(c: Column) -> Column:
    """LF line ends, no white space at the ends of lines, one empty line at most, none around."""
    lines = F.regexp_replace(unix_lines(c), rf"{U}[\s\x1c-\x1f&&[^\n]]+(?=\n|\z)", "")
    return strip(F.regexp_replace(lines, r"\n{3,}", "\n\n"))


def clean_text(c: Column) -> Column:
    """LF line ends, single spaces, none around line ends or the whole; null is empty."""
    spaced = F.regexp_replace(unix_lines(F.coalesce(c.cast("string"), F.lit(""))), r"[ \t]+", " ")
    return strip(F.regexp_replace(spaced, r" *\n *", "\n"))


def fingerprint(c: Column) -> Column:
    """Lower-case content characters alone; a text in other scripts has an empty one."""
    return F.regexp_replace(F.lower(c), "[^0-9A-Za-z가-힣]+", "")


def has_content(c: Column) -> Column:
    return F.lower(c).rlike(CONTENT)


def inline_cell(c: Column) -> Column:
    return strip(collapse(F.replace(c, F.lit("<br>"), F.lit(" "))))


def table_cell(c: Column) -> Column:
    return strip(F.replace(F.replace(c, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>")))


def as_cell_block(c: Column) -> Column:
    """A rendered block inside a cell: no heading marks at its start, breaks for line ends."""
    bare = F.regexp_replace(strip(c), rf"{U}\A#{{1,6}}{WS}+", "")
    return F.replace(F.replace(bare, F.lit("\n\n"), F.lit("<br>")), F.lit("\n"), F.lit("<br>"))


def page_ranges(pages: Column) -> Column:
    """``Page 1-3, 5`` of an array of page numbers in any order; empty if it is empty."""
    p = F.array_sort(F.array_distinct(F.filter(pages, lambda x: x.isNotNull())))

    def ranges(p: Column) -> Column:
        first = F.filter(p, lambda x, i: F.coalesce(F.get(p, i - 1) != x - 1, F.lit(True)))
        last = F.filter(p, lambda x, i: F.coalesce(F.get(p, i + 1) != x + 1, F.lit(True)))
        text = lambda x: x.cast("string")
        return F.zip_with(first, last, lambda a, b: F.when(a == b, text(a)).otherwise(F.concat_ws("-", text(a), text(b))))

    listed = F.array_join(F.transform(F.array(p), ranges)[0], ", ")
    return F.when(F.size(p) > 0, F.concat(F.lit("Page "), listed)).otherwise(F.lit(""))


def register(spark: SparkSession) -> None:
    """SQL names for the functions: temporary SQL functions, expanded by the optimizer like any expression."""
    for name, body in {
        "md_fingerprint": "regexp_replace(lower(c), '[^0-9A-Za-z가-힣]+', '')",
        "md_strip": r"regexp_replace(c, r'(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z', '')",
        "md_inline_cell": r"md_strip(regexp_replace(replace(c, '<br>', ' '), r'(?U)[\s\x1c-\x1f]+', ' '))",
        "md_clean_text": r"md_strip(regexp_replace(regexp_replace(regexp_replace(coalesce(c, ''), r'\r\n?', '\n'), r'[ \t]+', ' '), ' *\n *', '\n'))",
        "md_normalize": r"md_strip(regexp_replace(regexp_replace(regexp_replace(c, r'\r\n?', '\n'), r'(?U)[\s\x1c-\x1f&&[^\n]]+(?=\n|\z)', ''), '\n{3,}', '\n\n'))",
    }.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(c STRING) RETURNS STRING RETURN {body}")
