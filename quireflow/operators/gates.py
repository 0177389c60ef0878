"""Quality gates on Markdown, as boolean columns, and the choices that they decide."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import UM, WS, has_content, strip

#: What stands for pages without text.
IMAGE_ONLY = "> Image-only page. No embedded text layer was available."
VISUAL_PAGE = "> 이미지/도식 중심 페이지로, PDF 텍스트 레이어에서 확인되는 문구만 포함했습니다."
#: Lines that carry no content.
SEPARATOR = rf"{UM}^{WS}*--- Page \d+ ---{WS}*$"
IMAGE_LINE = rf"{UM}^{WS}*!\[[^\]]*\]\((?:<[^>]+>|[^)]+)\){WS}*$"
IMAGE_ONLY_LINE = rf"{UM}^>{WS}*{IMAGE_ONLY[2:].replace('.', '[.]')}{WS}*$"
VISUAL_PAGE_LINE = rf"{UM}^>{WS}*{VISUAL_PAGE[2:].replace('.', '[.]')}{WS}*$"
EMPTY_ROW = rf"{UM}^{WS}*\|(?:{WS}*\|)+{WS}*$"
TABLE_RULE = rf"{UM}^{WS}*\|(?:{WS}*:?-+:?{WS}*\|)+{WS}*$"
HEADING_LINE = rf"{UM}^#{{1,6}}{WS}+.*$"
#: Part of the messages by which a failure asks for text recognition.
NEEDS_OCR = ("ocr fallback required", "visual pages without ocr text")
NOTHING_USABLE = "no usable text or image description; OCR fallback required"
UNRESOLVED = "visual pages without OCR text or image description"
NO_MARKDOWN = "no Markdown"
TOO_FEW = "too few content pages"


def without(c: Column, *patterns: str) -> Column:
    for p in patterns:
        c = F.regexp_replace(c, p, "")
    return c


def meaningful(md: Column) -> Column:
    """Something is left without separators, images, placeholders and empty tables."""
    rest = without(strip(md), SEPARATOR, IMAGE_LINE, IMAGE_ONLY_LINE, VISUAL_PAGE_LINE, EMPTY_ROW, TABLE_RULE)
    return F.coalesce(strip(rest) != "", F.lit(False))


def presentable(md: Column) -> Column:
    """Something is left without separators and empty tables; placeholders count."""
    return F.coalesce(strip(without(strip(md), SEPARATOR, EMPTY_ROW, TABLE_RULE)) != "", F.lit(False))


def has_placeholder(md: Column) -> Column:
    return md.rlike(IMAGE_ONLY_LINE) | md.rlike(VISUAL_PAGE_LINE)


def pages(md: Column) -> Column:
    """The texts behind separators; the whole text if there is none."""
    return F.transform(F.array(F.split(md, SEPARATOR)), lambda p: F.when(F.size(p) > 1, F.slice(p, F.lit(2), F.size(p))).otherwise(p))[0]


def unresolved(md: Column) -> Column:
    """A page has a placeholder, and no content besides headings."""
    rest = lambda p: without(p, IMAGE_LINE, IMAGE_ONLY_LINE, VISUAL_PAGE_LINE, HEADING_LINE)
    return F.coalesce(F.exists(pages(md), lambda p: has_placeholder(p) & ~has_content(rest(p))), F.lit(False))


def has_separators(md: Column) -> Column:
    return F.coalesce(md.rlike(SEPARATOR), F.lit(False))


def enough_pages(md: Column) -> Column:
    """Of two or three pages one has content, of more a fifth and two at least; one page is always enough."""
    n = F.size(F.split(md, SEPARATOR)) - 1
    full = F.size(F.filter(pages(md), meaningful))
    return F.when(n <= 1, F.lit(True)).when(n <= 3, full > 0).otherwise(full >= F.greatest(F.lit(2), F.floor(n / 5)))


def outcome(ok: Column, text: Column, error: Column) -> Column:
    """struct(ok, markdown, error): either text or error is null."""
    return F.struct(ok.alias("ok"), F.when(ok, text).alias("markdown"), F.when(~ok, error).alias("error"))


def choose_rendered(rendered: Column, fallback: Column, allow_unresolved: Column) -> Column:
    """Of a layout-aware extraction: the rendering of its elements (null: there are none), else its Markdown.

    A rendering whose only fault is an unresolved page is an error, however good the Markdown.
    """
    there = rendered.isNotNull()
    blocked = there & meaningful(rendered) & unresolved(rendered)
    text = F.coalesce(fallback, F.lit(""))
    picked = (
        F.when(there & allow_unresolved & presentable(rendered), rendered)
        .when(there & meaningful(rendered) & ~unresolved(rendered), rendered)
        .when(blocked, F.lit(None).cast("string"))
        .when(allow_unresolved & presentable(text), text)
        .when(meaningful(text) & ~unresolved(text), text)
    )
    return outcome(picked.isNotNull(), picked, F.when(blocked, F.lit(UNRESOLVED)).otherwise(F.lit(NOTHING_USABLE)))


def choose_native(rendered: Column, markdown: Column) -> Column:
    """Of a text-layer extraction: a Markdown file must be there; the rendering is preferred; three gates."""
    text = F.coalesce(rendered, markdown)
    error = (
        F.when(markdown.isNull() | ~meaningful(text), F.lit(NO_MARKDOWN))
        .when(unresolved(text), F.lit(UNRESOLVED))
        .when(has_separators(text) & ~enough_pages(text), F.lit(TOO_FEW))
    )
    return outcome(error.isNull(), text, error)


def needs_ocr(error: Column) -> Column:
    low = F.lower(F.coalesce(error, F.lit("")))
    return F.contains(low, F.lit(NEEDS_OCR[0])) | F.contains(low, F.lit(NEEDS_OCR[1]))
