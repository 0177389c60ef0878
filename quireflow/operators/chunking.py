"""Markdown to parent and child sections.

Blocks are found natively: runs of blocks between separators get their pages at once.  Sections are cut in one
pass over a document's blocks, linear in its length, in Arrow batches: a document is a row, so nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import CONTENT, UD, WS, U, has_content, normalize_markdown, page_ranges, strip
from ..options import ChunkingOptions

DEFAULT_TITLE = "Document section"
MARKER = r"--- Page (\d+) ---"
HEADING = rf"{UD}\A(#{{1,6}}){WS}+(.+)\z"


def block(text: Column, page: Column) -> Column:
    """A block with its page: its own, if it is a separator, else ``page``."""
    own = F.regexp_extract(text, rf"{UD}\A{MARKER}\z", 1)
    marker = own != ""
    level = F.when(text.rlike(HEADING), F.length(F.regexp_extract(text, HEADING, 1)))
    return F.struct(
        text.alias("text"),
        F.when(marker, own.try_cast("bigint")).otherwise(page).alias("page"),
        level.cast("int").alias("level"),
        F.when(level.isNotNull(), strip(F.regexp_extract(text, HEADING, 2))).alias("title"),
        marker.alias("marker"),
        (~marker & level.isNull() & has_content(text)).alias("body"),
        F.length(text).alias("len"),
    )


def blocks_of(text: Column) -> Column:
    """Blocks between empty lines; each takes the page of the latest separator at or before it."""
    parts = F.filter(F.transform(F.split(text, rf"{U}\n{WS}*\n"), strip), lambda b: b != "")
    place = "struct<at:int,page:bigint>"

    def paged(p: Column) -> Column:
        marks = F.transform(p, lambda b, i: F.struct(i.cast("int").alias("at"), F.regexp_extract(b, rf"{UD}\A{MARKER}\z", 1).alias("own")))
        marks = F.filter(marks, lambda m: m["own"] != "")
        marks = F.transform(marks, lambda m: F.struct(m["at"].alias("at"), m["own"].try_cast("bigint").alias("page")))
        return F.concat(F.expr(f"array(cast(named_struct('at', 0, 'page', null) as {place}))"), marks)

    def run(p: Column, marks: Column) -> Column:
        def of(m: Column, k: Column) -> Column:
            end = F.coalesce(F.get(marks, k + 1)["at"], F.size(p))
            return F.transform(F.slice(p, m["at"] + 1, end - m["at"]), lambda b: block(b, m["page"]))

        return F.flatten(F.transform(marks, of))

    return F.transform(F.array(parts), lambda p: F.transform(F.array(paged(p)), lambda marks: run(p, marks))[0])[0]


def pages_of(blocks: Column) -> Column:
    return page_ranges(F.transform(blocks, lambda b: b["page"]))


class Block(NamedTuple):
    text: str
    page: int | None = None
    level: int | None = None
    title: str = ""
    marker: bool = False
    body: bool = False


def read_blocks(text: str) -> list[Block]:
    """The blocks of a normalized text, as ``blocks_of`` finds them."""
    found, page = [], None
    for part in filter(None, map(str.strip, re.split(r"\n\s*\n", text))):
        if own := re.fullmatch(MARKER, part):
            page = int(own[1])
            found.append(Block(part, page, marker=True))
        elif head := re.fullmatch(r"(#{1,6})\s+(.+)", part):
            found.append(Block(part, page, len(head[1]), head[2].strip()))
        else:
            found.append(Block(part, page, body=re.search(CONTENT, part.lower()) is not None))
    return found


class Path:
    """The headings above a place, one for each level."""

    def __init__(self) -> None:
        self.names: list[str | None] = [None] * 6

    def enter(self, b: Block) -> None:
        self.names[b.level - 1 :] = [b.title, *[None] * (6 - b.level)]

    def __str__(self) -> str:
        return " > ".join(x for x in self.names if x) or DEFAULT_TITLE


def cut(blocks: list[Block], limit: int, headings: bool) -> list[tuple[list[Block], str]]:
    """Sections of ``blocks``, each with the title it has if its own headings give none.

    With ``headings`` a heading of level one or two begins a section once the current one has content, and takes
    along a separator that stands last; headings never overflow a section then.  A block that would overflow
    begins the next.  A section begins with the separator of its page.  What has no content at the end is dropped.
    """
    made: list[tuple[list[Block], str]] = []
    own: list[Block] = []
    size, body, name, path = 0, False, DEFAULT_TITLE, Path()
    for b in blocks:
        head = headings and b.level is not None
        ends = b.level <= 2 if head else not b.marker and 0 < limit < size + len(b.text)
        fresh = body and ends
        if fresh:
            lead = own.pop() if head and own[-1].marker else None
            made.append((own, name))
            if lead is None and b.page is not None:
                lead = Block(f"--- Page {b.page} ---", b.page, marker=True)
            own, body = [lead] if lead else [], False
            size = len(lead.text) if lead else 0
        if head:
            path.enter(b)
            if fresh or name == DEFAULT_TITLE:
                name = str(path)
        size += len(b.text) + (2 if own else 0)
        own.append(b)
        body = body or b.body
    return [*made, (own, name)] if body else made


def title_of(blocks: list[Block], name: str) -> str:
    """The path of a section's own headings; ``name`` if it has none, or none of level one."""
    path, heads = Path(), [b for b in blocks if b.level is not None]
    for b in heads:
        path.enter(b)
    own = heads and (name == DEFAULT_TITLE or any(b.level == 1 for b in heads))
    return str(path) if own else name


def joined(blocks: list[Block]) -> str:
    return "\n\n".join(b.text for b in blocks)


def source_of(blocks: list[Block]) -> str:
    """``Page 1-3, 5`` of the pages of ``blocks``; empty without any."""
    runs: list[list[int]] = []
    for page in sorted({b.page for b in blocks if b.page is not None}):
        if runs and runs[-1][1] == page - 1:
            runs[-1][1] = page
        else:
            runs.append([page, page])
    return "Page " + ", ".join(str(a) if a == b else f"{a}-{b}" for a, b in runs) if runs else ""


def tail(blocks: list[Block], size: int) -> str:
    """The last ``size`` characters of a section's text on one line, without separators and heading marks."""
    text = re.sub(r"(?m)^#{1,6}\s+", "", joined([b for b in blocks if not b.marker]))
    text = re.sub(r"\s+", " ", text).strip()
    if size <= 0 or len(text) <= size:
        return text if size > 0 else ""
    return "..." + text[-size:].lstrip()


def parents_of(text: str, options: ChunkingOptions) -> list[dict]:
    """Parent sections of a normalized text, with their children."""
    parents = []
    for blocks, name in cut(read_blocks(text), options.parent_max_chars, True):
        title, source, before, kids = title_of(blocks, name), source_of(blocks), [], []
        for part, _ in cut(blocks, options.child_target_chars, False):
            kids.append({"title": title, "source": source_of(part) or source or "Unknown page", "previous_context": tail(before, options.child_overlap_chars), "content": joined(part)})
            before = part
        parents.append({"title": title, "content": joined(blocks), "children": kids})
    return parents


PARENTS = "array<struct<title:string,content:string,children:array<struct<title:string,source:string,previous_context:string,content:string>>>>"


def with_sections(docs: DataFrame, options: ChunkingOptions = ChunkingOptions()) -> DataFrame:
    """``docs`` (doc_id, markdown) with ``normal`` and ``parents``: title, content and children of each.

    A child has title, source (its pages, else its parent's), previous_context (the end of the child before in
    the same parent) and content.  Null texts count as empty.
    """
    d = docs.select("doc_id", normalize_markdown(F.coalesce("markdown", F.lit(""))).alias("normal"))
    child = pa.struct([(n, pa.string()) for n in ("title", "source", "previous_context", "content")])
    kind = pa.list_(pa.struct([("title", pa.string()), ("content", pa.string()), ("children", pa.list_(child))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # A batch of texts grows severalfold as sections: a few rows at a time.
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                made = [parents_of(t, options) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(made, kind)], ["doc_id", "normal", "parents"])

    return d.mapInArrow(run, StructType([*d.schema.fields, *StructType.fromDDL(f"parents {PARENTS}").fields]))


def children(docs: DataFrame, options: ChunkingOptions = ChunkingOptions()) -> DataFrame:
    """doc_id, parent_idx, child_idx, title, source, previous_context, content: one row per child."""
    p = with_sections(docs, options).select("doc_id", F.posexplode("parents").alias("parent_idx", "p"))
    c = p.select("doc_id", "parent_idx", F.posexplode("p.children").alias("child_idx", "c"))
    return c.select("doc_id", "parent_idx", "child_idx", "c.title", "c.source", "c.previous_context", "c.content")


def rendered(parents: Column, options: ChunkingOptions) -> Column:
    """The delimited text of all parents that have children."""

    def child(c: Column) -> Column:
        context = F.when(c["previous_context"] != "", F.concat(F.lit("> Previous context: "), c["previous_context"]))
        content = F.nullif(c["content"], F.lit(""))
        text = F.concat_ws("\n\n", F.concat(F.lit("Section: "), c["title"]), F.concat(F.lit("Source: "), c["source"]), context, F.lit("Content:"), content)
        return F.concat(F.lit(options.child_delimiter + "\n\n"), strip(text))

    def parent(p: Column) -> Column:
        return F.concat(F.lit(options.parent_delimiter + "\n\n"), F.array_join(F.transform(p["children"], child), "\n\n"))

    return F.array_join(F.transform(F.filter(parents, lambda p: F.size(p["children"]) > 0), parent), "\n\n")


def chunked(docs: DataFrame, options: ChunkingOptions = ChunkingOptions()) -> DataFrame:
    """doc_id and chunked: the delimited text.

    An empty text stays empty; a text that already has a delimiter, or no content to chunk, is only normalized.
    """
    d = with_sections(docs, options)
    normal = F.col("normal")
    done = F.contains(normal, F.lit(options.parent_delimiter)) | F.contains(normal, F.lit(options.child_delimiter))
    text = normalize_markdown(rendered(F.col("parents"), options))
    return d.select("doc_id", F.when(done | (normal == ""), normal).otherwise(F.coalesce(F.nullif(text, F.lit("")), normal)).alias("chunked"))
