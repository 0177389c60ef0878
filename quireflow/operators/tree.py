"""Element trees to page texts and placed items, for trees of any shape and depth.

A tree is laid out as frames from the top, each with the context it is rendered in, and rendered from the
bottom by going through the frames backwards; nothing recurses.  This part needs Python, since Spark has no
recursive types; what it gives out is flat, and layouts, pages and documents are put together natively.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

from .gates import IMAGE_ONLY, VISUAL_PAGE
from .layout import RUNNING_LABELS
from .matrix import grid_or_records

DROPPED = frozenset({"header", "footer"})
CONTAINERS = frozenset({"document", "page", "text block", "block", "section"})
IMAGES = frozenset({"image", "picture", "figure"})
NUMBERED = ("ordered", "decimal", "number", "arabic")
NESTED = ("kids", "children", "rows", "cells", "list items", "items")
#: A page of images with less content than this gets a note.
THIN_PAGE = 40
LABELS = [re.compile(label.replace(r"[\s\x1c-\x1f]", r"\s").replace(r"[^\s\x1c-\x1f]", r"\S")) for label in RUNNING_LABELS]


def clean(value: Any) -> str:
    text = "" if value is None else str(value)
    text = re.sub(r"[ \t]+", " ", re.sub(r"\r\n?", "\n", text))
    return re.sub(r" *\n *", "\n", text).strip()


def number(value: Any, default: Any, kind: type = int) -> Any:
    """``value`` as a number; what is none, infinity included, is the default."""
    try:
        return kind(value)
    except (TypeError, ValueError, OverflowError):
        return default


def kind_of(element: dict) -> str:
    return str(element.get("type", "")).strip().lower()


def listed(element: dict, *keys: str) -> list | None:
    """The first of the values that is not empty; None if that is no list."""
    found = next((element[k] for k in keys if element.get(k)), [])
    return found if isinstance(found, list) else None


def kids(element: dict) -> list[dict]:
    return [k for k in listed(element, "kids", "children") or [] if isinstance(k, dict)]


def subtree(element: dict) -> Iterator[dict]:
    stack = [element]
    while stack:
        at = stack.pop()
        yield at
        for key in NESTED:
            if isinstance(inner := at.get(key), list):
                stack.extend(x for x in inner if isinstance(x, dict))


def has_text(element: dict) -> bool:
    return any(clean(x.get("content", "")) for x in subtree(element))


def has_image(element: dict) -> bool:
    return any(kind_of(x) in IMAGES for x in subtree(element))


def is_running_label(text: str) -> bool:
    one_line = " ".join(text.split())
    return any(p.fullmatch(one_line) for p in LABELS)


def heading_level(element: dict) -> int:
    """One to six.  Levels beyond six come from the font; a level in words from its first digits; else two."""
    if "heading level" in element:
        level = number(element["heading level"], 1)
        if level > 6:
            font = number(element.get("font size"), 0.0, float)
            return 2 if font >= 16 else 3 if font >= 11 else 4
    else:
        digits = re.search(r"\d+", str(element.get("level", "")))
        if digits is None:
            return 2
        level = int(digits[0])
    return max(1, min(6, level))


class Frame:
    """An element in its context: ``role`` is block, item of a list, or cell; ``depth`` that of lists around."""

    __slots__ = ("depth", "element", "inner", "role", "text")

    def __init__(self, element: dict, depth: int = 0, role: str = "block") -> None:
        self.element, self.depth, self.role, self.text, self.inner = element, depth, role, "", []

    def open(self) -> list[Frame]:
        """The frames that this one's text is made of."""
        e, kind = self.element, kind_of(self.element)
        if self.role != "block":
            self.inner = [Frame(k, self.depth) for k in kids(e)]
        elif kind == "list item":
            self.inner = [Frame(k, self.depth) for k in kids(e)]
        elif kind == "list":
            self.inner = [Frame(k if isinstance(k, dict) else {}, self.depth + 1, "item") for k in listed(e, "list items", "items", "kids") or []]
        elif kind == "table":
            self.inner = [Frame(c, 0, "cell") for r in listed(e, "rows") or [] if isinstance(r, dict) for c in self.cells(r)]
        elif kind not in DROPPED | IMAGES | {"heading", "paragraph", "text", "caption"}:
            self.inner = [Frame(k) for k in kids(e)]
        return self.inner

    @staticmethod
    def cells(row: dict) -> list[dict]:
        found = [c for c in listed(row, "cells", "kids") or [] if isinstance(c, dict)]
        return sorted(found, key=lambda c: (number(c.get("row number"), 1), number(c.get("column number"), 1)))

    def close(self) -> None:
        """Makes the text from that of the inner frames."""
        e, kind = self.element, kind_of(self.element)
        content = clean(e.get("content", ""))
        parts = [f.text for f in self.inner if f.text]
        if self.role == "cell":
            self.text = "<br>".join(p for p in [content, *map(as_cell_block, parts)] if p)
        elif self.role == "item" or kind == "list item":
            self.text = "\n".join(p for p in [content, *parts] if p)
        elif kind in DROPPED:
            self.text = ""
        elif kind in CONTAINERS:
            self.text = "\n\n".join(parts)
        elif kind == "heading":
            self.text = f"{'#' * heading_level(e)} {content}" if content else ""
        elif kind in ("paragraph", "text"):
            self.text = content
        elif kind == "caption":
            self.text = f"*{content}*" if content else ""
        elif kind in IMAGES:
            told = clean(e.get("description", "") or e.get("content", ""))
            self.text = f"**Image summary:** {told}" if told else ""
        elif kind == "list":
            self.text = self.bullets()
        elif kind == "table":
            self.text = self.table()
        else:
            self.text = "\n\n".join(p for p in [content, *parts] if p)

    def bullets(self) -> str:
        """Items are numbered by their place, empty ones counted."""
        style = str(self.element.get("numbering style", "")).lower()
        numbered = any(mark in style for mark in NUMBERED)
        indent = "  " * self.depth
        lines = [(f"{n}. " if numbered else "- ") + f.text.replace("\n", f"\n{indent}  ") for n, f in enumerate(self.inner, 1) if f.text]
        return "\n".join(indent + line for line in lines)

    def table(self) -> str:
        texts = iter(self.inner)
        matrix = []
        for row in listed(self.element, "rows") or []:
            if isinstance(row, dict):
                line: list[str] = []
                for cell in self.cells(row):
                    line += [""] * (number(cell.get("column number"), 0) - 1 - len(line))
                    line.append(next(texts).text)
                    line += [""] * (number(cell.get("column span"), 1) - 1)
                matrix.append(line)
        return grid_or_records(matrix)


def as_cell_block(text: str) -> str:
    return re.sub(r"\A#{1,6}\s+", "", text.strip()).replace("\n\n", "<br>").replace("\n", "<br>")


def render(element: dict) -> str:
    frames, stack = [], [Frame(element)]
    while stack:
        frames.append(frame := stack.pop())
        stack.extend(frame.open())
    for frame in reversed(frames):
        frame.close()
    return frames[0].text


def placed_items(elements: list[dict]) -> list[dict]:
    """Texts with a bounding box in reading order, outside images, tables, headers and footers."""
    out: list[dict] = []
    stack = list(reversed(elements))
    while stack:
        e = stack.pop()
        kind = kind_of(e)
        if kind in IMAGES | DROPPED | {"table"}:
            continue
        box = e.get("bounding box")
        box = [number(x, None, float) for x in box] if isinstance(box, list) and len(box) == 4 else [None]
        if (text := clean(e.get("content", ""))) and None not in box:
            font = number(e.get("font size"), 0.0, float)
            out.append(dict(zip(("x0", "y0", "x1", "y1"), box, strict=True)) | {"idx": len(out), "text": text, "type": kind, "font_size": font})
        inner = kids(e)
        if kind == "list":
            more = next((e[k] for k in ("list items", "items") if e.get(k)), [])
            inner += [x for x in more if isinstance(x, dict)]
        stack.extend(reversed(inner))
    return out


def on_page(element: dict) -> bool:
    kind = kind_of(element)
    return kind not in DROPPED and not is_running_label(clean(element.get("content", ""))) and not (kind == "table" and not has_text(element))


def flow(elements: list[dict], shown: list[dict]) -> str:
    """The page's blocks in order, and a note where images are all or most of it."""
    blocks = [b for b in map(render, shown) if b]
    if not blocks and any(kind_of(e) in IMAGES for e in shown):
        return IMAGE_ONLY
    thin = len(re.sub("[^0-9A-Za-z가-힣]", "", "\n".join(blocks).lower())) < THIN_PAGE
    if thin and any(has_image(e) and not has_text(e) for e in elements):
        blocks.append(VISUAL_PAGE)
    return "\n\n".join(blocks)


ITEM = "struct<idx:int,text:string,type:string,x0:double,y0:double,x1:double,y1:double,font_size:double>"
ITEM_TYPE = pa.struct([("idx", pa.int32()), ("text", pa.string()), ("type", pa.string()), *((n, pa.float64()) for n in ("x0", "y0", "x1", "y1", "font_size"))])


def parsed(text: str | None):
    """The tree of a JSON text, None without one; ValueError for what is no JSON, is nested too deep to be
    read, or has characters that no UTF-8 text can have."""
    try:
        tree = json.loads(text) if text and text.strip() else None
        if tree is not None and re.search(r"\\u[dD][89a-fA-F]", text):
            json.dumps(tree, ensure_ascii=False).encode()
    except RecursionError as e:
        raise ValueError("nested too deep") from e
    return tree


def pages_of(text: str | None) -> Iterator[tuple[int | None, str, list[dict]]]:
    """(page, flow, items) of a document's JSON.

    Elements without a page are dropped where any has one; else all are page 0, without layouts.  A text that is
    no JSON gives the page None; no tree, or one without elements, gives nothing.
    """
    try:
        tree = parsed(text)
    except ValueError:
        yield None, "", []
        return
    elements = kids(tree) if isinstance(tree, dict) else []
    paged: dict[int, list[dict]] = {}
    for e in elements:
        if (page := number(e.get("page number", 0), 0)) > 0:
            paged.setdefault(page, []).append(e)
    if paged:
        for page, own in paged.items():
            shown = [e for e in own if on_page(e)]
            yield page, flow(own, shown), placed_items(shown)
    elif elements:
        yield 0, "\n\n".join(b for b in map(render, elements) if b), []


def element_pages(docs: DataFrame) -> DataFrame:
    """doc_id, page_no, flow and items of every page of ``docs`` (doc_id string, element_json)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, *page) for d, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) for page in pages_of(t)]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            kinds = (pa.string(), pa.int64(), pa.string(), pa.list_(ITEM_TYPE))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "page_no", "flow", "items"])

    return docs.select("doc_id", "element_json").mapInArrow(run, f"doc_id string, page_no long, flow string, items array<{ITEM}>")


NODE = "doc_id string, path array<int>, parent_path array<int>, edge string, depth int, type string, content string, description string, page_no int, bbox array<double>, font_size double, heading_level int, row_no int, col_no int, col_span int"
EDGES = (("kids", ("kids", "children")), ("list_items", ("list items", "items")), ("rows", ("rows",)), ("cells", ("cells",)))


def flattened(docs: DataFrame) -> DataFrame:
    """One row per node of each tree; ``path`` orders them as they are read."""

    def nodes(doc_id: str, text: str | None) -> Iterator[tuple]:
        try:
            tree = parsed(text)
        except ValueError:
            return
        stack: list[tuple[list[int], str, dict]] = [([n], "kids", e) for n, e in reversed(list(enumerate(kids(tree))))] if isinstance(tree, dict) else []
        while stack:
            path, edge, e = stack.pop()
            box = e.get("bounding box")
            box = [number(x, None, float) for x in box] if isinstance(box, list) and len(box) == 4 else None
            kind = kind_of(e)
            yield (
                doc_id, path, path[:-1], edge, len(path), kind, clean(e.get("content", "")), clean(e.get("description", "")), number(e.get("page number"), None),
                box if box and None not in box else None, number(e.get("font size"), None, float), heading_level(e) if kind == "heading" else None,
                number(e.get("row number"), None), number(e.get("column number"), None), number(e.get("column span"), None),
            )
            inner = [(name, x) for name, keys in EDGES for x in listed(e, *keys) or [] if isinstance(x, dict)]
            stack.extend(([*path, n], name, x) for n, (name, x) in reversed(list(enumerate(inner))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ints = pa.list_(pa.int32())
        kinds = (pa.string(), ints, ints, pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.float64()), pa.float64(), *[pa.int32()] * 4)
        names = [f.split(" ", 1)[0] for f in NODE.split(", ")]
        for batch in batches:
            rows = [r for d, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) for r in nodes(d, t)]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return docs.select("doc_id", "element_json").mapInArrow(run, NODE)
