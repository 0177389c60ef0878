"""Tables inside element trees: the rules of ``tables``, for matrices that are met while rendering a tree."""

from __future__ import annotations

import re
from collections import Counter
from itertools import accumulate

from .tables import COMPLEX, CONTEXT_COLUMNS, DENSE, DENSER, LONG, LONGEST_LINE, MARKS, MOST_HEADERS, VALUE_SHARE, WIDE

VALUE = re.compile(rf"(?s)\A(?:{MARKS})\Z|.*\d")


def inline(cell: str) -> str:
    return re.sub(r"\s+", " ", cell.replace("<br>", " ")).strip()


def escaped(cell: str) -> str:
    return cell.replace("|", r"\|").replace("\n", "<br>").strip()


def is_value(cell: str) -> bool:
    return VALUE.match(cell) is not None


def header_depth(rows: list[list[str]]) -> int:
    density = [sum(map(bool, r)) / len(r) for r in rows]
    for i, row in list(enumerate(rows))[1 : min(MOST_HEADERS, len(rows) - 1) + 1]:
        cells = list(filter(None, row))
        if len(cells) < 2 or not any(row[:3]):
            continue
        if sum(map(is_value, cells)) >= 2 or (i >= 2 and density[i] >= DENSE and density[i] > max(density[:i]) + DENSER):
            return i
    return 1


def labels(headers: list[list[str]]) -> list[str]:
    spread = [list(accumulate(r, lambda kept, c: c or kept)) for r in headers[:-1]] + headers[-1:]
    names = [" > ".join(dict.fromkeys(filter(None, column))) or f"Column {n}" for n, column in enumerate(zip(*spread, strict=True), 1)]
    seen: Counter[str] = Counter()
    for n, name in enumerate(names):
        seen[name] += 1
        if seen[name] > 1:
            names[n] = f"{name} {seen[name]}"
    return names


def context(rows: list[list[str]]) -> list[int]:
    columns = []
    for n, column in enumerate(list(zip(*rows, strict=True))[:CONTEXT_COLUMNS]):
        if cells := list(filter(None, column)):
            if n and sum(map(is_value, cells)) / len(cells) > VALUE_SHARE:
                break
            columns.append(n)
    return columns


def records(rows: list[list[str]]) -> str:
    """Of inline rows."""
    depth = header_depth(rows)
    names, body = labels(rows[:depth]), [r for r in rows[depth:] if any(r)]
    above: dict[int, str] = {}
    lines, filled = [], context(body)
    for row in body:
        shown = list(row)
        for n in filled:
            if not row[n] and any(row[n + 1 :]):
                shown[n] = above.get(n, "")
            above[n] = row[n] or above.get(n, "")
        lines.append("- " + "; ".join(f"{a}: {b}" for a, b in zip(names, shown, strict=True) if b))
    return "\n".join(["**Table records:**", *lines]) if lines else ""


def grid_or_records(matrix: list[list[str]]) -> str:
    matrix = [r for r in matrix if any(c.strip() for c in r)]
    if not matrix:
        return ""
    width = max(map(len, matrix))
    matrix = [r + [""] * (width - len(r)) for r in matrix]
    rows = [[inline(c) for c in r] for r in matrix]
    cells = [[escaped(c) for c in r] for r in matrix]
    longest = max(sum(len(c) + 3 for c in r) + 2 for r in cells)
    if width > WIDE or (width >= COMPLEX and header_depth(rows) > 1) or (width >= LONG and longest > LONGEST_LINE):
        return records(rows)
    lines = [f"| {' | '.join(r)} |" for r in cells]
    return "\n".join([lines[0], f"| {' | '.join(['---'] * width)} |", *lines[1:]])
