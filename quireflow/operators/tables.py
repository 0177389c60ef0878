"""Table matrices (arrays of rows of cell texts) to Markdown grids or records, natively."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import UD, inline_cell, matches, strip, table_cell

#: When a table is rendered as records.
WIDE, COMPLEX, LONG, LONGEST_LINE, MOST_HEADERS, CONTEXT_COLUMNS, VALUE_SHARE = 12, 6, 8, 1600, 6, 5, 0.45
DENSE, DENSER = 0.45, 0.15
#: Marks that count as values.
MARKS = "[◈○●■□☐☑✓✔✗OXox-]+|N/A|n/a"
STRINGS = "cast(array() as array<string>)"
ROWS = "cast(array() as array<array<string>>)"


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), use)[0]


def width(m: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(m, F.size)), F.lit(0))


def padded(m: Column) -> Column:
    return let(width(m), lambda w: F.transform(m, lambda r: F.concat(r, F.array_repeat(F.lit(""), w - F.size(r)))))


def prepared(m: Column) -> Column:
    """The rows with any text, padded to a rectangle."""
    return padded(F.filter(m, lambda r: F.exists(r, lambda c: strip(c) != "")))


def is_value(cell: Column) -> Column:
    """A digit anywhere, or nothing but marks; of an inline cell."""
    return cell.rlike(rf"{UD}\d") | matches(cell, MARKS)


def inline(m: Column) -> Column:
    return F.transform(m, lambda r: F.transform(r, inline_cell))


def filled(row: Column) -> Column:
    return F.size(F.filter(row, lambda c: c != ""))


def header_depth(m: Column) -> Column:
    """How many rows are headers: up to the first of the next six that looks like data, else one."""

    def of(n: Column) -> Column:
        w = width(n)
        density = F.transform(n, lambda r: F.when(w > 0, filled(r) / w).otherwise(F.lit(0.0)))

        def data(i: Column) -> Column:
            row = F.get(n, i)
            before = F.coalesce(F.array_max(F.slice(density, F.lit(1), i)), F.lit(0.0))
            enough = (filled(row) >= 2) & F.exists(F.slice(row, 1, 3), lambda c: c != "")
            values = F.size(F.filter(row, lambda c: (c != "") & is_value(c)))
            denser = (i >= 2) & (F.get(density, i) >= DENSE) & (F.get(density, i) > before + DENSER)
            return enough & ((values >= 2) | denser)

        last = F.least(F.lit(MOST_HEADERS), F.size(n) - 1)
        tried = F.when(last >= 1, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.expr("cast(array() as array<int>)"))
        return F.coalesce(F.get(F.filter(tried, data), F.lit(0)), F.lit(1))

    return let(inline(m), of)


def forward_filled(row: Column) -> Column:
    """Each empty cell takes the last text before it."""
    step = lambda s, c: F.array_append(s, F.when(c != "", c).otherwise(F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(""))))
    return F.aggregate(row, F.expr(STRINGS), step)


def labels(headers: Column) -> Column:
    """A label per column: the distinct texts of its header rows, all but the last filled forward."""

    def of(h: Column) -> Column:
        rows = F.transform(h, lambda r, i: F.when(i < F.size(h) - 1, forward_filled(r)).otherwise(r))
        parts = lambda j: F.array_distinct(F.filter(F.transform(rows, lambda r: F.get(r, j)), lambda p: p != ""))
        name = lambda j: F.coalesce(F.nullif(F.array_join(parts(j), " > "), F.lit("")), F.concat(F.lit("Column "), (j + 1).cast("string")))
        return F.transform(F.get(h, F.lit(0)), lambda _, j: name(j))

    return let(inline(headers), of)


def deduped(names: Column) -> Column:
    """The k-th repeat of a label gets its number."""

    def of(n: Column) -> Column:
        nth = lambda x, i: F.size(F.filter(F.slice(n, F.lit(1), i + 1), lambda y: y == x))
        return F.transform(n, lambda x, i: F.when(nth(x, i) > 1, F.concat_ws(" ", x, nth(x, i).cast("string"))).otherwise(x))

    return let(names, of)


def context_columns(rows: Column) -> Column:
    """Of the first columns those with text, up to the first (but the very first) in which values prevail."""

    def share(r: Column, j: Column) -> Column:
        texts = F.filter(F.transform(r, lambda row: F.coalesce(F.get(row, j), F.lit(""))), lambda c: c != "")
        return let(texts, lambda t: F.when(F.size(t) > 0, F.size(F.filter(t, is_value)) / F.size(t)))

    def of(r: Column) -> Column:
        most = F.least(width(r), F.lit(CONTEXT_COLUMNS))
        columns = F.when(most > 0, F.sequence(F.lit(0), F.greatest(most - 1, F.lit(0)))).otherwise(F.expr("cast(array() as array<int>)"))
        stop = F.coalesce(F.array_min(F.filter(columns, lambda j: (j > 0) & F.coalesce(share(r, j) > VALUE_SHARE, F.lit(False)))), F.lit(CONTEXT_COLUMNS))
        return F.filter(columns, lambda j: (j < stop) & share(r, j).isNotNull())

    return let(inline(rows), of)


def context_filled(rows: Column) -> Column:
    """Inline rows with any text; in context columns an empty cell takes the text above, if text follows in its row."""

    def of(r: Column, columns: Column) -> Column:
        state = F.struct(F.array_repeat(F.lit(""), F.greatest(width(r), F.lit(0))).alias("carried"), F.expr(ROWS).alias("made"))

        def step(s: Column, row: Column) -> Column:
            used = lambda j: F.array_contains(columns, j)
            follows = lambda j: F.exists(F.slice(row, j + 2, F.size(row)), lambda c: c != "")
            fill = F.transform(row, lambda c, j: F.when((c == "") & used(j) & follows(j), F.get(s["carried"], j)).otherwise(c))
            carry = F.transform(s["carried"], lambda c, j: F.when(used(j) & (F.coalesce(F.get(row, j), F.lit("")) != ""), F.get(row, j)).otherwise(c))
            return F.when(filled(row) == 0, s).otherwise(F.struct(carry.alias("carried"), F.array_append(s["made"], fill).alias("made")))

        return F.aggregate(r, state, step, lambda s: s["made"])

    return let(inline(rows), lambda r: let(context_columns(rows), lambda c: of(r, c)))


def records(m: Column) -> Column:
    """One line per body row, ``label: value`` for each cell with text; empty without any."""

    def of(m: Column, depth: Column) -> Column:
        names = deduped(labels(F.slice(m, F.lit(1), depth)))
        rows = context_filled(F.slice(m, depth + 1, F.size(m)))
        fields = lambda n, r: F.filter(F.zip_with(n, r, lambda a, b: F.when(b != "", F.concat(a, F.lit(": "), b))), lambda x: x.isNotNull())
        lines = let(names, lambda n: F.transform(F.filter(F.transform(rows, lambda r: fields(n, r)), lambda f: F.size(f) > 0), lambda f: F.concat(F.lit("- "), F.array_join(f, "; "))))
        return let(lines, lambda x: F.when(F.size(x) > 0, F.concat(F.lit("**Table records:**\n"), F.array_join(x, "\n"))).otherwise(F.lit("")))

    return let(m, lambda m: let(header_depth(m), lambda d: of(m, d)))


def grid(m: Column) -> Column:
    """A Markdown table; the first row is its header."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, table_cell), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(F.get(m, F.lit(0)), lambda _: F.lit("---")), " | "), F.lit(" |"))
    return F.concat_ws("\n", line(F.get(m, F.lit(0))), rule, F.transform(F.slice(m, F.lit(2), F.size(m)), line))


def as_records(m: Column) -> Column:
    """Whether a prepared matrix is too wide or too complex for a grid."""
    w = width(m)
    line = lambda r: F.aggregate(r, F.lit(0), lambda s, c: s + F.length(table_cell(c)) + 3) + 2
    return (w > WIDE) | ((header_depth(m) > 1) & (w >= COMPLEX)) | ((w >= LONG) & (F.array_max(F.transform(m, line)) > LONGEST_LINE))


def render(m: Column) -> Column:
    """The Markdown of a raw matrix; empty if it has no text.  A single row that is too wide vanishes."""
    of = lambda m: F.when(F.size(m) == 0, F.lit("")).when(as_records(m), records(m)).otherwise(grid(m))
    return let(prepared(F.coalesce(m, F.expr(ROWS))), of)


def placed(cells: Column) -> Column:
    """A row of cell texts from cells (row_no, col_no, span, text): in order of their places, with empty cells for gaps and
    spans; a place already passed is not moved back to."""
    ordered = F.array_sort(F.transform(cells, lambda c, i: F.struct(F.coalesce(c["row_no"], F.lit(1)).alias("r"), F.coalesce(c["col_no"], F.lit(1)).alias("c"), i.alias("i"), c.alias("cell"))))

    def step(row: Column, x: Column) -> Column:
        gap = F.greatest(F.lit(0), F.coalesce(x["cell"]["col_no"], F.lit(0)) - 1 - F.size(row))
        more = F.greatest(F.lit(0), F.coalesce(x["cell"]["span"], F.lit(1)) - 1)
        return F.concat(row, F.array_repeat(F.lit(""), gap), F.array(F.coalesce(x["cell"]["text"], F.lit(""))), F.array_repeat(F.lit(""), more))

    return F.aggregate(ordered, F.expr(STRINGS), step)
