"""Spatial page layouts: timelines and grids of figures, by range joins within a page.

``items``: doc_id, page_no, idx (reading order), text, type, x0, y0, x1, y1, font_size; y grows upward.
Pages are equi-keys of every join, so that the ranges are residual conditions of a hash or merge join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import UD, WS, U, matches, strip, table_cell

#: Distances in page units, and the least entries of a layout.
YEAR_ABOVE, YEAR_ASIDE, LABEL_ABOVE, LABEL_ASIDE, OVERHANG, LEAST = 145.0, 125.0, 95.0, 95.0, 20.0, 4
#: Running labels of pages, as whole texts; other collections bring their own.
RUNNING_LABELS = (rf"\d+{WS}+인하공업전문대학(?:{WS}+\d{{4}}[^\s\x1c-\x1f]*{WS}+모집요강{WS}+\d+)?", rf"\d{{4}}[^\s\x1c-\x1f]*{WS}+모집요강{WS}+\d+")
PAGE = ["doc_id", "page_no"]


def is_running_label(text: Column, labels: tuple[str, ...] = RUNNING_LABELS) -> Column:
    one_line = strip(F.regexp_replace(text, rf"{U}{WS}+", " "))
    found = F.lit(False)
    for label in labels:
        found = found | one_line.rlike(rf"(?Ud)\A(?:{label})\z")
    return found


def is_year(text: Column) -> Column:
    return matches(strip(text), r"(?:19|20)\d{2}")


def is_event(text: Column) -> Column:
    return text.rlike(rf"{UD}\A{WS}*[-•]{WS}*[^\s\x1c-\x1f]")


def is_label(i: DataFrame) -> Column:
    text = F.col("text")
    return F.col("type").isin("paragraph", "text") & F.length(text).between(1, 24) & ~is_year(text) & ~is_event(text) & ~text.rlike(rf"{UD}\d")


def is_figure(i: DataFrame) -> Column:
    return (F.col("type") == "heading") & (F.col("font_size") >= 14) & F.col("text").rlike(rf"{UD}\d")


def located(items: DataFrame) -> DataFrame:
    """Items that say something, with their centres."""
    kept = items.filter((F.col("text") != "") & ~is_running_label(F.col("text")))
    return kept.withColumns({"cx": (F.col("x0") + F.col("x1")) / 2, "cy": (F.col("y0") + F.col("y1")) / 2})


def same_column(a: str, b: str, aside: float) -> Column:
    """Centres or left edges near, or the left edge of either within the other and a margin."""
    c = lambda side, name: F.col(f"{side}.{name}")
    within = lambda x, y: c(y, "x0").between(c(x, "x0") - OVERHANG, c(x, "x1") + OVERHANG)
    return (F.abs(c(a, "cx") - c(b, "cx")) <= aside) | (F.abs(c(a, "x0") - c(b, "x0")) <= aside) | within(a, b) | within(b, a)


def same_page(a: str, b: str) -> Column:
    return (F.col(f"{a}.doc_id") == F.col(f"{b}.doc_id")) & (F.col(f"{a}.page_no") == F.col(f"{b}.page_no"))


def candidate_pages(items: DataFrame, *kinds: Column) -> DataFrame:
    """Pages with at least four items of each kind: the only ones worth a range join."""
    counts = items.groupBy(*PAGE).agg(*[F.count_if(k).alias(f"n{n}") for n, k in enumerate(kinds)])
    for n in range(len(kinds)):
        counts = counts.filter(F.col(f"n{n}") >= LEAST)
    return counts.select(*PAGE)


def timeline_pairs(items: DataFrame) -> DataFrame:
    """Each event's nearest year above it in its column: doc_id, page_no, idx, event, year; ties take the first year.

    Events without one are left out; a year may have many events.
    """
    i = located(items)
    i = i.join(candidate_pages(i, is_year(F.col("text")), is_event(F.col("text"))), PAGE, "left_semi")
    events, years = i.filter(is_event(F.col("text"))).alias("e"), i.filter(is_year(F.col("text"))).alias("y")
    above = F.col("y.cy") - F.col("e.cy")
    met = events.join(years, same_page("e", "y") & same_column("y", "e", YEAR_ASIDE) & (above >= 0) & (above < YEAR_ABOVE))
    cost = F.abs(above) + F.abs(F.col("y.x0") - F.col("e.x0")) / 2
    text = strip(F.regexp_replace(F.first("e.text"), rf"{U}\A{WS}*[-•]{WS}*", ""))
    best = F.min_by("y.text", F.struct(cost.alias("cost"), F.col("y.idx").alias("idx")))
    return met.groupBy("e.doc_id", "e.page_no", "e.idx").agg(text.alias("event"), best.alias("year"))


def leads(items: DataFrame, before: DataFrame) -> DataFrame:
    """The texts before ``first`` of each page of ``before``: the first, if short, as a heading."""
    rows = located(items).join(before, PAGE).filter(F.col("idx") < F.col("first"))
    listed = rows.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("idx", "text"))).alias("lead"))
    head = lambda x, i: F.when((i == 0) & (F.length(x["text"]) <= 60), F.concat(F.lit("## "), x["text"])).otherwise(x["text"])
    return listed.select(*PAGE, F.transform("lead", head).alias("lead"))


def with_leads(body: DataFrame, lead: DataFrame) -> DataFrame:
    """doc_id, page_no and markdown: leads, then the body's blocks."""
    none = F.expr("cast(array() as array<string>)")
    return body.join(lead, PAGE, "left").select(*PAGE, F.array_join(F.concat(F.coalesce("lead", none), "body"), "\n\n").alias("markdown"))


def timelines(items: DataFrame) -> DataFrame:
    """doc_id, page_no, markdown of the pages that are timelines: four years with events at least.

    Whatever on such a page is neither before the timeline nor part of it is left out.
    """
    pairs = timeline_pairs(items).filter("event <> ''")
    lists = pairs.groupBy(*PAGE, "year").agg(F.array_sort(F.collect_list(F.struct("idx", "event"))).alias("events"))
    lists = lists.withColumn("events", F.array_distinct(F.transform("events", lambda e: e["event"])))
    entry = F.struct(strip(F.col("year")).try_cast("int").alias("n"), F.array_min(F.transform("events", lambda e: e)).alias("_"), "year", "events")
    entries = lists.groupBy(*PAGE).agg(F.array_sort(F.collect_list(entry)).alias("entries")).filter(F.size("entries") >= LEAST)
    body = entries.select(*PAGE, F.transform("entries", lambda e: F.concat(F.lit("- "), e["year"], F.lit(": "), F.array_join(e["events"], "; "))).alias("body"))
    marks = located(items).filter(is_year(F.col("text")) | is_event(F.col("text"))).groupBy(*PAGE).agg(F.min("idx").alias("first"))
    return with_leads(body, leads(items, marks))


def metric_pairs(items: DataFrame) -> DataFrame:
    """Labels with the figures below them: doc_id, page_no, label_idx, value_idx, label, value, cx, cy.

    Labels choose in reading order, each the nearest figure that none before has taken: a fold over a page's
    labels, which the join has given their candidates in order of distance.
    """
    i = located(items)
    i = i.join(candidate_pages(i, is_label(i), is_figure(i)), PAGE, "left_semi")
    labels, figures = i.filter(is_label(i)).alias("l"), i.filter(is_figure(i)).alias("v")
    above = F.col("l.cy") - F.col("v.cy")
    met = labels.join(figures, same_page("l", "v") & same_column("l", "v", LABEL_ASIDE) & (above > 0) & (above < LABEL_ABOVE))
    cost = F.abs(above) + F.abs(F.col("l.cx") - F.col("v.cx")) / 2
    choice = F.struct(cost.alias("cost"), F.col("v.idx").alias("idx"), F.col("v.text").alias("value"))
    wanted = met.groupBy("l.doc_id", "l.page_no", "l.idx").agg(F.first("l.text").alias("label"), F.first("l.cx").alias("cx"), F.first("l.cy").alias("cy"), F.array_sort(F.collect_list(choice)).alias("choices"))
    pages = wanted.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("idx", "label", "cx", "cy", "choices"))).alias("labels"))
    pair = "struct<label_idx:int,value_idx:int,label:string,value:string,cx:double,cy:double>"
    state = F.struct(F.expr("cast(array() as array<int>)").alias("used"), F.expr(f"cast(array() as array<{pair}>)").alias("made"))

    def step(s: Column, x: Column) -> Column:
        free = F.get(F.filter(x["choices"], lambda c: ~F.array_contains(s["used"], c["idx"])), F.lit(0))
        made = F.struct(x["idx"].alias("label_idx"), free["idx"].alias("value_idx"), x["label"].alias("label"), free["value"].alias("value"), x["cx"].alias("cx"), x["cy"].alias("cy"))
        return F.when(free.isNull(), s).otherwise(F.struct(F.array_append(s["used"], free["idx"]).alias("used"), F.array_append(s["made"], made).alias("made")))

    greedy = pages.select(*PAGE, F.explode(F.aggregate("labels", state, step, lambda s: s["made"])).alias("p"))
    return greedy.select(*PAGE, "p.*")


def metric_grids(items: DataFrame) -> DataFrame:
    """doc_id, page_no, markdown of the pages that are grids of figures: four pairs at least, from top left."""
    pairs = metric_pairs(items)
    order = F.struct((-F.col("cy")).alias("down"), "cx", "label_idx", "label", "value")
    pages = pairs.groupBy(*PAGE).agg(F.array_sort(F.collect_list(order)).alias("rows"), F.min(F.least("label_idx", "value_idx")).alias("first")).filter(F.size("rows") >= LEAST)
    line = lambda r: F.concat(F.lit("| "), table_cell(r["label"]), F.lit(" | "), table_cell(r["value"]), F.lit(" |"))
    table = F.concat(F.lit("| 항목 | 내용 |\n| --- | --- |\n"), F.array_join(F.transform("rows", line), "\n"))
    return with_leads(pages.select(*PAGE, F.array(table).alias("body")), leads(items, pages.select(*PAGE, "first")))
