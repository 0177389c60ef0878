"""Resolution of not-modified revisits in web archives.

A revisit record stands for a response that the server answered with 304.  It is resolved to the latest
earlier full response of the same canonical URL whose validators it repeats; the response it stands for has
that response's payload and headers, updated by those headers of the 304 that may update a stored response.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Query parameters that don't tell pages apart.
TRACKING = r"\A(utm_[a-z]+|ref|fbclid|gclid|sessionid|sid)(=|\z)"
#: Headers that a 304 may update.
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "warning")
#: Seconds in a block of the as-of join.
BLOCK = 1 << 16


def canonical(url: Column) -> Column:
    """The URL without scheme, fragment, default port, leading www., tracking parameters, index page and
    trailing slashes; host in lower case, parameters in order.  Null stays null."""
    bare = F.regexp_replace(F.regexp_replace(url, r"#.*\z", ""), r"\A[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(bare, r"\A([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)\z", ""), r"\Awww\.", "")
    path = F.regexp_extract(bare, r"\A[^/?]*([^?]*)", 1)
    path = F.regexp_replace(F.regexp_replace(path, r"/index\.html?\z", ""), r"/+\z", "")
    query = F.regexp_extract(bare, r"\A[^?]*\?(.*)\z", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def strong(etag: Column) -> Column:
    """Validators are compared weakly."""
    return F.regexp_replace(etag, r"\AW/", "")


def merged(stored: Column, update: Column) -> Column:
    allowed = F.map_filter(F.coalesce(update, F.create_map().cast("map<string,string>")), lambda k, v: k.isin(*PERMITTED))
    rest = F.map_filter(stored, lambda k, v: ~F.coalesce(F.map_contains_key(allowed, k), F.lit(False)))
    return F.map_concat(rest, allowed)


def headers_text(headers: Column) -> Column:
    lines = F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return F.array_join(lines, "\n")


def latest_earlier(records: DataFrame, block: int = BLOCK) -> DataFrame:
    """``records`` with ``full``: the latest full response of its ``page`` strictly before ``ts``.

    In two levels, so that a page with very many captures is spread over tasks: the last response of each
    block of time is carried to later blocks, rows look inside their block first.
    """
    full = F.when(F.col("kind") == "response", F.struct("ts", "record_id", "etag", "last_modified", "digest", "headers", "length"))
    comparable = F.when(F.col("kind") == "response", F.struct("ts", "record_id"))
    rows = records.withColumns({"block": F.floor(F.col("ts") / block), "_full": full, "_order": comparable})
    ends = rows.groupBy("page", "block").agg(F.max_by("_full", "_order").alias("_last"))
    earlier = Window.partitionBy("page").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("page", "block", F.last("_last", ignorenulls=True).over(earlier).alias("_carried"))
    inside = Window.partitionBy("page", "block").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_inside", F.max_by("_full", "_order").over(inside))
    joined = rows.join(carried, ["page", "block"])
    return joined.withColumn("full", F.coalesce("_inside", "_carried")).drop("block", "_full", "_order", "_inside", "_carried")


def resolved(records: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per revisit of ``records`` (record_id, kind, url, ts, etag, last_modified, digest, headers, length).

    ``outcome`` is resolved; mismatch, where the latest earlier response has another validator (the etag, else
    the date of modification, else the digest, decides); unverified, where the two share no validator; or
    missing, without an earlier response.  Defined results: records without url or ts are missing; responses
    of the same time are not earlier, and of two at the latest time the greater id counts; repeated rows are
    resolved each; null headers count as none; an empty table gives no rows; other columns are ignored.
    """
    headers = F.coalesce("headers", F.create_map().cast("map<string,string>"))
    rows = records.select("record_id", "kind", canonical(F.col("url")).alias("page"), "ts", "etag", "last_modified", "digest", headers.alias("headers"), "length")
    lost = rows.filter((F.col("kind") == "revisit") & (F.col("page").isNull() | F.col("ts").isNull()))
    found = latest_earlier(rows.filter(F.col("page").isNotNull() & F.col("ts").isNotNull()), block).filter("kind = 'revisit'")
    found = found.unionByName(lost, allowMissingColumns=True)
    full = F.col("full")
    same = (
        F.when(F.col("etag").isNotNull() & full["etag"].isNotNull(), strong(F.col("etag")) == strong(full["etag"]))
        .when(F.col("last_modified").isNotNull() & full["last_modified"].isNotNull(), F.col("last_modified") == full["last_modified"])
        .when(F.col("digest").isNotNull() & full["digest"].isNotNull(), F.col("digest") == full["digest"])
    )
    outcome = F.when(full.isNull(), "missing").when(same.isNull(), "unverified").when(same, "resolved").otherwise("mismatch")
    done = found.withColumn("outcome", outcome)
    only = lambda c: F.when(F.col("outcome") == "resolved", c)
    return done.select(
        "record_id", "page", "ts", "outcome", only(full["record_id"]).alias("target_id"), only(full["ts"]).alias("target_ts"), only(full["digest"]).alias("payload_digest"),
        only(full["length"]).alias("payload_length"), only(headers_text(merged(full["headers"], F.col("headers")))).alias("headers"),
    )


def captures(pages: DataFrame) -> DataFrame:
    """Archive records made of a table of pages: each page's response, an hour later a revisit that repeats
    its validator (of every fourth page: another), and at a day's distance one by another form of the URL
    that knows only the date of modification."""
    tag = F.concat(F.lit('"'), F.md5("html"), F.lit('"'))
    hour = (F.col("page_id") * 60).cast("long")
    base = pages.select("page_id", "url", hour.alias("ts"), tag.alias("etag"), F.concat(F.lit("day "), (F.col("page_id") % 977).cast("string")).alias("modified"), F.md5("html").alias("digest"), F.octet_length("html").cast("long").alias("length"))
    pair = lambda **h: F.create_map(*[x for k, v in h.items() for x in (F.lit(k.replace("_", "-")), v)])
    text = lambda c: c.cast("string")
    response = base.select(
        (F.col("page_id") * 3).alias("record_id"), F.lit("response").alias("kind"), "url", "ts", "etag", F.col("modified").alias("last_modified"), "digest",
        pair(content_type=F.lit("text/html"), content_length=text(F.col("length")), etag=F.col("etag"), date=text(F.col("ts")), cache_control=F.lit("max-age=60")).alias("headers"), "length",
    )
    other = F.when(F.col("page_id") % 4 == 0, F.lit('"other"')).otherwise(F.concat(F.lit("W/"), F.col("etag")))
    null = F.lit(None).cast("string")
    revisit = base.select(
        (F.col("page_id") * 3 + 1).alias("record_id"), F.lit("revisit").alias("kind"), "url", (F.col("ts") + 3600).alias("ts"), other.alias("etag"), null.alias("last_modified"), null.alias("digest"),
        pair(etag=other, date=text(F.col("ts") + 3600), content_length=F.lit("0"), cache_control=F.lit("max-age=3600")).alias("headers"), F.lit(0).cast("long").alias("length"),
    )
    variant = F.concat(F.regexp_replace("url", r"\Ahttps?://(www\.)?", "HTTP://WWW."), F.when(F.contains("url", F.lit("?")), F.lit("&utm_source=again")).otherwise(F.lit("?utm_source=again")))
    again = base.select(
        (F.col("page_id") * 3 + 2).alias("record_id"), F.lit("revisit").alias("kind"), variant.alias("url"), (F.col("ts") + 86400).alias("ts"), null.alias("etag"), F.col("modified").alias("last_modified"), null.alias("digest"),
        pair(date=text(F.col("ts") + 86400), set_cookie=F.lit("no")).alias("headers"), F.lit(0).cast("long").alias("length"),
    )
    return response.unionByName(revisit).unionByName(again)
