"""Mixing sources to target weights by a low-discrepancy schedule, native operators only.

Of N slots, slot t sits at the golden-ratio point t * g / N on a circle, g the number next to N by the golden
ratio that shares no factor with N: the points are evenly spread from the first few on, and each of the N places
is met once.  Cumulative numbers of slots map the point to a source.  Slots are ranked within their source and
joined to the source's blocks: its documents in shuffled order, laid end to end and cut into blocks of equal
size, smaller ones for a small source.  A source with more slots than blocks starts over.

Ranks and running sums are made in two levels (a count per bucket, then rows within a bucket), so that one
source with a third of all rows never meets in one task.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import gcd

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, fresh, staged

#: The fractional part of the golden ratio.
GOLDEN = 0.6180339887498949


@dataclass(frozen=True)
class Mix:
    #: Weights given in turn to the sources, ordered by code point, null last.
    weights: tuple[int, ...] = (1, 2, 3)
    #: A source is repeated this many times at most.
    max_repeats: int = 3
    #: Words in a block, more where the mix would have over ``most_slots``; a source has ``grain`` blocks at
    #: least, or as many as words.  The mix meets each target to half a block.
    block: int = 32
    grain: int = 1024
    most_slots: int = 1 << 30
    #: Hexadecimal digits of the shuffle key that make a bucket of the running sum.
    digits: int = 3
    #: Slots in a bucket of the ranking.
    run: int = 4096
    #: Cells of the grid on which points and shares are joined.
    cells: int = 1024


def targets(sized: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """One row per source: source_size, target, words in a block, blocks, slots, and the slots of sources before.

    Targets are min(max_repeats * size, level * weight), with the level at which they sum to all sizes: the
    fixed point of sharing the excess again.  In order of cap by weight, the first source below its cap has the
    highest level of all that are.  Slots are those of whole rounds over the source and the blocks next to the
    rest of its target.  Windows over all sources hold one row for each.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in mix.weights]), ((F.row_number().over(by_name) - 1) % len(mix.weights) + 1).cast("int")))
    per = per.withColumns({"cap": mix.max_repeats * F.col("source_size"), "ratio": mix.max_repeats * F.col("source_size") / F.col("weight")})
    order = Window.orderBy("ratio", F.col("source").isNull(), "source")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    per = per.withColumns({"everything": F.sum("source_size").over(everything), "before": F.coalesce(F.sum("cap").over(before), F.lit(0)), "open": F.sum("weight").over(after)})
    per = per.withColumn("level", (F.col("everything") - F.col("before")) / F.col("open"))
    per = per.withColumn("water", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything))
    per = per.withColumn("target", F.least(F.col("cap").cast("double"), F.col("water") * F.col("weight")))
    usual = F.greatest(F.lit(mix.block).cast("long"), F.expr(f"everything div {mix.most_slots}"))
    per = per.withColumn("block", F.greatest(F.lit(1).cast("long"), F.least(usual, F.expr(f"source_size div {mix.grain}"))))
    per = per.withColumns({"blocks": F.expr("(source_size + block - 1) div block"), "rounds": F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))})
    rest = F.floor((F.col("target") - F.col("rounds") * F.col("source_size")) / F.col("block") + 0.5)
    per = per.withColumn("slots", (F.col("rounds") * F.col("blocks") + F.least(F.col("blocks"), rest)).cast("long"))
    per = per.withColumn("first", F.sum("slots").over(by_name.rowsBetween(Window.unboundedPreceding, 0)) - F.col("slots"))
    return per.select("source", "source_size", "target", "block", "blocks", "slots", "first")


def step(n: int) -> int:
    """The number nearest above n by the golden ratio that shares no factor with n."""
    g = max(1, round(n * GOLDEN))
    while gcd(g, n) != 1:
        g += 1
    return g


def laid(sized: DataFrame, mix: Mix) -> DataFrame:
    """Each document's place, ``start``, in its source's shuffled sequence."""
    keyed = sized.withColumn("bucket", F.substring("key", 1, mix.digits))
    sums = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("sum"))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("b_source"), F.col("bucket").alias("b_bucket"), F.coalesce(F.sum("sum").over(upto), F.lit(0)).alias("base"))
    own = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    inside = keyed.withColumn("inside", F.coalesce(F.sum("size").over(own), F.lit(0)))
    placed = inside.join(sums, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("bucket") == F.col("b_bucket")))
    return placed.select("doc_id", "source", "size", (F.col("base") + F.col("inside")).alias("start"))


def schedule(goals: DataFrame, mix: Mix) -> DataFrame:
    """source, block and ``times``: how often the mix takes each block."""
    spark = goals.sparkSession
    n = int(goals.agg(F.sum("slots")).first()[0] or 0)
    # Beyond 2^31 slots the product needs more than 63 bits.
    kind = "long" if n < 1 << 31 else "decimal(19,0)"
    point = (F.col("id").cast(kind) * F.lit(step(n)).cast(kind) % F.lit(max(1, n)).cast(kind)).cast("long")
    width = max(1, -(-n // mix.cells))
    slots = spark.range(n).withColumn("point", point).withColumn("cell", F.expr(f"point div {width}"))
    grid = goals.filter("slots > 0").withColumn("cell", F.explode(F.expr(f"sequence(first div {width}, (first + slots - 1) div {width})")))
    grid = grid.select("source", "first", (F.col("first") + F.col("slots")).alias("behind"), "cell", "blocks")
    dealt = slots.join(F.broadcast(grid), "cell") if goals.count() <= 1000 else slots.join(grid, "cell")
    dealt = dealt.filter((F.col("point") >= F.col("first")) & (F.col("point") < F.col("behind")))
    dealt = dealt.select("id", "source", "blocks", F.expr(f"id div {mix.run}").alias("run"))
    counts = dealt.groupBy("source", "run").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("source").alias("c_source"), F.col("run").alias("c_run"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("base"))
    ranked = dealt.withColumn("inside", F.row_number().over(Window.partitionBy("source", "run").orderBy("id")) - 1)
    ranked = ranked.join(counts, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("run") == F.col("c_run")))
    return ranked.groupBy("source", ((F.col("base") + F.col("inside")) % F.col("blocks")).alias("block")).agg(F.count("*").alias("times"))


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words and the shuffle key, staged: everything below needs only these."""
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return staged(docs.select("doc_id", "source", words.alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("key")), "sizes")


def mixed(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """One row per row of ``docs`` (doc_id, source, text): size, its source's size and target, words taken.

    Defined results: null and empty texts have size 0 and are taken 0 times; a null source is a source, last
    in order; repeated rows are documents of their own; an empty table gives no rows; other columns are ignored.
    """
    sized = sizes(docs)
    goals = staged(targets(sized, mix), "targets")
    plan = schedule(goals, mix).select(F.col("source").alias("s_source"), F.col("block").alias("s_block"), "times")
    goals = goals.select(F.col("source").alias("g_source"), "source_size", "target", F.col("block").alias("wide"))
    if goals.count() <= 1000:
        goals = F.broadcast(goals)
    spans = laid(sized, mix).withColumn("end", F.col("start") + F.col("size")).join(goals, F.col("source").eqNullSafe(F.col("g_source")))
    pieces = spans.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.expr("sequence(start div wide, (end - 1) div wide)"))))
    overlap = F.least(F.col("end"), (F.col("block") + 1) * F.col("wide")) - F.greatest(F.col("start"), F.col("block") * F.col("wide"))
    pieces = pieces.select("doc_id", "source", "size", "start", "block", overlap.alias("overlap"))
    joined = pieces.join(plan, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("block") == F.col("s_block")), "left")
    taken = joined.groupBy("doc_id", "source", "size", "start").agg(F.coalesce(F.sum(F.col("overlap") * F.col("times")), F.lit(0)).cast("long").alias("taken"), F.count("*").alias("n"))
    # Rows of size 0 with equal ids share a place; each stands for itself again.
    taken = taken.withColumn("n", F.explode(F.when(F.col("size") > 0, F.array(F.lit(1))).otherwise(F.sequence(F.lit(1), F.col("n").cast("int")))))
    out = taken.join(goals, F.col("source").eqNullSafe(F.col("g_source")))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def repeated(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """``docs`` as the mix takes them, same columns: each row as many times as its words are taken, rounded.

    The blocks of a source are taken in its shuffled order, so that all documents but those at the end of a
    round are taken whole.  Rows of equal ids share their ids' words; texts without words are never taken.
    """
    names = docs.columns
    own, often, nth = (fresh(names, n) for n in ("_taken", "_times", "_nth"))
    times = mixed(docs, mix).groupBy(F.col("doc_id").alias(own)).agg(F.round(F.sum("taken") / F.greatest(F.lit(1), F.sum("size"))).cast("int").alias(often))
    joined = docs.join(times.filter(F.col(often) > 0), F.col("doc_id").eqNullSafe(F.col(own)))
    return joined.withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(often)))).select(*names)
