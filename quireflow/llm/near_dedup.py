"""Near-duplicate documents by DartMinHash signatures and banded joining.

Signatures.  A document is a weighted set of shingles.  Over each shingle's region, as wide as its weight, a
hashed Poisson process throws darts, the same for every document: each dart has a rank and a coordinate of the
signature.  A document looks at ranks up to about (k ln k + 2k) / weight, where k coordinates are met with
high probability (else it looks twice as far), and keeps the earliest dart of each coordinate.  Two documents
agree in a coordinate with the probability of their weighted Jaccard similarity.  The work grows with the
number of shingles plus k log k, not with their product.

Joining.  Exact copies are one node.  Documents that agree in all rows of a band share a bucket.  In a bucket
the signatures estimate similarities.  One pair for each member that may reach the threshold is checked on the
texts, then one for each component that a bucket might still join to another, then whatever may still join two
components is.  No bucket's pairs are all emitted: they are compared and checked where the members meet, and
only links leave the task.  A large bucket is dealt out to several tasks, first at random, then by all pairs of its
parts, so that any two members of different components meet.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, fresh, release, remove_table, shared_dir, shuffle_partitions, staged
from .components import components
from .textvec import RUN, SOLID, blocks, distinct, mix, spans, words
from .token_counts import texts

_MIX = np.random.default_rng(8).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


@dataclass(frozen=True)
class NearDedup:
    shingle: int = 5
    threshold: float = 0.8
    bands: int = 32
    rows: int = 6
    #: A shingle weighs its occurrences; else every shingle weighs one.
    counted: bool = False
    #: Standard deviations below the threshold at which an estimate rules a pair out.
    margin: float = 3.7
    #: Members of a bucket that are compared in one task.
    dealt: int = 512

    @property
    def size(self) -> int:
        return self.bands * self.rows

    @property
    def least(self) -> float:
        return self.threshold - self.margin * (self.threshold * (1 - self.threshold) / self.size) ** 0.5


def shingles(rows: list[bytes], how: NearDedup) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each document in turn: its distinct shingles' hashes in order, their weights, where they begin.

    A text of fewer words than a shingle has one shingle of all its words; one without words has none.
    """
    w = words(rows, SOLID)
    n, k = np.diff(w.first), how.shingle
    behind = np.concatenate([w.hash, np.zeros(k, np.uint64)])
    parts = [np.zeros(0, np.uint64)]
    for a in range(0, len(w.hash), RUN):
        b = min(a + RUN, len(w.hash))
        here = np.diff(np.clip(w.first, a, b))
        left = np.repeat(w.first[1:], here) - np.arange(a, b)
        h = np.zeros(b - a, np.uint64)
        for j in range(k):
            h = h * _MIX[0] + np.where(left > j, behind[a + j : b + j], np.uint64(j + 1))
        parts.append(mix(h[(left >= k) | (left == np.repeat(n, here))]))
    made = np.concatenate(([0], np.cumsum(np.where(n > 0, np.maximum(1, n - k + 1), 0))))
    h, weight, first = distinct(np.concatenate(parts), made)
    return h, weight if how.counted else np.ones(len(h), np.int64), first


def uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(rows: list[bytes], how: NearDedup) -> tuple[np.ndarray, np.ndarray]:
    """The dart kept at each coordinate (a row for each document), and which documents have any shingle."""
    k = how.size
    h, weight, first = shingles(rows, how)
    docs = np.repeat(np.arange(len(rows)), np.diff(first))
    # A region of integer weight is that many strips of width one, each with a process of its own.
    ends = np.cumsum(weight)
    total = np.bincount(docs, weight, minlength=len(rows))
    some = total > 0
    kept = np.zeros((len(rows), k), np.uint64)
    reach = np.where(some, (k * np.log(k) + 2 * k) / np.maximum(total, 1), 0)
    pending = some.copy()
    while pending.any():
        found_doc, found_rank, found_dart = [], [], []
        for a in range(0, int(weight.sum()), RUN):
            b = min(a + RUN, int(ends[-1]))
            lo, hi = int(np.searchsorted(ends, a, side="right")), int(np.searchsorted(ends, b)) + 1
            begin = ends[lo:hi] - weight[lo:hi]
            of = np.repeat(np.arange(lo, hi), np.minimum(ends[lo:hi], b) - np.maximum(begin, a))
            strip = np.arange(a, b) - begin[of - lo]
            if not pending.all():
                use = pending[docs[of]]
                of, strip = of[use], strip[use]
            e, d = mix(h[of] + strip.astype(np.uint64) * _MIX[1]), docs[of]
            rank = np.zeros(len(e))
            m = 0
            while len(e):
                dart = mix(e + np.uint64((m + 1) * int(_MIX[2]) % 2**64))
                rank = rank - np.log(uniform(mix(dart ^ _MIX[3])))
                inside = rank <= reach[d]
                e, d, rank, dart = e[inside], d[inside], rank[inside], dart[inside]
                found_doc.append(d)
                found_rank.append(rank)
                found_dart.append(dart)
                m += 1
        doc, rank, dart = np.concatenate(found_doc), np.concatenate(found_rank), np.concatenate(found_dart)
        cell = doc * k + (dart % np.uint64(k)).astype(np.int64)
        best = np.full(len(rows) * k, np.inf)
        np.minimum.at(best, cell, rank)
        won = rank == best[cell]
        flat = np.zeros(len(rows) * k, np.uint64)
        flat[cell[won]] = dart[won]
        full = pending & np.isfinite(best.reshape(-1, k)).all(axis=1)
        kept[full] = flat.reshape(-1, k)[full]
        pending &= ~full
        reach = np.where(pending, 2 * reach, reach)
    return kept, some


SIGNED = "doc_id long, node binary, bands array<long>, sketch binary"


def signed(docs: DataFrame, how: NearDedup) -> DataFrame:
    """Every row's text digest (``node``), band keys and a byte of each coordinate (``sketch``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bands, sketch = [], []
            for _, part in blocks(texts(batch)):
                kept, some = signatures(part, how)
                keys = np.zeros((len(part), how.bands), np.uint64)
                for j in range(how.rows):
                    keys = keys * _MIX[4 + j] + kept[:, j :: how.rows]
                keys = mix(keys + np.arange(how.bands, dtype=np.uint64) * _MIX[3]).view(np.int64)
                bytes_ = (kept >> np.uint64(8)).astype(np.uint8)
                bands += [x.tolist() if s else [] for x, s in zip(keys, some, strict=True)]
                sketch += [x.tobytes() if s else b"" for x, s in zip(bytes_, some, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.binary())], ["doc_id", "node", "bands", "sketch"])

    return docs.select("doc_id", "text", node().alias("node")).mapInArrow(run, SIGNED)


def node():
    return F.unhex(F.md5(F.coalesce("text", F.lit(""))))


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Shares of equal coordinates of each pair of rows; a byte agrees by chance once in 256."""
    out = np.empty((len(a), len(b)))
    for i in range(0, len(a), 64):
        out[i : i + 64] = (a[i : i + 64, None, :] == b[None, :, :]).mean(axis=2)
    return (out - 1 / 256) / (1 - 1 / 256)


def sketches_of(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(table), -1)


EDGES = "u binary, v binary, rank double"


def first_edges(table: pa.Table, how: NearDedup) -> pa.Table:
    """For each member of a bucket the one that it is tied to, if any, and a rank: less is better.

    Members are in the order of their digests, the same in every bucket: a member is tied to the first one that
    it clearly resembles (rank 0), else to the most similar that may reach the threshold.
    """
    table = table.sort_by("node")
    names, sketch = table.column("node").to_pylist(), sketches_of(table)
    u, v, rank = [], [], []
    clear = how.threshold + 0.05
    for i in range(0, len(sketch) if len(sketch) > 1 else 0, 64):
        near = agreement(sketch[i : i + 64], sketch)
        for j, row in enumerate(near):
            at = i + j
            row[at] = -1
            first = int(np.argmax(row >= clear))
            sure = row[first] >= clear and first < at
            best = first if sure else int(np.argmax(row))
            if row[best] >= how.least:
                u.append(names[at])
                v.append(names[best])
                rank.append(0.0 if sure else 1.0 - row[best])
    return pa.table({"u": pa.array(u, pa.binary()), "v": pa.array(v, pa.binary()), "rank": pa.array(rank, pa.float64())})


def roots_of(part: np.ndarray):
    """Find the root of a class, and join the classes of two, over ``part``, each member's class number."""
    root = list(range(int(part.max(initial=-1)) + 1))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    def tie(i: int, j: int) -> None:
        root[top(i)] = top(j)

    return top, tie


def numbered(table: pa.Table) -> np.ndarray:
    _, part = np.unique(np.array([p.hex() for p in table.column("component").to_pylist()]), return_inverse=True)
    return part


def crossing(table: pa.Table, how: NearDedup) -> np.ndarray:
    """Pairs of members of different components that may reach the threshold, most similar first.

    Members of side 0 meet one another, those of side 1 meet those of side 2.
    """
    sketch, part = sketches_of(table), numbered(table)
    side = table.column("side").to_numpy()
    left, right = np.flatnonzero(side != 2), np.flatnonzero(side != 1)
    pairs, shares = [np.zeros((0, 2), np.int64)], [np.zeros(0)]
    for i in range(0, len(left), 64):
        own = left[i : i + 64]
        near = agreement(sketch[own], sketch[right])
        hit = (near >= how.least) & (part[own, None] != part[None, right]) & ((own[:, None] < right[None, :]) | (side[own, None] > 0))
        x, y = np.nonzero(hit)
        pairs.append(np.stack([own[x], right[y]], axis=1))
        shares.append(near[x, y])
    return np.concatenate(pairs)[np.argsort(-np.concatenate(shares), kind="stable")]


def spanning(table: pa.Table, how: NearDedup) -> pa.Table:
    """The most similar pairs of a block that would join its components: fewer than there are components."""
    table = table.sort_by("node")
    names, part = table.column("node").to_pylist(), numbered(table)
    top, tie = roots_of(part)
    u, v = [], []
    for x, y in crossing(table, how).tolist():
        if top(part[x]) != top(part[y]):
            tie(part[x], part[y])
            u.append(min(names[x], names[y]))
            v.append(max(names[x], names[y]))
    return pa.table({"u": pa.array(u, pa.binary()), "v": pa.array(v, pa.binary()), "rank": pa.array(np.zeros(len(u)))})


MEMBERS = "band long, x long, y long, node binary, component binary, side int, sketch binary"


def asked(table: pa.Table, how: NearDedup) -> pa.Table:
    """The members of a block that are in any pair of ``crossing``."""
    return table.select([c.split()[0] for c in MEMBERS.split(", ")]).take(pa.array(np.unique(crossing(table, how))))


def joining(table: pa.Table, how: NearDedup) -> pa.Table:
    """Links between different components: the pairs of a block that may be links, checked on their texts.

    Pairs that links found before have joined are left out.
    """
    names, part = table.column("node").to_pylist(), numbered(table)
    found, whole = crossing(table, how), texts(table)
    needed = np.unique(found)
    of: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for at, some in blocks([whole[i] for i in needed]):
        h, weight, first = shingles(some, how)
        of |= {int(needed[at + i]): (h[first[i] : first[i + 1]], weight[first[i] : first[i + 1]]) for i in range(len(some))}
    top, tie = roots_of(part)
    u, v = [], []
    for x, y in found.tolist():
        if top(part[x]) != top(part[y]) and similar(*of[x], *of[y], how):
            tie(part[x], part[y])
            u.append(min(names[x], names[y]))
            v.append(max(names[x], names[y]))
    return pa.table({"u": pa.array(u, pa.binary()), "v": pa.array(v, pa.binary())})


def dealt(buckets: DataFrame, salt: int, how: NearDedup) -> DataFrame:
    """Rows of ``buckets`` (band, node, n) dealt out by ``part``: one part for a usual bucket."""
    parts = F.ceil(F.col("n") / how.dealt)
    return buckets.withColumn("part", F.pmod(F.xxhash64("node", "band", F.lit(salt)), parts))


def once(open_: DataFrame, how: NearDedup) -> DataFrame:
    """Blocks (x, y) of rows with components: each row in one.  All pairs of a usual bucket meet."""
    return dealt(open_, 1, how).withColumns({"x": F.col("part"), "y": F.col("part"), "side": F.lit(0)}).drop("part")


def all_parts(open_: DataFrame, how: NearDedup) -> DataFrame:
    """Blocks (x, y) for every pair of a bucket's parts but those within its largest component.

    Parts are fixed; the largest component has parts of its own, which meet only those of the other members.
    """
    sizes = open_.groupBy("band", "component").agg(F.count("*").alias("m"))
    top = sizes.groupBy("band").agg(F.max(F.struct("m", "component")).alias("top"))
    rest, main = F.ceil((F.col("n") - F.col("top.m")) / how.dealt), F.ceil(F.col("top.m") / how.dealt)
    inside, h = F.col("component") == F.col("top.component"), F.xxhash64("node", "band")
    rows = open_.join(top, "band").withColumns({
        "own": F.when(inside, rest + F.pmod(h, main)).otherwise(F.pmod(h, rest)),
        "other": F.explode(F.sequence(F.lit(0).cast("long"), F.when(inside, rest).otherwise(rest + main) - 1)),
    })
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    return rows.select("band", "node", "component", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), side.alias("side"))


def texts_by_node(docs: DataFrame) -> tuple[DataFrame, str]:
    """node and text of every different text: a table bucketed by node in the shared folder, and its name.

    Texts are shuffled this once, copies combined before; whatever looks some of them up shuffles digests only.
    """
    spark = docs.sparkSession
    name = f"quireflow_texts_{uuid.uuid4().hex}"
    n = shuffle_partitions(spark)
    whole = docs.select(node().alias("node"), "text").groupBy("node").agg(F.first("text").alias("text"))
    whole.write.bucketBy(n, "node").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    release(spark)
    remove_table(spark, name)
    return spark.table(name), name


def similar(h: np.ndarray, weight: np.ndarray, other: np.ndarray, its: np.ndarray, how: NearDedup) -> bool:
    """Whether two texts' shingles (hashes and weights) reach the threshold."""
    _, m, n = np.intersect1d(h, other, assume_unique=True, return_indices=True)
    both = np.minimum(weight[m], its[n]).sum()
    total = weight.sum() + its.sum() - both
    return bool(total) and both >= how.threshold * total


def checked(pairs: DataFrame, store: DataFrame, how: NearDedup) -> DataFrame:
    """The pairs of texts (u, v) that are similar, by their shingles themselves."""
    needed = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct()
    whole = staged(store.join(needed, "node", "left_semi"), "texts")
    a, b = whole.select(F.col("node").alias("u"), F.col("text").alias("a")), whole.select(F.col("node").alias("v"), F.col("text").alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            left, right = texts(batch, "a"), texts(batch, "b")
            for at, end in spans([len(x) + len(y) + 2 for x, y in zip(left, right, strict=True)]):
                x, y = left[at:end], right[at:end]
                h, weight, first = shingles(x + y, how)
                for i in range(len(x)):
                    p, q = slice(first[i], first[i + 1]), slice(first[len(x) + i], first[len(x) + i + 1])
                    keep.append(similar(h[p], weight[p], h[q], weight[q], how))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(a, "u").join(b, "v").select("u", "v", "a", "b").mapInArrow(run, "u binary, v binary")


def moved(found: DataFrame, links: DataFrame) -> DataFrame:
    """``found`` (node, component) with the components that ``links`` join made one: only components are linked."""
    own = lambda name: found.select(F.col("node").alias(name), F.col("component").alias(f"{name}_of"))
    ends = links.join(own("u"), "u", "left").join(own("v"), "v", "left")
    roots = components(ends.select(F.coalesce("u_of", "u").alias("u"), F.coalesce("v_of", "v").alias("v")))
    into = roots.select(F.col("node").alias("component"), F.col("component").alias("into"))
    rows = found.join(into, "component", "left").select("node", F.coalesce("into", "component").alias("component"))
    return staged(rows.unionByName(roots), "components")


def open_members(buckets: DataFrame, found: DataFrame) -> DataFrame:
    """Members, with their components, of the buckets that hold several."""
    placed = buckets.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = placed.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("band")
    return staged(placed.join(mixed, "band"), "open")


def grouped(docs: DataFrame, how: NearDedup) -> tuple[DataFrame, DataFrame]:
    """doc_id and node of every row; of every node its class, its least id and whether it stands for its class.

    That is the node of the least id, null ids last, then of the least digest.

    Links are found in rounds; after each what they join is one component, and buckets within one component are
    done.  First every member is tied to one other at most, of all its buckets.  Then each bucket asks for
    the pairs that would join its components, one less than these at most.  What is still open after that is
    checked in full where members meet: of what one component holds no pair is left, after the first such
    round so in usual buckets, after the second in all.
    """
    spark = docs.sparkSession
    rows = staged(signed(docs, how), "signed")
    nodes = staged(rows.groupBy("node").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "nodes")
    banded = nodes.select(F.explode("bands").alias("band"), "node")
    several = staged(banded.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
    buckets = staged(banded.join(several, "band"), "members")
    release(spark)
    sketches = nodes.select("node", "sketch")
    store, table = texts_by_node(docs)
    edges = dealt(buckets, 0, how).join(sketches, "node").groupBy("band", "part").applyInArrow(lambda t: first_edges(t, how), EDGES)
    best = edges.groupBy("u").agg(F.min(F.struct("rank", "v")).alias("best")).select("u", F.col("best.v").alias("v"))
    pairs = staged(best.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "pairs")
    found = components(staged(checked(pairs, store, how), "links"))
    open_ = open_members(buckets, found)
    pairs = staged(once(open_, how).join(sketches, "node").groupBy("band", "x", "y").applyInArrow(lambda t: spanning(t, how), EDGES).select("u", "v").distinct(), "pairs")
    if not pairs.isEmpty():
        found = moved(found, staged(checked(pairs, store, how), "links"))
    for meet, some in ((once, buckets), (all_parts, buckets.filter(F.col("n") > how.dealt))):
        open_ = open_members(some, found)
        if open_.isEmpty():
            break
        left = staged(meet(open_, how).join(sketches, "node").groupBy("band", "x", "y").applyInArrow(lambda t: asked(t, how), MEMBERS), "asked")
        if not left.isEmpty():
            met = left.join(store, "node").groupBy("band", "x", "y").applyInArrow(lambda t: joining(t, how), "u binary, v binary")
            found = moved(found, staged(met.distinct(), "links"))
    placed = nodes.select("node", "id", "copies").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = placed.groupBy("component").agg(F.min("id").alias("class_id"), F.sum("copies").alias("class_size"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node")).alias("least"))
    named = placed.join(sizes, "component").select("node", "id", "class_id", "class_size", "copies", (F.col("node") == F.col("least.node")).alias("stands"))
    named = staged(named, "classes")
    release(spark)
    drop(spark, table)
    return rows.select("doc_id", "node"), named


def classes(docs: DataFrame, how: NearDedup = NearDedup()) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): class_id (the least id of its class), class_size, copies.

    A class is a connected component of texts linked by a similarity of the threshold or more; ``copies`` is
    the number of rows with the very same text.  Defined results: null and empty texts are one another's copies and near
    nothing else; texts of fewer words than a shingle are near their copies of words only; repeated rows are
    copies; texts of any length count whole; an empty table gives no rows; other columns are ignored.
    """
    rows, named = grouped(docs, how)
    return rows.join(named, "node").select("doc_id", "class_id", "class_size", "copies")


def one_of_each(docs: DataFrame, how: NearDedup = NearDedup()) -> DataFrame:
    """``docs`` with one document of each class: that with the least id; same columns.

    Of rows with the least id that with the least text digest stays, a null id only where the class has no other;
    of rows with the same id and text any one.
    """
    _, named = grouped(docs, how)
    own, best, kept = (fresh(docs.columns, n) for n in ("_node", "_best", "_kept"))
    stands = named.filter("stands").select(F.col("node").alias(best), F.col("id").alias(kept))
    out = docs.withColumn(own, node()).join(stands, (F.col(own) == F.col(best)) & F.col("doc_id").eqNullSafe(F.col(kept)), "left_semi")
    return out.dropDuplicates([own]).select(*docs.columns)
