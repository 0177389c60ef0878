"""Bulk-synchronous best-fit packing of token sequences.

Documents are range-sorted by length and gaps by size.  As both are integers up to the capacity, either sort
collapses into runs of equal values, and one sweep matches run against run: the longest documents not yet
placed go to the smallest gap that holds them (its successor), ranks within the runs say which document goes
to which gap, the gaps are updated, and the next sweep begins.  That fills the sequences as placing the documents
one by one, longest first, each into the smallest gap that holds it, does.  The sweeps need the number of documents of
each length only, at most ``capacity`` numbers however many documents there are, so they run on the driver;
ranking and placing the documents is distributed.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import Cache, WordBpe, tokenizer_path
from .common import staged
from .token_counts import texts


@dataclass(frozen=True)
class Packing:
    #: Path of the tokenizer's file, the same on driver and executors.
    path: str
    capacity: int = 2048
    #: The id that ends each document.
    end: int = 0
    cached: int = 400_000
    #: Pieces, about, that are ranked together.
    bucket: int = 4_000


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, how: Packing) -> DataFrame:
    """The pieces of each document's ids; only documents over the capacity are cut."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe(how.path)
        cache = Cache(bpe.packed, None, how.cached)
        end = int(how.end).to_bytes(4, "little")
        for batch in batches:
            made: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch), strict=True):
                ids = b"".join(map(cache.__getitem__, text.split())) + end
                for n, at in enumerate(range(0, len(ids), 4 * how.capacity)):
                    part = ids[at : at + 4 * how.capacity]
                    made.append((doc_id, n, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*made, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


def sweeps(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs of placements: length, first rank, first sequence, pieces in a sequence, offset of the first.

    Gaps are kept as runs too: for each size, ranges of sequences that have it.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}
    sizes: list[int] = []
    opened = 0
    placed = []

    def leave(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(sizes, gap)
            gaps[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(sizes, length)
            if at < len(sizes):
                gap = sizes[at]
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
                    sizes.pop(at)
            else:
                gap, first = capacity, opened
                n = -(-left // (capacity // length))
                opened += n
            each = gap // length
            full = min(n, left // each)
            take = full * each
            if take:
                placed.append((length, rank, first, each, capacity - gap))
                leave(gap - each * length, first, full)
            rest = left - take if full < n else 0
            if rest:
                placed.append((length, rank + take, first + full, rest, capacity - gap))
                leave(gap - rest * length, first + full, 1)
            leave(gap, first + full + bool(rest), n - full - bool(rest))
            rank, left = rank + take + rest, left - take - rest
    return placed


def ranked(cut: DataFrame, how: Packing) -> DataFrame:
    """``rank`` of each piece among those of its length, in two levels: one length may hold most pieces."""
    total = cut.count()
    buckets = max(1, -(-total // how.bucket))
    keyed = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    upto = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = keyed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    counts = counts.select("length", "bucket", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    return keyed.withColumn("inside", inside).join(counts, ["length", "bucket"]).withColumn("rank", F.col("base") + F.col("inside"))


def packed(docs: DataFrame, how: Packing) -> DataFrame:
    """One row per piece: its document, place in it, length, checksum, sequence and offset there.

    Defined results: null and empty texts are a piece of the end id alone; repeated rows are packed each, with
    pieces of their own; texts of any length are cut and packed whole; an empty table gives no rows; other
    columns are ignored.
    """
    cut = staged(pieces(docs, how), "pieces")
    # At most ``capacity`` rows.
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = np.array(sorted(sweeps(counts, how.capacity)), dtype=np.int64).reshape(-1, 5)
    shared = docs.sparkSession.sparkContext.broadcast(plan)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, rank, first, each, offset = shared.value.T
        keys = (length << 44) + rank
        for batch in batches:
            own, place = (batch.column(batch.schema.get_field_index(n)).to_numpy() for n in ("length", "rank"))
            at = np.searchsorted(keys, (own << 44) + place, side="right") - 1
            nth = place - rank[at]
            columns = [batch.column(n) for n in range(5)]
            columns += [pa.array(first[at] + nth // each[at]), pa.array(offset[at] + nth % each[at] * own)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    rows = ranked(cut, how).select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return rows.mapInArrow(place, f"{PIECES}, sequence_id long, offset long")


def word_packing() -> Packing:
    return Packing(tokenizer_path("word_bpe_49k.json"))
