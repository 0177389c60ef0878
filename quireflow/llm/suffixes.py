"""Removal of byte strings that also start in a document with a smaller id, exactly, at any size.

Suffixes are ordered only through the threshold (``depth`` bytes) by a radix sort, most significant digit
first; a group that a pass leaves with one document is finished and drops out, and the groups left at full
depth are the repeated strings.  All comparisons are of the bytes themselves; hashes only deal work out.

1. Dealing.  A suffix goes where the least ``gram`` inside its first ``depth`` bytes says (a minimizer: equal
   suffixes have the same), so that neighbours mostly go together, as one string of about 60 bytes for 14
   suffixes.  First only 32 bits of each minimizer are exchanged: suffixes whose minimizer no other document
   has are finished.
2. Sorting.  In its bucket, equal strings are one (whole and near copies end here), then the suffixes of the
   others are sorted by eight bytes at a time.  What comes back to a document are spans of its bytes.

Equal strings, and equal minimizers, of a task's documents are combined before every exchange, so a passage
that a third of all documents share costs one entry for each task.  A minimizer that stands in very many
different strings is dealt out further, suffix by suffix: equal suffixes still meet.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, remove_table, shared_dir, shuffle_partitions, staged
from .textvec import mix

_RANDOM = np.random.default_rng(50)
_VALUE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_LEVEL = _RANDOM.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
#: Bytes that are scanned together, and the most of one document that is.
BLOCK, SEGMENT = 1 << 18, 1 << 20
#: Minimizers, and strings, that a task gathers before it combines and sends them.
FLUSH, FLUSH_STRINGS = 2_000_000, 400_000
#: Suffixes in a string at most: only a text that repeats itself has as many under one minimizer.
LONGEST = 1024


@dataclass(frozen=True)
class Depth:
    depth: int = 50
    gram: int = 24
    #: Text, about, behind one bucket of an exchange.
    bucket_bytes: int = 256 << 20
    #: A minimizer in so many strings is dealt out by suffixes; the ``most_hot`` most frequent ones are
    #: broadcast, so that any other stands in one of ``most_hot`` strings at most.
    hot: int = 100_000
    most_hot: int = 65_536


def hashes(data: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the strings of ``length`` bytes at every place, by doubling; shorter by length - 1."""
    power, size = {1: _VALUE[data]}, 1
    while size * 2 <= length:
        h = power[size]
        power[2 * size] = h[: max(0, len(h) - size)] * _LEVEL[size.bit_length()] + h[size:]
        size *= 2
    n = max(0, len(data) - length + 1)
    total, at = np.zeros(n, np.uint64), 0
    for size in sorted(power, reverse=True):
        if length & size:
            total = total * _LEVEL[32 + size.bit_length()] + power[size][at : at + n]
            at += size
    return mix(total)


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        h = np.minimum(h[:-size] if size < len(h) else h[:0], h[size:])
        size *= 2
    rest = width - size
    return np.minimum(h[: len(h) - rest], h[rest:]) if rest else h


def segments(rows: list[bytes], how: Depth) -> Iterator[list[tuple[int, int, bytes]]]:
    """Blocks of (row, offset, bytes): every suffix of the full depth is in exactly one segment."""
    block, size = [], 0
    for n, text in enumerate(rows):
        for at in range(0, max(1, len(text) - how.depth + 1), SEGMENT):
            part = text[at : at + SEGMENT + how.depth - 1]
            if len(part) < how.depth:
                continue
            if size and size + len(part) > BLOCK:
                yield block
                block, size = [], 0
            block.append((n, at, part))
            size += len(part)
    if block:
        yield block


class Scan:
    """The strings of a block: runs of neighbouring suffixes with the same minimizer.

    Of each string: its first and last suffix's places in ``bytes`` (``start``, ``stop`` behind the last), the
    minimizer's hash, its row, and the place of its first suffix there.
    """

    def __init__(self, block: list[tuple[int, int, bytes]], how: Depth) -> None:
        self.bytes = b"".join(b for _, _, b in block)
        data = np.frombuffer(self.bytes, np.uint8)
        size = np.array([len(b) for _, _, b in block])
        end = np.cumsum(size)
        least = sliding_min(hashes(data, how.gram), how.depth - how.gram + 1)
        new = np.ones(len(least) + 1, bool)
        new[1:-1] = least[1:] != least[:-1]
        # No string goes on from one segment to the next.
        last = end - how.depth + 1
        new[end[:-1]] = new[last[:-1]] = True
        start = np.flatnonzero(new)
        start, stop = start[:-1], start[1:]
        segment = np.searchsorted(end, start, side="right")
        inside = start < last[segment]
        start, stop, segment = start[inside], stop[inside], segment[inside]
        if len(start) and (stop - start).max() > LONGEST:
            parts = -(-(stop - start) // LONGEST)
            nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            start, stop, segment = np.repeat(start, parts) + nth * LONGEST, np.repeat(stop, parts), np.repeat(segment, parts)
            stop = np.minimum(stop, start + LONGEST)
        self.start, self.stop = start, stop
        self.digit = mix(least[start])
        self.row = np.array([r for r, _, _ in block])[segment]
        self.place = start - (end - size)[segment] + np.array([o for _, o, _ in block])[segment]


def packed_keys(key: np.ndarray) -> bytes:
    """Keys in order: the first, then the steps in few bytes each, and apart those that don't fit."""
    step = np.diff(key, prepend=key[:1]).view(np.uint64)
    over = {w: int((step >= np.uint64(256**w)).sum()) if w < 8 else 0 for w in (1, 2, 4, 8)}
    width = min(over, key=lambda w: w * len(step) + 12 * over[w])
    large = np.flatnonzero(step >= np.uint64(256**width)) if width < 8 else np.zeros(0, np.int64)
    head = key[:1].tobytes() + bytes([width]) + len(large).to_bytes(4, "little")
    return head + large.astype("<u4").tobytes() + step[large].tobytes() + step.astype(f"<u{width}").tobytes()


def unpacked_keys(blob: bytes) -> np.ndarray:
    if len(blob) < 13:
        return np.zeros(0, np.int64)
    width, n = blob[8], int.from_bytes(blob[9:13], "little")
    steps = np.frombuffer(blob, f"<u{width}", offset=13 + 12 * n).astype(np.uint64)
    steps[np.frombuffer(blob, "<u4", n, 13)] = np.frombuffer(blob, np.uint64, n, 13 + 4 * n)
    return (np.cumsum(steps, dtype=np.uint64) + np.frombuffer(blob, np.uint64, 1)).view(np.int64)


def grouped(value: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The order of values, where groups of equal ones begin in it, and each group's least and greatest key."""
    order = np.argsort(value)
    value, key = value[order], key[order]
    if not len(value):
        return order, np.zeros(0, np.int64), key, key
    start = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1])))
    return order, start, np.minimum.reduceat(key, start), np.maximum.reduceat(key, start)


DIGITS = "bucket int, value binary, row binary, times binary, found_value binary, found_row binary"


def sent_digits(value: np.ndarray, row: np.ndarray, buckets: int) -> pa.RecordBatch:
    """A task's minimizers, combined: one row of each goes to its bucket, and how often it stood there (the
    logarithm); rows that share one in the task are thereby found, and go along to any bucket.

    Only 32 bits are sent: the bucket tells some more, and a false match costs time only.
    """
    order, start, least, most = grouped(value, row)
    value, row = value[order], row[order]
    size = np.diff(np.append(start, len(value)))
    found = np.repeat(least != most, size)
    fv, fr = value[found].astype(np.uint32), row[found]
    value = value[start]
    times = np.ceil(np.log2(size)).astype(np.uint8)
    cuts = np.searchsorted(value, (np.arange(buckets + 1, dtype=object) * 2**64 // buckets).clip(0, 2**64 - 1).astype(np.uint64))
    cuts[-1] = len(value)
    also = len(fv) * np.arange(buckets + 1) // buckets
    rows = []
    for b in range(buckets):
        i, j, x, y = cuts[b], cuts[b + 1], also[b], also[b + 1]
        if j > i or y > x:
            o, more = np.argsort(least[i:j], kind="stable"), np.argsort(fr[x:y], kind="stable")
            rows.append((b, value[i:j].astype(np.uint32)[o].tobytes(), packed_keys(least[i:j][o]), times[i:j][o].tobytes(), fv[x:y][more].tobytes(), packed_keys(fr[x:y][more])))
    return batch_of(rows, DIGITS)


def batch_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names = [c.split()[0] for c in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names)


def column(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)


def row_column(table: pa.Table, name: str) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *map(unpacked_keys, table.column(name).to_pylist())])


def squeezed(data: bytes) -> bytes:
    """Compressed, behind its length."""
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def squeezed_column(table: pa.Table, name: str) -> bytes:
    return b"".join(pa.decompress(x[8:], int.from_bytes(x[:8], "little"), codec="zstd", asbytes=True) for x in table.column(name).to_pylist())


FOUND = "row long, value long, times long"


def met_digits(table: pa.Table, how: Depth) -> pa.Table:
    """(row, value) of every minimizer that several rows have; without a row, those that are very frequent."""
    value, row, times = column(table, "value", np.uint32), row_column(table, "row"), column(table, "times", np.uint8)
    order, start, least, most = grouped(value, row)
    value, row, times = value[order], row[order], 2.0 ** times[order]
    size = np.diff(np.append(start, len(value)))
    keep = np.repeat(least != most, size)
    n = np.add.reduceat(times, start) if len(start) else times
    hot = n >= how.hot
    rows = np.concatenate([row[keep], row_column(table, "found_row")])
    values = np.concatenate([value[keep], column(table, "found_value", np.uint32), value[start][hot]]).astype(np.int64)
    none = int(hot.sum())
    return pa.table({
        "row": pa.array(np.append(rows, np.zeros(none, np.int64)), mask=np.arange(len(values)) >= len(rows)), "value": pa.array(values),
        "times": pa.array(np.append(np.zeros(len(rows), np.int64), n[hot].astype(np.int64))),
    })


STRINGS = "bucket int, text binary, size binary, entries binary, key binary, row binary, place binary, found_row binary, found_value binary"


class Strings:
    """A task's strings, combined: of equal ones those of the least document go to the bucket."""

    def __init__(self, buckets: int, how: Depth) -> None:
        self.buckets, self.how = buckets, how
        self.clear()

    def clear(self) -> None:
        self.ids: dict[bytes, int] = {}
        self.bucket: list[int] = []
        self.of: list[int] = []
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, scan: Scan, take: np.ndarray, hot: np.ndarray, key: np.ndarray, row: np.ndarray) -> None:
        data, depth, ids, of, bucket = scan.bytes, self.how.depth, self.ids, self.of, self.bucket
        start, stop, place, owner = scan.start[take], scan.stop[take], scan.place[take], scan.row[take]
        to = (scan.digit[take] % np.uint64(self.buckets)).astype(np.int64)
        if hot.any():
            n = np.where(hot, stop - start, 1)
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            to, place, owner = np.where(np.repeat(hot, n), -1, np.repeat(to, n)), np.repeat(place, n) + nth, np.repeat(owner, n)
            stop = np.where(np.repeat(hot, n), np.repeat(start, n) + nth + 1, np.repeat(stop, n))
            start = np.repeat(start, n) + nth
        for a, b, t in zip(start.tolist(), (stop + depth - 1).tolist(), to.tolist(), strict=True):
            s = data[a:b]
            n = ids.setdefault(s, len(ids))
            if n == len(bucket):
                bucket.append(t if t >= 0 else zlib.crc32(s) % self.buckets)
            of.append(n)
        self.parts.append((key[owner], row[owner], place))

    def __len__(self) -> int:
        return len(self.of)

    def sent(self) -> pa.RecordBatch:
        texts, of, bucket = list(self.ids), np.array(self.of, np.int64), np.array(self.bucket, np.int64)
        key, row, place = (np.concatenate(p) for p in zip(*self.parts, strict=True))
        size = np.array([len(t) for t in texts], np.int64)
        least = np.full(len(texts), np.iinfo(np.int64).max)
        np.minimum.at(least, of, key)
        found = key > least[of]
        found_row, found_value = merged(row[found], place[found], size[of[found]])
        of, key, row, place = (x[~found] for x in (of, key, row, place))
        order = np.lexsort((of, bucket[of]))
        of, key, row, place = (x[order] for x in (of, key, row, place))
        first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
        entries, of = np.diff(np.append(first, len(of))).astype(np.uint32), of[first]
        edge = np.searchsorted(bucket[of], np.arange(self.buckets + 1))
        first = np.append(first, len(key))
        also = len(found_row) * np.arange(self.buckets + 1) // self.buckets
        rows = []
        for b in range(self.buckets):
            i, j, x, y = edge[b], edge[b + 1], also[b], also[b + 1]
            if j > i or y > x:
                e = slice(first[i], first[j])
                rows.append((
                    b, squeezed(b"".join([texts[n] for n in of[i:j].tolist()])), size[of[i:j]].astype(np.uint32).tobytes(), entries[i:j].tobytes(), squeezed(key[e].tobytes()), squeezed(row[e].tobytes()),
                    place[e].astype(np.uint32).tobytes(), found_row[x:y].tobytes(), found_value[x:y].tobytes(),
                ))
        self.clear()
        return batch_of(rows, STRINGS)


def merged(row: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and spans (start and length in one number) of the unions of spans that touch in a row."""
    if not len(row):
        return row, start
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], (start + length)[order]
    # Ends so far, as one increasing sequence over all rows.
    fresh = np.concatenate(([True], row[1:] != row[:-1]))
    nth = np.cumsum(fresh) - 1
    wide = int(end.max()) + 1
    reach = np.maximum.accumulate(end + nth * wide) - nth * wide
    fresh[1:] |= start[1:] > reach[:-1]
    at = np.flatnonzero(fresh)
    stop = reach[np.append(at[1:], len(row)) - 1]
    return row[at], (start[at] << 32) | (stop - start[at])


def ranks(x: np.ndarray) -> np.ndarray:
    order = np.argsort(x)
    out = np.empty(len(x), np.int64)
    out[order] = np.concatenate(([0], np.cumsum(x[order][1:] != x[order][:-1])))
    return out


def least_of_equal(data: bytes, at: np.ndarray, key: np.ndarray, depth: int) -> np.ndarray:
    """Of each suffix at ``at`` the least key among those that have the same first ``depth`` bytes.

    Passes over digits of eight bytes, most significant first; a group whose suffixes all have one key is
    finished.  The last digit may begin inside the one before, which is equal in the whole group by then.
    """
    least = key.copy()
    words = np.ndarray(max(0, len(data) - 7), ">u8", data, 0, (1,))
    open_, group = np.arange(len(at)), np.zeros(len(at), np.int64)
    width = min(8, depth)
    for digit in range(0, depth, width):
        if not len(open_):
            break
        value = words[at[open_] + min(digit, depth - width)].astype(np.uint64) >> np.uint64(64 - 8 * width)
        if digit:
            value = ranks(value)
            value += group * (int(value.max()) + 1)
        order = np.argsort(value)
        open_, value = open_[order], value[order]
        start = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1])))
        lo, hi = np.minimum.reduceat(key[open_], start), np.maximum.reduceat(key[open_], start)
        size = np.diff(np.append(start, len(open_)))
        several = np.repeat(lo != hi, size)
        group, lo, open_ = np.repeat(np.arange(len(start)), size)[several], np.repeat(lo, size)[several], open_[several]
        if digit + width >= depth:
            least[open_] = lo
    return least


def met_strings(table: pa.Table, how: Depth) -> pa.Table:
    """(row, span) of the bytes that a bucket's strings share with a document of smaller key."""
    data, size, entries = squeezed_column(table, "text"), column(table, "size", np.uint32).astype(np.int64), column(table, "entries", np.uint32)
    key, row, place = np.frombuffer(squeezed_column(table, "key"), np.int64), np.frombuffer(squeezed_column(table, "row"), np.int64), column(table, "place", np.uint32).astype(np.int64)
    ends = np.cumsum(size)
    ids: dict[bytes, int] = {}
    of = np.array([ids.setdefault(data[e - s : e], len(ids)) for e, s in zip(ends.tolist(), size.tolist(), strict=True)], np.int64)
    of = np.repeat(of, entries)
    least = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(least, of, key)
    size = np.array([len(s) for s in ids], np.int64)
    data = b"".join(ids) + bytes(8)
    # Every suffix of the different strings.
    n = size - how.depth + 1
    owner = np.repeat(np.arange(len(n)), n)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    lost = least_of_equal(data, (np.cumsum(size) - size)[owner] + nth, least[owner], how.depth) < least[owner]
    begins = lost & np.concatenate(([True], ~lost[:-1] | (owner[1:] != owner[:-1])))[: len(lost)]
    finish = lost & np.concatenate((~lost[1:] | (owner[1:] != owner[:-1]), [True]))[: len(lost)]
    of_run, from_, long = owner[begins], nth[begins], nth[finish] - nth[begins] + how.depth
    # Runs of the strings' own documents, whole strings of all others.
    own = np.flatnonzero(key == least[of])
    first, last = np.searchsorted(of_run, of[own]), np.searchsorted(of_run, of[own], side="right")
    times = last - first
    run = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times - first, times)
    at, other = np.repeat(own, times), key != least[of]
    rows, values = merged(np.concatenate([row[at], row[other]]), np.concatenate([place[at] + from_[run], place[other]]), np.concatenate([long[run], size[of[other]]]))
    rows, values = np.concatenate([rows, column(table, "found_row", np.int64)]), np.concatenate([values, column(table, "found_value", np.int64)])
    return pa.table({"row": pa.array(rows), "value": pa.array(values), "times": pa.array(np.zeros(len(rows), np.int64))})


def laid_out(docs: DataFrame) -> tuple[DataFrame, str]:
    """A table of the documents, bucketed by ``row`` (a number of its own for each) in the shared folder: each
    pass reads it with its own findings, and only those are shuffled.

    Columns are named by their places, c0 and so on, whatever the caller's names; besides there are row, key
    (the id; a null id is smaller than any other) and size in bytes.
    """
    spark, names = docs.sparkSession, docs.columns
    table = f"quireflow_suffixes_{uuid.uuid4().hex}"
    n = shuffle_partitions(spark)
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
    keyed = inner.withColumns({
        "key": F.coalesce(F.col(f"c{names.index('doc_id')}").cast("long"), F.lit(-(2**63))), "row": F.monotonically_increasing_id(),
        "size": F.coalesce(F.octet_length(f"c{names.index('text')}"), F.lit(0)).cast("long"),
    })
    keyed.repartition(n, "row").write.bucketBy(n, "row").option("path", f"{shared_dir(spark)}/{table}").saveAsTable(table)
    release(spark)
    remove_table(spark, table)
    return spark.table(table), f"c{names.index('text')}"


def at(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def raw(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    return [x or b"" for x in at(batch, name).cast(pa.binary()).to_pylist()]


def lists(batch: pa.RecordBatch, name: str) -> list[np.ndarray]:
    """The arrays of a column of numbers; a null is empty."""
    found = at(batch, name)
    values, offset = found.values.to_numpy(zero_copy_only=False), found.offsets.to_numpy()
    null = found.is_null().to_numpy(zero_copy_only=False)
    return [values[i:j] if not gone else values[:0] for i, j, gone in zip(offset[:-1], offset[1:], null, strict=True)]


def repeated(docs: DataFrame, how: Depth = Depth()) -> tuple[DataFrame, str]:
    """``laid_out`` with ``spans``, by document the array of the spans to remove, and the text column's name."""
    docs, text = laid_out(docs)
    spark = docs.sparkSession
    buckets = max(4 * shuffle_partitions(spark), int(docs.agg(F.sum("size")).first()[0] or 0) // how.bucket_bytes)
    whole = docs.select("row", "key", F.col(text).alias("text"))

    def digits_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, owners, n = [], [], 0
        for batch in batches:
            row = at(batch, "row").to_numpy()
            for block in segments(raw(batch), how):
                scan = Scan(block, how)
                values.append(scan.digit)
                owners.append(row[scan.row])
                n += len(scan.digit)
                if n >= FLUSH:
                    yield sent_digits(np.concatenate(values), np.concatenate(owners), buckets)
                    values, owners, n = [], [], 0
        if n:
            yield sent_digits(np.concatenate(values), np.concatenate(owners), buckets)

    met = whole.select("row", "text").mapInArrow(digits_of, DIGITS).groupBy("bucket").applyInArrow(lambda t: met_digits(t, how), FOUND)
    met = staged(met, "digits")
    release(spark)
    shared = spark.sparkContext.broadcast(np.array(sorted(r.value for r in met.filter("row is null").orderBy(F.desc("times"), "value").limit(how.most_hot).collect()), np.int64))
    digits = met.filter("row is not null").groupBy("row").agg(F.collect_set("value").alias("digits"))

    def strings_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, hot = Strings(buckets, how), shared.value
        for batch in batches:
            row, key, wanted = at(batch, "row").to_numpy(), at(batch, "key").to_numpy(), lists(batch, "digits")
            known = np.sort(np.concatenate([np.zeros(0, np.int64), *[(n << 32) | w for n, w in enumerate(wanted)]]))
            for block in segments(raw(batch), how):
                scan = Scan(block, how)
                digit = (scan.digit & np.uint64(0xFFFFFFFF)).astype(np.int64)
                asked = (scan.row << 32) | digit
                take = np.flatnonzero(known[np.minimum(np.searchsorted(known, asked), len(known) - 1)] == asked)
                made.add(scan, take, np.isin(digit[take], hot), key, row)
                if len(made) >= FLUSH_STRINGS:
                    yield made.sent()
        if len(made):
            yield made.sent()

    found = whole.join(digits, "row").mapInArrow(strings_of, STRINGS).groupBy("bucket").applyInArrow(lambda t: met_strings(t, how), FOUND)
    spans = staged(found.groupBy("row").agg(F.collect_list("value").alias("spans")), "spans")
    release(spark)
    return docs.join(spans, "row", "left"), text


def unions(spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the maximal runs of bytes that ``spans`` cover, in order."""
    _, values = merged(np.zeros(len(spans), np.int64), spans >> 32, spans & 0xFFFFFFFF)
    return values >> 32, (values >> 32) + (values & 0xFFFFFFFF)


def kept_of(text: bytes, begin: np.ndarray, end: np.ndarray) -> bytes:
    return b"".join([text[i:j] for i, j in zip([0, *end.tolist()], [*begin.tolist(), len(text)], strict=True)])


def digests(docs: DataFrame, how: Depth = Depth()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of ``docs`` (doc_id, text).

    Defined results: null and empty texts have 0 bytes; texts shorter than the depth lose nothing; rows of
    equal id are no smaller than each other, so that they lose nothing to each other; a null id is smaller
    than any other; texts of any length are treated whole; an empty table gives no rows; other columns are ignored.
    """

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(raw(batch), lists(batch, "spans"), strict=True):
                begin, end = unions(spans)
                out.append((len(text), int((end - begin).sum()), len(begin), hashlib.sha256(kept_of(text, begin, end)).hexdigest()))
            columns = list(zip(*out, strict=True)) or [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([at(batch, "doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    found, text = repeated(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), how)
    found = found.select(F.col("c0").alias("doc_id"), F.col(text).alias("text"), "spans")
    return found.mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, how: Depth = Depth()) -> DataFrame:
    """``docs`` with the repeated strings cut out of ``text``, same columns; rows left without any text go.

    A cut inside a character takes the whole character.  Null texts stay null.
    """
    names = docs.columns
    place = names.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = at(batch, f"c{place}").to_pylist()
            gone = np.zeros(len(kept), bool)
            for n, (text, spans) in enumerate(zip(raw(batch, f"c{place}"), lists(batch, "spans"), strict=True)):
                if len(spans):
                    kept[n] = kept_of(text, *unions(spans)).decode("utf-8", "ignore")
                    gone[n] = not kept[n].strip()
            columns = [pa.array(kept, pa.string()) if k == place else batch.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(~gone))

    found, _ = repeated(docs, how)
    return found.select(*[f"c{i}" for i in range(len(names))], "spans").mapInArrow(cut, docs.schema)
