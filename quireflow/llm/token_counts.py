"""Token counts by a map-side two-tier lookup; no pre-token is shuffled.

Texts are cut before single spaces, where no pre-token of the byte-level pattern is ever cut.  The lengths of
frequent pieces come from a broadcast table of bounded size; any other piece is encoded once per worker and
kept in its cache.  Where a space touches other white space the pattern looks across it: there no cut is made.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import KEPT, ByteBpe, Cache, tokenizer_path

TOUCHING = re.compile(r"\s | \s|\s\Z|\A\s")
#: A single space between other characters than white space.
BETWEEN = re.compile(r"(?<=\S) (?=\S)")


@dataclass(frozen=True)
class Counting:
    #: Path of the tokenizer's file, the same on driver and executors.
    path: str
    limit: int = 1024
    #: Frequent pieces in the broadcast table; its size is some 100 bytes for each.
    frequent: int = 32_768
    #: One document in so many is looked at for them; the choice changes the speed, never a count.
    every: int = 64
    #: Frequent pieces that one task puts forward.
    per_task: int = 8_192
    #: Entries of a worker's cache.
    cached: int = 400_000


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    return [x or b"" for x in batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()]


def frequent(docs: DataFrame, how: Counting) -> list[bytes]:
    """The pieces that stand first by their counts in one document of ``every``; ``frequent`` at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for batch in batches:
            for text in texts(batch):
                seen.update(p for p in text.split(b" ")[1:] if len(p) <= KEPT)
            if len(seen) > 20 * how.per_task:
                seen = Counter(dict(seen.most_common(10 * how.per_task)))
        best = [x for x in seen.most_common(how.per_task) if x[0]]
        yield pa.RecordBatch.from_pydict({"piece": pa.array([x[0] for x in best], pa.binary()), "n": pa.array([x[1] for x in best], pa.int64())})

    some = docs.filter(F.xxhash64("doc_id") % how.every == 0).select("text")
    rows = some.mapInArrow(count, "piece binary, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    return [bytes(r.piece) for r in rows.orderBy(F.desc("n"), "piece").limit(how.frequent).collect()]


class TextCounter:
    """Counts the tokens of texts in a worker.  What is no UTF-8 counts as its replacement characters."""

    def __init__(self, path: str, table: dict[bytes, int], limit: int) -> None:
        self.bpe = ByteBpe(path)
        self.later = Cache(lambda p: self.bpe.count(" " + p.decode()), table, limit)
        self.first = Cache(lambda p: self.bpe.count(p.decode()), None, limit)

    def __call__(self, text: bytes) -> int:
        if not text:
            return 0
        try:
            whole = text.decode()
        except UnicodeDecodeError:
            whole = text.decode("utf-8", "replace")
            text = whole.encode()
        head, *rest = [p.encode() for p in BETWEEN.split(whole)] if TOUCHING.search(whole) else text.split(b" ")
        return self.first[head] + sum(map(self.later.__getitem__, rest))


def token_counts(docs: DataFrame, how: Counting) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row of ``docs`` (doc_id, text).

    Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows are counted each; texts of
    any length are counted whole; bytes that are no UTF-8 count as replacement characters; an empty table gives
    no rows; other columns are ignored.
    """
    bpe = ByteBpe(how.path)
    table = {p: bpe.count(" " + p.decode("utf-8", "replace")) for p in frequent(docs, how)}
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TextCounter(how.path, shared.value, how.cached)
        for batch in batches:
            rows = texts(batch)
            n = [counter(x) for x in rows]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(x) for x in rows], pa.int64()), pa.array(n, pa.int64()), pa.array([x > how.limit for x in n], pa.bool_()),
            ], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def byte_counting() -> Counting:
    return Counting(tokenizer_path("byte_bpe_50k.json"))
