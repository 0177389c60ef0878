"""A bounded sample of labelled rows for fitting a classifier on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def remainder(modulus: int):
    """crc32 of the doc_id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string")) % modulus


def sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, most: dict[int, int]) -> tuple[list[bytes], list[int]]:
    """Texts and labels of rows outside the held-out fold, ``most[y]`` at most with label y, chosen by a hash of the id.

    Rows without label or id are no examples; of an id with several labels one row counts.  Only as many ids
    as ``most`` allows are broadcast, and as many texts collected.
    """
    usable = labels.filter(F.col(label).isin(*most) & (remainder(modulus) != held_out))
    usable = usable.groupBy("doc_id").agg(F.min(label).alias("y"))
    picked = [usable.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in most.items()]
    ids = picked[0]
    for more in picked[1:]:
        ids = ids.unionByName(more)
    texts = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
    found = texts.orderBy(F.xxhash64("doc_id"), "doc_id").toArrow()
    return [(t or "").encode() for t in found.column("text").to_pylist()], found.column("y").to_pylist()
