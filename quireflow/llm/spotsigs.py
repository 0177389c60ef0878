"""Document fingerprints by SpotSigs.

Wherever a common word stands (the anchor), it and the chain of the next content words make one signature; a
document's fingerprint is the set of its signatures.  Navigation and lists have few common words, so that
fingerprints follow the running text.

A text may have few anchors or none.  So each fingerprint has a second part, kept apart: the least signatures that
take every word as an anchor.  Two fingerprints are compared by the same part of both: by the first if both
have enough of it, else by the second.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .textvec import LETTER, RUN, blocks, mix, words

#: Common words of English, German, French and Spanish that anchor signatures.
ANCHORS = (
    "a an and are as at be but by can do for from had has have he in is it not of on or that the this to was were will with "
    "als auch auf aus bei das dem den der des die ein eine er es für ist mit nicht sich sie und von zu "
    "au aux ce dans de du elle en est et il la le les mais ne ou par pas pour qui sur un une "
    "al con del el ella ellos la las lo los más no para pero por que se su una y"
)


@dataclass(frozen=True)
class Spots:
    #: Content words in a chain.
    chain: int = 3
    #: Anchored signatures that a fingerprint is compared by, at least, and the most others that it keeps.
    anchored: int = 8
    others: int = 64
    #: Bytes of text, about, that are compared together, and the most parts: beyond, parts grow.
    part_bytes: int = 8 << 20
    most_parts: int = 1 << 20


_TABLE = np.sort(np.unique(np.array([words([w.encode()], LETTER, fold=True).hash[0] for w in ANCHORS.split()], np.uint64)))


def chained(heads: np.ndarray, after: np.ndarray, hash_: np.ndarray, first: np.ndarray, chain: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of the words at ``heads``, each with the next ``chain`` words among those at ``after``; where each text's begin."""
    made, upto = [np.zeros(0, np.uint32)], np.zeros(len(first), np.int64)
    for a in range(0, len(heads), RUN):
        own = heads[a : a + RUN]
        at = np.searchsorted(after, own, side="right")
        fits = at + chain <= len(after)
        own, at = own[fits], at[fits]
        fits = after[at + chain - 1] < first[np.searchsorted(first, own, side="right")]
        own, at = own[fits], at[fits]
        s = hash_[own]
        for j in range(chain):
            s = mix(s + hash_[after[at + j]])
        made.append((s >> np.uint64(32)).astype(np.uint32))
        upto += np.searchsorted(own, first)
    return np.concatenate(made), upto


Print = tuple[np.ndarray, np.ndarray]


def fingerprints(rows: list[bytes], how: Spots = Spots()) -> list[Print]:
    """The sorted 32-bit signatures of each text: the anchored ones, and the least of those at every word.

    A text too short for a chain has one signature of all its words at every word; one without words, of its
    bytes; an empty one has none.
    """
    out: list[Print] = []
    for _, part in blocks(rows):
        w = words(part, LETTER, fold=True)
        at = np.minimum(np.searchsorted(_TABLE, w.hash), len(_TABLE) - 1)
        common, all_ = _TABLE[at] == w.hash, np.arange(len(w.hash))
        parts = [chained(heads, after, w.hash, w.first, how.chain) for heads, after in ((np.flatnonzero(common), np.flatnonzero(~common)), (all_, all_))]
        for n, text in enumerate(part):
            anchored, every = (np.unique(s[first[n] : first[n + 1]]) for s, first in parts)
            if not len(every) and text:
                mine = w.hash[w.first[n] : w.first[n + 1]].tobytes() or text
                every = np.frombuffer(hashlib.md5(mine).digest()[:4], "<u4")
            out.append((anchored, every[: how.others]))
    return out


def written(print_: Print) -> str:
    """Eight hexadecimal digits for each signature, in order, the two parts with a full stop between."""
    return ".".join(s.astype(">u4").tobytes().hex() for s in print_)


def jaccard(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity of two sets; 0 without looking where their lengths rule ``least`` out."""
    if not len(a) and not len(b):
        return 1.0
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def likeness(p: Print, q: Print, how: Spots = Spots(), least: float = 0.0) -> float:
    """Jaccard similarity of the anchored signatures; where either text has too few, of those at every word.

    Of the latter only the least are known: their share among the least of the union estimates it, and is it
    where neither text has more.
    """
    if min(len(p[0]), len(q[0])) >= how.anchored:
        return jaccard(p[0], q[0], least)
    if max(len(p[1]), len(q[1])) < how.others:
        return jaccard(p[1], q[1], least)
    union = np.union1d(p[1], q[1])[: how.others]
    return float(np.isin(union, np.intersect1d(p[1], q[1], assume_unique=True)).mean())


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compared(docs: DataFrame, how: Spots = Spots()) -> DataFrame:
    """Fingerprints of every text and of its edited text, and likenesses; see ``queries``.

    The next document is that with the next smaller id; after the least comes the greatest.  Texts are dealt
    out once, by ranges of ids; the first document of a range goes to the range before it, too.  Defined
    results: null and empty texts have no signature, and two of these are alike; of rows with equal ids the
    lesser text comes first; a null id comes last; a table of one row is its own next; an empty table gives
    no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    keyed = docs.select("doc_id", "text", F.coalesce(F.col("doc_id"), F.lit(-(2**63))).cast("long").alias("key"))
    total = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(min(how.most_parts, max(1, total // how.part_bytes)))
    ids = keyed.select("key")
    cuts = np.unique(np.array(ids.approxQuantile("key", [n / parts for n in range(1, parts)], 0.1 / parts) if parts > 1 else [], np.float64)).astype(np.int64)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(cuts, batch.column(0).to_numpy())), batch.column(0)], ["part", "key"])

    # One row for each part.
    heads = sorted((r.part, r.head) for r in ids.mapInArrow(numbered, "part long, key long").groupBy("part").agg(F.max("key").alias("head")).collect())
    head = np.array([h for _, h in heads], np.int64)
    before = {h: heads[(n + 1) % len(heads)][0] for n, (_, h) in enumerate(heads)}
    shared = spark.sparkContext.broadcast((cuts, head, before))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, head, before = shared.value
        for batch in batches:
            key = batch.column(2).to_numpy()
            own = pa.RecordBatch.from_arrays([pa.array(np.searchsorted(cuts, key)), batch.column(0), batch.column(1), batch.column(2), pa.array(np.zeros(len(key), bool))], ["part", "doc_id", "text", "key", "guest"])
            yield own
            if len(at := np.flatnonzero(np.isin(key, head))):
                also = own.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array([before[k] for k in key[at].tolist()], pa.int64()), *(also.column(k) for k in (1, 2, 3)), pa.array(np.ones(len(at), bool))], own.schema.names)

    def compare(table: pa.Table) -> pa.Table:
        rows = list(zip(table.column("guest").to_pylist(), [-k for k in table.column("key").to_pylist()], [x or "" for x in table.column("text").to_pylist()], table.column("doc_id").to_pylist(), strict=True))
        guests = sorted((r for r in rows if r[0]), key=lambda r: r[2])
        # The guest comes last, from the range below: it is the first of that range.
        order = sorted((r for r in rows if not r[0]), key=lambda r: (r[1], r[2])) + guests[:1]
        text = [r[2] for r in order]
        edited = []
        for t, after in zip(text, text[1:], strict=False):
            cut = len(t) // 3
            edited.append(t[: len(t) - cut] + after[:cut])
        prints, other = fingerprints([t.encode("utf-8", "replace") for t in text], how), fingerprints([t.encode("utf-8", "replace") for t in edited], how)
        n = len(edited)
        return pa.table([
            pa.array([r[3] for r in order[:n]], pa.int64()), pa.array([len(t) for t in text[:n]], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
            pa.array([written(p) for p in prints[:n]], pa.string()), pa.array([written(p) for p in other], pa.string()),
            pa.array([likeness(p, q, how) for p, q in zip(prints, other, strict=False)], pa.float64()), pa.array([likeness(p, q, how) for p, q in zip(prints, prints[1:], strict=False)], pa.float64()),
        ], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    dealt = keyed.mapInArrow(deal, "part long, doc_id long, text string, key long, guest boolean")
    return dealt.groupBy("part").applyInArrow(compare, RESULT)


def near_pairs(docs: DataFrame, threshold: float = 0.8, how: Spots = Spots()) -> DataFrame:
    """Pairs of different sets of anchored signatures (u < v, written) of similarity ``threshold`` or more.

    Sets are partitioned by their length so that only equal or neighbouring partitions can match.  In a
    partition they meet by the signatures of their prefixes: of two sets that are alike, the first few
    signatures in a common order must share one.  Equal sets are one; texts of fewer anchored signatures than
    ``how.anchored`` are left out, null and empty ones too; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [p for p, _ in fingerprints([(t or "").encode() for t in batch.column(0).to_pylist()], how)]
            yield pa.RecordBatch.from_arrays([pa.array([written((p,)) for p in prints]), pa.array([p.astype(np.int64).tolist() for p in prints], pa.list_(pa.int64()))], ["print", "sigs"])

    whole = docs.select("text").mapInArrow(run, "print string, sigs array<long>").filter(F.size("sigs") >= how.anchored)
    sets = staged(whole.groupBy("print").agg(F.first("sigs").alias("sigs")), "prints")
    size = F.size("sigs")
    level = F.floor(F.log(size) / -np.log(threshold) + 1e-9)
    first = F.explode(F.slice("sigs", F.lit(1), size - F.ceil(threshold * size - 1e-9) + 1))
    rows = sets.select("print", size.alias("n"), level.alias("level"), first.alias("sig"))
    probe = rows.select(F.col("print").alias("q"), F.col("n").alias("m"), F.explode(F.array(F.col("level"), F.col("level") - 1)).alias("level"), "sig")
    met = rows.join(probe, ["sig", "level"]).filter((F.col("print") != F.col("q")) & (F.least("n", "m") >= threshold * F.greatest("n", "m")))
    pairs = met.select(F.least("print", "q").alias("u"), F.greatest("print", "q").alias("v")).distinct()
    a, b = sets.select(F.col("print").alias("u"), F.col("sigs").alias("a")), sets.select(F.col("print").alias("v"), F.col("sigs").alias("b"))
    both = pairs.join(a, "u").join(b, "v").withColumn("both", F.size(F.array_intersect("a", "b")))
    near = F.col("both") / (F.size("a") + F.size("b") - F.col("both"))
    return both.select("u", "v", near.alias("likeness")).filter(F.col("likeness") >= threshold)
