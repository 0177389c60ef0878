"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Pairwise interactions have rank ``rank`` and are scored in linear time,
    sum over f of ((sum v_f x)^2 - sum (v_f x)^2) / 2.
A word weighs its share of the text's words; statistics and the text's size (its only metadata used: labels,
language, source and id are no inputs) come as one feature for the bin that they fall in.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import remainder, sample
from .textvec import LETTER, Adam, blocks, distinct, per_text, sigmoid, words
from .token_counts import texts

STATS = ("words", "distinct", "most_frequent", "word_length", "symbols", "digits", "upper", "punctuation", "beyond_ascii", "words_a_line", "repeats", "bytes")


@dataclass(frozen=True)
class Machine:
    label: str = "quality"
    #: Rows whose crc32(doc_id) leaves this remainder are never learned from.
    modulus: int = 3
    held_out: int = 1
    #: The most rows of either label that are learned from.
    most: int = 2500
    threshold: float = 0.5
    buckets: int = 1 << 15
    rank: int = 6
    bins: int = 12
    #: Passes over the sample; more of them over a small one, for so many steps at least.
    epochs: int = 8
    steps: int = 200
    rate: float = 0.02
    decay: float = 1e-4
    seed: int = 7


def classes() -> np.ndarray:
    """Character classes by byte: symbols, digits, upper case, punctuation, beyond ASCII, line feeds."""
    table = np.zeros(256, np.uint8)
    table[33:127] = 4
    table[65:91], table[97:123], table[48:58] = 3, 0, 2
    for c in b"#*$%&|<>":
        table[c] = 1
    table[128:], table[10] = 5, 6
    return table


CLASS = classes()


def vectors(rows: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and share of each distinct word of each text, where each text's begin, and its statistics."""
    w = words(rows, LETTER, fold=True)
    n = np.diff(w.first)
    hashed, count, first = distinct(w.hash, w.first)
    share = (count / np.repeat(np.maximum(1, n), np.diff(first))).astype(np.float32)
    bucket = (hashed >> np.uint64(40)).astype(np.int64) % buckets
    size = np.diff(w.begin) - 1
    of = CLASS[w.bytes]
    per = np.stack([np.add.reduceat(of == k, w.begin[:-1], dtype=np.int64) for k in range(1, 7)]) if len(rows) else np.zeros((6, 0))
    same = np.zeros(len(w.hash), np.int32)
    same[1:] = w.hash[1:] == w.hash[:-1]
    same[w.first[:-1][n > 0]] = 0
    some, whole = np.maximum(1, n), np.maximum(1, size)
    stats = np.stack([
        np.log1p(n), np.diff(first) / some, per_text(np.maximum, share, first), per_text(np.add, w.length, w.first) / some,
        per[0] / whole, per[1] / whole, per[2] / whole, per[3] / whole, per[4] / whole, n / np.maximum(1, per[5]), per_text(np.add, same, w.first) / some, np.log1p(size),
    ], axis=1).astype(np.float32)
    return bucket, share, first, stats


def binned(stats: np.ndarray, edges: np.ndarray, buckets: int) -> np.ndarray:
    """One feature for each statistic, numbered behind the words' buckets."""
    k = np.stack([np.searchsorted(edges[:, j], stats[:, j]) for j in range(stats.shape[1])], axis=1)
    return buckets + np.arange(stats.shape[1]) * (len(edges) + 1) + k


def score(model: dict[str, np.ndarray], bucket: np.ndarray, share: np.ndarray, first: np.ndarray, fixed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logits, and each text's sums of v x."""
    w, v = model["w"], model["v"]
    vx = v[bucket] * share[:, None]
    sums = per_text(np.add, vx, first) + v[fixed].sum(axis=1)
    squares = per_text(np.add, vx * vx, first) + (v[fixed] ** 2).sum(axis=1)
    z = model["b"][0] + per_text(np.add, w[bucket] * share, first) + w[fixed].sum(axis=1) + ((sums**2 - squares) / 2).sum(axis=1)
    return z, sums


def fit(rows: list[bytes], labels: list[int], how: Machine) -> dict[str, np.ndarray]:
    """The trained weights; without examples of both labels all scores are the label's share, or a half."""
    y = np.array(labels, np.float32)
    rng = np.random.default_rng(how.seed)
    parts = [vectors(run, how.buckets) for _, run in blocks(rows)] or [vectors([], how.buckets)]
    bucket, share = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    first = np.concatenate([[0], *[np.diff(p[2]) for p in parts]]).cumsum()
    stats = np.concatenate([p[3] for p in parts])
    edges = np.quantile(stats, np.linspace(0, 1, how.bins + 1)[1:-1], axis=0).astype(np.float32) if len(stats) else np.zeros((how.bins - 1, len(STATS)), np.float32)
    features = how.buckets + len(STATS) * how.bins
    model = {"b": np.zeros(1, np.float32), "w": np.zeros(features, np.float32), "v": (rng.standard_normal((features, how.rank)) * 0.05).astype(np.float32)}
    if len(y) and y.min() == y.max():
        model["b"][0] = 4 if y[0] else -4
    if not len(y) or y.min() == y.max():
        return model | {"v": model["v"] * 0, "edges": edges}
    fixed = binned(stats, edges, how.buckets)
    # Either label weighs the same, so that a half is the natural cut.
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)
    adam = Adam(model, how.rate)
    for _ in range(max(how.epochs, how.steps * 64 // len(y))):
        order = rng.permutation(len(y))
        for at in range(0, len(order), 64):
            own = order[at : at + 64]
            take = np.concatenate([np.arange(first[d], first[d + 1]) for d in own])
            lens = first[own + 1] - first[own]
            begin = np.concatenate(([0], np.cumsum(lens)))
            b, x = bucket[take], share[take]
            z, sums = score(model, b, x, begin, fixed[own])
            err = ((sigmoid(z) - y[own]) * weight[own] / len(own)).astype(np.float32)
            g = {k: np.zeros_like(a) for k, a in model.items()}
            g["b"][0] = err.sum()
            doc = np.repeat(np.arange(len(own)), lens)
            np.add.at(g["w"], b, err[doc] * x)
            np.add.at(g["w"], fixed[own].ravel(), np.repeat(err, fixed.shape[1]))
            np.add.at(g["v"], b, (err[doc] * x)[:, None] * (sums[doc] - model["v"][b] * x[:, None]))
            np.add.at(g["v"], fixed[own].ravel(), (err[:, None, None] * (sums[:, None, :] - model["v"][fixed[own]])).reshape(-1, how.rank))
            for k in ("w", "v"):
                g[k] += how.decay * model[k]
            adam.update(g)
    return model | {"edges": edges}


def scores(docs: DataFrame, labels: DataFrame, how: Machine = Machine()) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs`` (doc_id, text).

    Defined results: null and empty texts are scored by their statistics; a null id is not held out; repeated
    rows are scored each; texts of any length are scored whole; without usable labels every score is a half;
    an empty table gives no rows; other columns, a clashing ``score`` or ``label`` too, are ignored.
    """
    rows, y = sample(docs, labels, how.label, how.modulus, how.held_out, {0: how.most, 1: how.most})
    shared = docs.sparkSession.sparkContext.broadcast(fit(rows, y, how))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            out = [np.zeros(0)]
            for _, part in blocks(texts(batch)):
                bucket, share, first, stats = vectors(part, how.buckets)
                out.append(sigmoid(score(model, bucket, share, first, binned(stats, model["edges"], how.buckets))[0].astype(np.float64)))
            p = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("doc_id", "held_out")), pa.array(p), pa.array((p >= how.threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(remainder(how.modulus) == how.held_out, F.lit(False)).alias("held_out")
    return docs.select("doc_id", "text", held).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, labels: DataFrame, how: Machine = Machine()) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, same columns; cases are defined as for ``scores``."""
    rows, y = sample(docs, labels, how.label, how.modulus, how.held_out, {0: how.most, 1: how.most})
    shared = docs.sparkSession.sparkContext.broadcast(fit(rows, y, how))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            keep = [np.zeros(0, bool)]
            for _, part in blocks(texts(batch)):
                bucket, share, first, stats = vectors(part, how.buckets)
                keep.append(sigmoid(score(model, bucket, share, first, binned(stats, model["edges"], how.buckets))[0]) >= how.threshold)
            yield batch.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(run, docs.schema)
