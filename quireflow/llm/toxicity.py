"""Toxicity by a convolutional text classifier in numpy.

A word's vector is the sum of two hashed embeddings, of the word and of its first bytes.  Filters of several
widths slide over the words, each keeps its maximum over the whole text, and a linear layer makes the logit.
The cut is calibrated by language on examples kept from training: the language is guessed from the text's own
function words, and its logits are shifted so that the best cut comes to lie at ``threshold``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import remainder, sample
from .textvec import LETTER, Adam, Words, best_threshold, blocks, per_text, sigmoid, words
from .token_counts import texts

#: Function words that tell the languages apart.
FUNCTION_WORDS = {
    "en": "the of and to is that it was with this for on are",
    "de": "der die und den das ist nicht ein zu von mit sich auf",
    "fr": "le les des et du une est dans qui pour sur pas au",
    "es": "el los las y del por con para una se al como su",
}


@dataclass(frozen=True)
class Network:
    label: str = "toxic"
    #: Rows whose crc32(doc_id) leaves this remainder are never learned from.
    modulus: int = 4
    held_out: int = 2
    #: The most rows of label 1 and 0 that are learned from.
    most_toxic: int = 2500
    most_clean: int = 3000
    threshold: float = 0.3
    buckets: int = 1 << 15
    stem: int = 6
    width: int = 12
    filters: int = 8
    widths: tuple[int, ...] = (1, 2, 3)
    epochs: int = 8
    #: Passes are more over a small sample, for so many steps at least.
    steps: int = 250
    rate: float = 0.01
    decay: float = 1e-5
    #: Every so many examples, one is kept for calibration.
    keep: int = 4
    seed: int = 11
    #: Words that are convolved together.
    at_once: int = 1 << 16


def guess(w: Words) -> np.ndarray:
    """The language with the most function words in each text; -1 where there are none."""
    table = [words([x.encode()], LETTER, fold=True).hash[0] for ws in FUNCTION_WORDS.values() for x in ws.split()]
    language = np.repeat(np.arange(len(FUNCTION_WORDS)), [len(ws.split()) for ws in FUNCTION_WORDS.values()])
    order = np.argsort(table)
    keys = np.array(table, np.uint64)[order]
    at = np.minimum(np.searchsorted(keys, w.hash), len(keys) - 1)
    which = np.where(keys[at] == w.hash, language[order][at], -1)
    counts = np.stack([per_text(np.add, (which == k).astype(np.int64), w.first) for k in range(len(FUNCTION_WORDS))], axis=1)
    return np.where(counts.max(axis=1, initial=0) > 0, counts.argmax(axis=1), -1)


def read(rows: list[bytes], how: Network) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of words and stems, where each text's words begin, and its language."""
    w = words(rows, LETTER, fold=True, stem=how.stem)
    word = ((w.hash >> np.uint64(40)) % np.uint64(how.buckets)).astype(np.int32)
    stem = ((w.stem >> np.uint64(40)) % np.uint64(how.buckets)).astype(np.int32) if w.stem is not None else word
    return word, stem, w.first, guess(w)


def convolved(model: dict[str, np.ndarray], x: np.ndarray, first: np.ndarray, how: Network) -> np.ndarray:
    """Every filter's value, a row for each, at every word; words behind the end of a text count as zeros."""
    flat = model["kernel"].T @ x.T
    left = np.repeat(first[1:], np.diff(first)) - np.arange(len(x))
    out, at = [], 0
    for width in how.widths:
        part = flat[at : at + how.filters]
        for o in range(1, width):
            more = flat[at + o * how.filters : at + (o + 1) * how.filters, o:]
            part[:, : more.shape[1]] += more * (left[: more.shape[1]] > o)
        out.append(part)
        at += width * how.filters
    return np.concatenate(out)


def peaks(c: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each text's maximum of each filter; 0 for a text without words."""
    out = np.zeros((len(first) - 1, len(c)), c.dtype)
    some = first[1:] > first[:-1]
    if some.any():
        out[some] = np.maximum.reduceat(c, first[:-1][some], axis=1).T
    return out


def highest(model: dict[str, np.ndarray], word: np.ndarray, stem: np.ndarray, first: np.ndarray, how: Network) -> np.ndarray:
    """``peaks`` of all words, ``how.at_once`` at a time, each time with those that the filters look ahead to."""
    out = np.full((len(first) - 1, how.filters * len(how.widths)), -np.inf, np.float32)
    for a in range(0, len(word), how.at_once):
        b = min(a + how.at_once, len(word))
        e = min(b + max(how.widths) - 1, len(word))
        x = model["word"][word[a:e]] + model["stem"][stem[a:e]]
        c = convolved(model, x, np.clip(first, a, e) - a, how)
        own = np.clip(first, a, b) - a
        some = np.flatnonzero(own[1:] > own[:-1])
        out[some] = np.maximum(out[some], np.maximum.reduceat(c[:, : b - a], own[some], axis=1).T)
    out[first[1:] == first[:-1]] = 0
    return out


def logits(model: dict[str, np.ndarray], word: np.ndarray, stem: np.ndarray, first: np.ndarray, how: Network) -> np.ndarray:
    return np.maximum(0, highest(model, word, stem, first, how) + model["bias"]) @ model["out"] + model["b"][0]


def step(model: dict[str, np.ndarray], word: np.ndarray, stem: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray, how: Network) -> dict:
    """Gradients over some texts; only the embeddings of the words at the maxima have any: rows and values."""
    x = model["word"][word] + model["stem"][stem]
    c = convolved(model, x, first, how)
    peak = peaks(c, first)
    hidden = np.maximum(0, peak + model["bias"])
    err = ((sigmoid(hidden @ model["out"] + model["b"][0]) - y) * weight / len(y)).astype(np.float32)
    d = err[:, None] * model["out"] * (hidden > 0)
    g = {k: how.decay * v for k, v in model.items() if k not in ("word", "stem")}
    g["out"] += err @ hidden
    g["b"][0] += err.sum()
    g["bias"] += d.sum(axis=0)
    doc = np.repeat(np.arange(len(y)), np.diff(first))
    f, pos = np.nonzero(c == peak.T[:, doc])
    _, only = np.unique(doc[pos].astype(np.int64) * len(c) + f, return_index=True)
    pos, f = pos[only], f[only]
    own = d[doc[pos], f]
    begin, at = 0, 0
    places, moves = [np.zeros(0, np.int64)], [np.zeros((0, how.width), np.float32)]
    for width in how.widths:
        mine = (f >= begin) & (f < begin + how.filters) & (own != 0)
        for o in range(width):
            p, k, e = pos[mine] + o, at + o * how.filters + f[mine] - begin, own[mine]
            fits = p < first[doc[pos[mine]] + 1]
            p, k, e = p[fits], k[fits], e[fits]
            np.add.at(g["kernel"].T, k, x[p] * e[:, None])
            places.append(p)
            moves.append(model["kernel"].T[k] * e[:, None])
        begin += how.filters
        at += width * how.filters
    touched, dx = np.concatenate(places), np.concatenate(moves)
    for k, ids in (("word", word), ("stem", stem)):
        rows, at_row = np.unique(ids[touched], return_inverse=True)
        g[k] = (rows, np.zeros((len(rows), how.width), np.float32))
        np.add.at(g[k][1], at_row, dx)
    return g


def fit(rows: list[bytes], labels: list[int], how: Network) -> dict[str, np.ndarray]:
    """Weights with the least loss on the kept examples, and ``cut``, each language's calibrated logit.

    Without examples of both labels every text gets the same score.
    """
    y = np.array(labels, np.float32)
    rng = np.random.default_rng(how.seed)
    n = how.filters * len(how.widths)
    draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    model = {
        "word": draw(how.buckets, how.width, scale=0.1), "stem": draw(how.buckets, how.width, scale=0.1), "kernel": draw(how.width, how.filters * sum(how.widths), scale=0.3),
        "bias": np.zeros(n, np.float32), "out": draw(n, scale=0.3), "b": np.full(1, -1, np.float32),
    }
    cut = np.zeros(len(FUNCTION_WORDS) + 1)
    if not len(y) or y.min() == y.max():
        return model | {"out": model["out"] * 0, "b": np.zeros(1, np.float32), "cut": cut + (-4 if len(y) and y[0] else 4)}
    parts = [read(run, how) for _, run in blocks(rows)]
    word, stem = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    first = np.concatenate([[0], *[np.diff(p[2]) for p in parts]]).cumsum()
    language = np.concatenate([p[3] for p in parts])
    # Every ``keep``-th example of either label is kept for calibration.
    kept = np.zeros(len(y), bool)
    for label in (0, 1):
        kept[np.flatnonzero(y == label)[how.keep - 1 :: how.keep]] = True

    def some(own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        take = np.concatenate([np.arange(first[d], first[d + 1]) for d in own])
        return word[take], stem[take], np.concatenate(([0], np.cumsum(first[own + 1] - first[own])))

    learn, check = np.flatnonzero(~kept), np.flatnonzero(kept)
    if not len(check):
        check = learn
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)
    adam, best, least = Adam(model, how.rate), None, np.inf
    for _ in range(max(how.epochs, how.steps * 32 // len(learn))):
        order = rng.permutation(learn)
        for at in range(0, len(order), 32):
            own = order[at : at + 32]
            adam.update(step(model, *some(own), y[own], weight[own], how))
        z = np.concatenate([logits(model, *some(check[i : i + 256]), how) for i in range(0, len(check), 256)])
        loss = float(np.mean(weight[check] * np.logaddexp(0, np.where(y[check] == 1, -z, z))))
        if loss < least:
            best, least, kept_z = {k: v.copy() for k, v in model.items()}, loss, z
    cut[:] = best_threshold(kept_z, y[check])
    for k in range(len(FUNCTION_WORDS)):
        own = language[check] == k
        if y[check][own].sum() >= 10 and (1 - y[check][own]).sum() >= 10:
            cut[k] = best_threshold(kept_z[own], y[check][own])
    return best | {"cut": cut}


def scores_of(model: dict[str, np.ndarray], rows: list[bytes], how: Network) -> np.ndarray:
    word, stem, first, language = read(rows, how)
    z = logits(model, word, stem, first, how).astype(np.float64) - model["cut"][language]
    return sigmoid(z + np.log(how.threshold / (1 - how.threshold)))


def scores(docs: DataFrame, labels: DataFrame, how: Network = Network()) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs`` (doc_id, text).

    Defined results: null and empty texts have no words and get the score of a text without any filter's
    signal; a null id is not held out; repeated rows are scored each; texts of any length are scored whole;
    without labels of both kinds all scores are equal; an empty table gives no rows; other columns are ignored.
    """
    rows, y = sample(docs, labels, how.label, how.modulus, how.held_out, {0: how.most_clean, 1: how.most_toxic})
    shared = docs.sparkSession.sparkContext.broadcast(fit(rows, y, how))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            p = np.concatenate([np.zeros(0), *[scores_of(model, part, how) for _, part in blocks(texts(batch))]])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("doc_id", "held_out")), pa.array(p), pa.array((p >= how.threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(remainder(how.modulus) == how.held_out, F.lit(False)).alias("held_out")
    return docs.select("doc_id", "text", held).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
