"""Words of many texts at once as numpy arrays, straight from their UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

#: Bytes of text that are vectorised together; a longer text is taken alone, so many of its bytes at a time.
BLOCK = 2 << 20
#: Words, or what is made of them, that are worked on together: more than a block has, unless it is one long text.
RUN = 1 << 20
_RANDOM = np.random.default_rng(20240229)
_VALUE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_POWER = _RANDOM.integers(1, 2**63, 1024, dtype=np.uint64) | np.uint64(1)
#: Upper-case ASCII counts as lower-case.
_FOLDED = _VALUE.copy()
_FOLDED[65:91] = _VALUE[97:123]
LETTER = np.zeros(256, bool)
LETTER[48:58] = LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
SOLID = np.ones(256, bool)
SOLID[9:14] = SOLID[32] = False


def mix(h: np.ndarray) -> np.ndarray:
    """A finalizer that spreads every bit over all of them."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(32)
    return h


class Words(NamedTuple):
    #: All bytes, each text followed by a line feed; where each text begins, and the end of the last.
    bytes: np.ndarray
    begin: np.ndarray
    #: Of each word: hash, hash of its first bytes, length in bytes; where each text's words begin.
    hash: np.ndarray
    stem: np.ndarray | None
    length: np.ndarray
    first: np.ndarray


def edges(data: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of bytes of ``kind`` start and end; the last byte is of none."""
    starts, ends, last = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.int8(0)
    for a in range(0, len(data), BLOCK):
        inside = kind[data[a : a + BLOCK]].view(np.int8)
        edge = np.diff(inside, prepend=last)
        starts.append(np.flatnonzero(edge == 1) + a)
        ends.append(np.flatnonzero(edge == -1) + a)
        last = inside[-1]
    return np.concatenate(starts), np.concatenate(ends)


def words(texts: list[bytes], kind: np.ndarray = SOLID, fold: bool = False, stem: int = 0) -> Words:
    """Words are runs of bytes of ``kind``; ``fold`` ignores the case of ASCII letters.

    A word's hash is a sum over its bytes, so that bytes are taken ``BLOCK`` at a time, wherever that cuts a word.
    """
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    begin = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)))
    start, end = edges(data, kind)
    length = end - start
    hashed = length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    stems = np.zeros(len(start), np.uint64) if stem else None
    for a in range(0, len(data), BLOCK):
        b = a + BLOCK
        lo, hi = int(np.searchsorted(end, a, side="right")), int(np.searchsorted(start, b))
        if lo == hi:
            continue
        here = np.minimum(end[lo:hi], b) - np.maximum(start[lo:hi], a)
        own = np.cumsum(here) - here
        at = np.arange(int(here.sum())) - np.repeat(own, here)
        at[: here[0]] += max(0, a - int(start[lo]))
        bytes_ = data[a:b]
        value = (_FOLDED if fold else _VALUE)[bytes_[kind[bytes_]]] * _POWER[at & 1023]
        hashed[lo:hi] += np.add.reduceat(value, own)
        if stem:
            stems[lo:hi] += np.add.reduceat(np.where(at < stem, value, np.uint64(0)), own)
    return Words(data, begin, mix(hashed), mix(stems) if stem else None, length, np.searchsorted(start, begin))


def distinct(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text's run of hashes: the distinct ones in order, how often each is there, where each text's begin."""
    if len(first) == 2:
        once, n = np.unique(h, return_counts=True)
        return once, n, np.array([0, len(once)])
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((h, doc))
    own, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (own[1:] != own[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    return h[at], np.diff(np.append(at, len(h))), np.searchsorted(own[at], np.arange(len(first)))


def per_text(op: np.ufunc, values: np.ndarray, first: np.ndarray, empty: float = 0) -> np.ndarray:
    """``op`` over each text's run of rows of ``values``; ``empty`` where it has none."""
    out = np.full((len(first) - 1, *values.shape[1:]), empty, values.dtype)
    some = first[1:] > first[:-1]
    if some.any():
        out[some] = op.reduceat(values, first[:-1][some], axis=0)
    return out


def spans(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Runs of ``sizes`` that add up to ``BLOCK`` at most, or of a single larger one: where each begins and ends."""
    at, whole = 0, 0
    for n, size in enumerate(sizes):
        if n > at and whole + size > BLOCK:
            yield at, n
            at, whole = n, 0
        whole += size
    if at < len(sizes):
        yield at, len(sizes)


def blocks(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of ``BLOCK`` bytes at most, each with the place of its first."""
    for a, b in spans([len(t) + 1 for t in texts]):
        yield a, texts[a:b]


class Adam:
    """Adam over a dict of arrays, in place; a pair of rows and values moves only those rows."""

    def __init__(self, weights: dict[str, np.ndarray], rate: float) -> None:
        self.weights, self.rate, self.step = weights, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in weights.items()}
        self.v = {k: np.zeros_like(v) for k, v in weights.items()}

    def update(self, grads: dict) -> None:
        self.step += 1
        scale = self.rate * np.sqrt(1 - 0.999**self.step) / (1 - 0.9**self.step)
        for k, g in grads.items():
            rows, g = g if isinstance(g, tuple) else (slice(None), g)
            m, v = self.m[k][rows], self.v[k][rows]
            m = m + 0.1 * (g - m)
            v = v + 0.001 * (g * g - v)
            self.m[k][rows], self.v[k][rows] = m, v
            self.weights[k][rows] -= (scale * m / (np.sqrt(v) + 1e-8)).astype(g.dtype)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def best_threshold(score: np.ndarray, label: np.ndarray) -> float:
    """The cut with the best F1: midway between the two scores it falls between."""
    order = np.argsort(-score, kind="stable")
    hits = np.cumsum(label[order])
    f1 = 2 * hits / (np.arange(1, len(order) + 1) + label.sum())
    at = int(np.argmax(f1))
    return float((score[order[at]] + score[order[min(at + 1, len(order) - 1)]]) / 2)
