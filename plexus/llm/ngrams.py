"""Hashed word and character n-grams of Arrow batches, and logistic regression over them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from plexus.llm.kernel import U, Block, mix, windows

#: (letter, n): ``w`` for words, ``c`` for bytes of the text.
Kinds = tuple[tuple[str, int], ...]


def grams(b: Block, kind: tuple[str, int], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """``(bucket of each n-gram, n-grams per text)``, in text order."""
    unit, n = kind
    if unit == "w":
        h, _ = windows(b.word_hashes(), b.wdoc, n)
        count = np.maximum(b.wn - n + 1, 0)
    else:
        size = np.diff(b.off)
        count = np.maximum(size - n + 1, 0)
        total = max(len(b.buf) - n + 1, 0)
        h = np.zeros(total, U)
        for k in range(n):
            h |= b.buf[k : k + total].astype(U) << U(8 * k)
        inside = np.ones(len(b.buf), bool)
        for k in range(1, n):  # no n-gram starts in the last n - 1 bytes of a text
            inside[b.off[1:][size >= k] - k] = False
        h = h[inside[:total]]
        h = mix(h + U(n))
    return (h >> U(64 - bits)).astype(np.int64), count


def per_text(values: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of ``count`` values."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    end = np.cumsum(count)
    return total[end] - total[end - count]


def features(b: Block, kinds: Kinds, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text: sparse ``(index, share)``; the shares of each kind sum to 1."""
    out: list[list] = [[] for _ in range(b.n)]
    for k, kind in enumerate(kinds):
        bucket, count = grams(b, kind, bits)
        end = np.cumsum(count)
        for i in np.flatnonzero(count):
            index, times = np.unique(bucket[end[i] - count[i] : end[i]], return_counts=True)
            out[i].append(((k << bits) + index, times / count[i]))
    empty = np.zeros(0, np.int64), np.zeros(0)
    return [(np.concatenate([x[0] for x in o]), np.concatenate([x[1] for x in o])) if o else empty for o in out]


def scores(b: Block, kinds: Kinds, bits: int, weights: np.ndarray) -> np.ndarray:
    """Per text: the weighted sum of its feature shares."""
    z = np.zeros(b.n)
    for k, kind in enumerate(kinds):
        bucket, count = grams(b, kind, bits)
        z += per_text(weights[k << bits : (k + 1) << bits][bucket], count) / np.maximum(count, 1)
    return z


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, dim: int, rounds: int = 60, l2: float = 1e-6):
    """Weights and bias of a logistic regression by AdaGrad over the full sample, classes balanced."""
    size = np.array([len(r[0]) for r in rows])
    index = np.concatenate([r[0] for r in rows])
    value = np.concatenate([r[1] for r in rows])
    row = np.repeat(np.arange(len(rows)), size)
    balance = np.where(y == 1, 0.5 / max((y == 1).sum(), 1), 0.5 / max((y == 0).sum(), 1))
    w, bias, seen, seen0 = np.zeros(dim), 0.0, np.full(dim, 1e-12), 1e-12
    for _ in range(rounds):
        z = np.bincount(row, w[index] * value, len(rows)) + bias
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * balance
        grad = np.bincount(index, error[row] * value, dim) + l2 * w
        seen += grad * grad
        seen0 += error.sum() ** 2
        w -= 1.0 * grad / np.sqrt(seen)
        bias -= 1.0 * error.sum() / np.sqrt(seen0)
    return w, bias


def calibrate(z: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[float, float]:
    """Platt scaling: ``(a, b)`` with probability ``1 / (1 + exp(-(a z + b)))``, by Newton steps."""
    weight = np.ones(len(z)) if weight is None else weight
    up, down = weight[y == 1].sum(), weight[y == 0].sum()
    goal = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))  # smoothed, so separable scores converge
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g, h = weight * (p - goal), weight * p * (1 - p) + 1e-9
        ga, gb = (g * z).sum(), g.sum()
        haa, hab, hbb = (h * z * z).sum() + 1e-6, (h * z).sum(), h.sum() + 1e-6
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        step = min(1.0, 5.0 / (abs(da) + abs(db) + 1e-12))
        a, b = a - step * da, b - step * db
    return float(a), float(b)


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def rows_of(index: pa.ChunkedArray, value: pa.ChunkedArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sparse rows from two list columns, without a Python object per entry."""
    out = []
    for i, v in zip(index.chunks, value.chunks, strict=True):
        flat, weight, cut = i.flatten().to_numpy(), v.flatten().to_numpy(), np.cumsum(i.value_lengths().to_numpy())
        out += list(zip(np.split(flat.astype(np.int64), cut[:-1]), np.split(weight, cut[:-1]), strict=True))
    return out
