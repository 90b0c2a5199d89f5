"""Vectorised text features for Arrow batches (numpy over the UTF-8 bytes of many texts at once)."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
#: Byte ranges longer than this are hashed one by one: in a polynomial modulo 2^64 long patterned words can meet.
_LONG = 64
_tables = [np.ones(1, U), np.ones(1, U)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: spreads every input bit over the result."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables[0]) < n:
        size = max(n, 1 << 21)
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            one = np.full(size, base, U)
            one[0] = 1
            _tables[i] = np.cumprod(one)
    return _tables[0], _tables[1]


class Block:
    """Some texts as one byte array: ``off`` (text bounds), ``ws``/``we`` (word bounds), ``wdoc``, ``wn``.

    ``gaps`` marks the bytes between words.
    """

    def __init__(self, buf: np.ndarray, off: np.ndarray, lower: bool = False, gaps: np.ndarray = _SPACE):
        self.raw, self.off, self.n = buf, off, len(off) - 1
        self.buf = _LOWER[buf] if lower else buf
        inside = np.zeros(len(buf) + 2, bool)
        inside[1:-1] = ~gaps[buf]
        cut = np.zeros(len(buf) + 1, bool)
        cut[off] = True
        self.ws = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
        self.we = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
        first = np.searchsorted(self.ws, off)
        self.wfirst, self.wn = first[:-1], np.diff(first)
        self.wdoc = np.repeat(np.arange(self.n), self.wn)
        self._sum = None

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hash of each byte range; equal bytes give equal hashes anywhere in any block."""
        power, inverse = _powers(len(self.buf) + 1)
        if self._sum is None:
            self._sum = np.zeros(len(self.buf) + 1, U)
            np.cumsum((self.buf.astype(U) + U(1)) * power[: len(self.buf)], out=self._sum[1:])
        h = mix((self._sum[end] - self._sum[start]) * inverse[start] + (end - start).astype(U))
        for i in np.flatnonzero(end - start > _LONG).tolist():
            h[i] = int.from_bytes(blake2b(self.buf[start[i] : end[i]], digest_size=8).digest(), "little")
        return h

    def word_hashes(self) -> np.ndarray:
        return self.hashes(self.ws, self.we)

    def counts(self, mask: np.ndarray) -> np.ndarray:
        """Per text, how many of its bytes are in ``mask``."""
        total = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return total[self.off[1:]] - total[self.off[:-1]]


def by_group(values: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The order of ``values`` by group, then value; groups are small whole numbers."""
    if len(group) and group.max() < 1 << 16:  # a radix sort
        order = np.argsort(values)
        return order[np.argsort(group[order].astype(np.uint16), kind="stable")]
    return np.lexsort((values, group))


def windows(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` items inside one document, with their first positions."""
    if len(h) < n:
        return np.zeros(0, U), np.zeros(0, np.int64)
    at = np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1 :])
    out = np.full(len(at), n, U)
    for k in range(n):
        out = (out ^ (out >> U(32))) * U(0xD6E8FEB86659FD93) + h[at + k]
    return mix(out), at


def blocks(texts: pa.Array, limit: int = 1 << 20, lower: bool = False, gaps: np.ndarray = _SPACE) -> Iterator[tuple[int, int, Block]]:
    """``(first, last, Block)`` over an Arrow string column, about ``limit`` bytes each; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    big = pa.types.is_large_string(texts.type)
    bufs = texts.buffers()
    off = np.frombuffer(bufs[1], np.int64 if big else np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] else np.zeros(0, np.uint8)
    off, lo = off.astype(np.int64), 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, hi, Block(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], lower, gaps)
        lo = hi
