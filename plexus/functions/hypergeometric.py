"""The two-sided exact test of 2x2 tables in constant memory, whatever the cells.

The logarithm of a table's probability comes from saddle points (Loader, 2000), whose parts are all small, so
that cells of billions keep their last digits; factorials of such size would lose them in their difference.
Tables no likelier than the seen one lie outside of two cuts around the mode, found by bisection.  Each
tail is summed from its cut outwards by the ratio of neighbours, a block at a time, until the rest is
too small to count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Logarithms within this of the seen table's count as no likelier.
TOLERANCE = 1e-7
BLOCK = 4096


def _stirling_error(n: float) -> float:
    """ln(n!) minus Stirling's formula."""
    if n < 16:
        return math.lgamma(n + 1) - ((n + 0.5) * math.log(n) - n + 0.5 * math.log(2 * math.pi)) if n else 0.0
    m = 1 / (n * n)
    return (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - m / 1188) * m) * m) * m) / n


def _deviance(x: float, mean: float) -> float:
    """x ln(x / mean) + mean - x, exact where they are close."""
    if abs(x - mean) < 0.1 * (x + mean):
        v = (x - mean) / (x + mean)
        total, term, j = (x - mean) * v, 2 * x * v, 1
        while True:
            term *= v * v
            more = total + term / (2 * j + 1)
            if more == total:
                return total
            total, j = more, j + 1
    return x * math.log(x / mean) + mean - x


def _log_binomial(x: int, n: int, p: float, q: float) -> float:
    if x == 0:
        return n * math.log1p(-p) if p <= q else n * math.log(q) if n else 0.0
    if x == n:
        return n * math.log1p(-q) if q < p else n * math.log(p)
    part = _stirling_error(n) - _stirling_error(x) - _stirling_error(n - x) - _deviance(x, n * p) - _deviance(n - x, n * q)
    return part + 0.5 * (math.log(n) - math.log(2 * math.pi) - math.log(x) - math.log(n - x))


def log_probability(k: int, rows: int, cols: int, n: int) -> float:
    """Of ``k`` in the first cell of a table with these margins."""
    if cols in (0, n) or rows in (0, n):
        return 0.0
    p, q = cols / n, (n - cols) / n
    return _log_binomial(k, rows, p, q) + _log_binomial(cols - k, n - rows, p, q) - _log_binomial(cols, n, p, q)


def _tail(k: int, last: int, step: int, rows: int, cols: int, n: int) -> float:
    """The sum of all probabilities from ``k`` to ``last``, relative to that of ``k``."""
    total, term = 1.0, 1.0
    while k != last:
        size = min(BLOCK, abs(last - k))
        at = k + step * np.arange(size, dtype=np.float64)
        if step > 0:
            ratio = (rows - at) * (cols - at) / ((at + 1) * (n - rows - cols + at + 1))
        else:
            ratio = at * (n - rows - cols + at) / ((rows - at + 1) * (cols - at + 1))
        terms = term * np.cumprod(ratio)
        total, term, k = total + math.fsum(terms), float(terms[-1]), k + step * size
        if term < 1e-18 * total and ratio[-1] < 1 - 1e-9:
            return total
    return total


def _cut(inner: int, outer: int, most: float, log_p) -> int | None:
    """The place nearest the mode ``inner`` from which on to ``outer`` no logarithm is over ``most``; None if even the last is."""
    if log_p(outer) > most:
        return None
    step = 1 if outer > inner else -1
    near, far = 0, abs(outer - inner)
    while near < far:
        middle = (near + far) // 2
        if log_p(inner + step * middle) <= most:
            far = middle
        else:
            near = middle + 1
    return inner + step * far


def two_sided(a: int, b: int, c: int, d: int) -> float:
    """The probability of all tables with these margins that are no likelier than this one."""
    rows, cols, n = a + b, a + c, a + b + c + d
    low, high = max(0, rows + cols - n), min(rows, cols)
    log_p = lambda k: log_probability(k, rows, cols, n)
    mode = min(max((rows + 1) * (cols + 1) // (n + 2), low), high)
    most = log_p(a) + TOLERANCE
    if log_p(mode) <= most:
        return 1.0
    left, right = _cut(mode, low, most, log_p), _cut(mode, high, most, log_p)
    total = 0.0
    if left is not None:
        total += math.exp(log_p(left)) * _tail(left, low, -1, rows, cols, n)
    if right is not None:
        total += math.exp(log_p(right)) * _tail(right, high, 1, rows, cols, n)
    return min(total, 1.0)


def _tests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cells = [batch.column(i) for i in range(4)]
        p = [two_sided(*x) for x in zip(*[c.to_pylist() for c in cells], strict=True)]
        yield pa.RecordBatch.from_arrays([*cells, pa.array(p, pa.float64())], names=["a", "b", "c", "d", "p"])


def fisher_p(tables: DataFrame) -> DataFrame:
    """``tables`` with whole columns a, b, c, d that are not negative, and two-sided ``p``; like tables are tested once."""
    cells = ["a", "b", "c", "d"]
    once = tables.select(*[F.col(x).cast("long").alias(x) for x in cells]).where(" and ".join(f"{x} >= 0" for x in cells)).distinct()
    return tables.join(once.mapInArrow(_tests, "a long, b long, c long, d long, p double"), cells)
