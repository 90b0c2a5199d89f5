"""Hierarchies of predicates or categories as intervals of numbers.

Every name gets the number at which a walk down a spanning tree meets it, so that all below it in the tree
are a range.  A name with several parents stands below one of them in the tree; above the others its range is
added, and ranges that touch are joined.  A condition on descendants is then one range of a whole-number column, or a few,
which Parquet row groups and partitions can skip by.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Hierarchy:
    """``numbers`` of the names, and the ranges ``(first, last)`` of each name and all below it."""

    numbers: dict[str, int]
    ranges: dict[str, tuple[tuple[int, int], ...]]

    def below(self, column: str, names: Iterable[str]) -> Column:
        """Whether the numbers of ``column`` stand for one of ``names`` or a name below; unknown names match nothing."""
        spans = _joined([r for n in names for r in self.ranges.get(n, ())])
        out = F.lit(False)
        for i, (lo, hi) in enumerate(spans):
            one = F.col(column).between(lo, hi)
            out = one if i == 0 else out | one
        return out

    def numbered(self, df: DataFrame, column: str, out: str) -> DataFrame:
        """``df`` with the number of each name of ``column``; names outside of the hierarchy get -1."""
        rows = df.sparkSession.createDataFrame(list(self.numbers.items()), f"{column} string, {out} int")
        return df.join(F.broadcast(rows), column, "left").withColumn(out, F.coalesce(out, F.lit(-1)))  # as many rows as names


def _joined(spans: list[tuple[int, int]]) -> tuple[tuple[int, int], ...]:
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return tuple((a, b) for a, b in out)


def hierarchy(pairs: Iterable[tuple[str, str]]) -> Hierarchy:
    """From ``(child, parent)`` pairs, which may give a name several parents; ValueError if they run in a circle."""
    parents: dict[str, list[str]] = {}
    for child, parent in sorted(set(pairs)):
        parents.setdefault(child, []).append(parent)
        parents.setdefault(parent, [])
    children: dict[str, list[str]] = {n: [] for n in parents}
    for child, above in parents.items():
        for parent in above:
            children[parent].append(child)
    numbers, last = {}, {}
    stack = [(n, False) for n in sorted(parents, reverse=True) if not parents[n]]
    while stack:
        name, done = stack.pop()
        if done:
            last[name] = len(numbers) - 1
        elif name not in numbers:  # else it stands below another parent
            numbers[name] = len(numbers)
            stack.append((name, True))
            stack += [(c, False) for c in reversed(children[name]) if c not in numbers]
    ranges: dict[str, tuple[tuple[int, int], ...]] = {}
    open_: set[str] = set()
    for top in parents:
        walk = [(top, False)]
        while walk:
            name, done = walk.pop()
            if done:
                open_.discard(name)
                ranges[name] = _joined([(numbers[name], last[name]), *(r for c in children[name] for r in ranges[c])])
            elif name not in ranges:
                if name in open_ or name not in numbers:
                    raise ValueError(f"{name} is below itself")
                open_.add(name)
                walk.append((name, True))
                if any(c in open_ for c in children[name]):
                    raise ValueError(f"{name} is below itself")
                walk += [(c, False) for c in children[name] if c not in ranges]
    return Hierarchy(numbers, ranges)
