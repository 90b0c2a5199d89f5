"""Joins around cycles (R3): one query node at a time, each row by its shortest list of neighbours.

Joining a cycle pair by pair makes all open paths first, far more than there are cycles where nodes of many
links meet.  Here a row takes the candidates for the next query node from that one of its bound neighbours
that has fewest, and checks them against the others with semi-joins.  So light and heavy nodes are
told apart for every row, no step makes more rows than the product bound of the pattern, and
nothing is made from a heavy node where a light one is beside it.  Where no node of a bound neighbour has more than ``FEW``
links, all rows grow from there and none are counted.  A query node beside two bound ones closes a cycle through
others: where fewer nodes lie between its neighbours than the rows would grow to, these pairs are made first and the rows meet them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Linked node pairs of two query nodes: ``links[a, b]`` has the columns a and b.
Links = dict[tuple[str, str], DataFrame]
#: A node of so many links is light without a look at its other end.
FEW = 32


def _between(links: Links, a: str, b: str) -> DataFrame | None:
    return links.get((a, b), links.get((b, a)))


def _most(links: Links, q: str, near: list[str]) -> dict[str, int]:
    """The most nodes of ``q`` that one node of each of ``near`` is linked with."""
    rows = None
    for u in near:
        one = _between(links, q, u).groupBy(u).agg(F.count(F.lit(1)).alias("n")).agg(F.lit(u).alias("u"), F.max("n").alias("n"))
        rows = one if rows is None else rows.union(one)
    return {r["u"]: r["n"] or 0 for r in rows.collect()}  # one row per link


def _closed(rows: DataFrame, links: Links, q: str, near: list[str]) -> DataFrame | None:
    """``(u, v, q)`` of two neighbours with the nodes between them, if those are fewer than rows grown from the lighter one."""
    u, v = near
    sides = [_between(links, q, x) for x in near]
    degree = [side.groupBy(q).agg(F.count(F.lit(1)).alias(f"n_{x}")) for x, side in zip(near, sides)]
    between = degree[0].join(degree[1], q).agg(F.sum(F.col(f"n_{u}") * F.col(f"n_{v}")).alias("n")).first()["n"] or 0
    mean = min(side.count() / max(side.select(x).distinct().count(), 1) for x, side in zip(near, sides))
    if between >= rows.count() * mean:
        return None
    return sides[0].join(sides[1], q).select(u, v, q)


def bind(order: list[str], links: Links) -> DataFrame:
    """All rows of nodes, a column per query node of ``order``, that are linked by every pair table of ``links``.

    Every query node but the first must be linked to one before it.
    """
    rows, bound = None, [order[0]]
    for q in order[1:]:
        near = [u for u in bound if _between(links, q, u) is not None]
        if rows is None:
            rows = _between(links, q, near[0]).select(near[0], q)
        elif len(near) == 1:
            rows = rows.join(_between(links, q, near[0]), near[0]).select(*bound, q)
        elif len(near) == 2 < len(bound) and (pairs := _closed(rows, links, q, near)) is not None:
            rows = rows.join(pairs, near).select(*bound, q)
        elif min((most := _most(links, q, near)).values()) <= FEW:
            u = min(near, key=lambda u: most[u])
            rows = rows.join(_between(links, q, u), u).select(*bound, q)
            for other in near:
                if other != u:
                    rows = rows.join(_between(links, q, other), [other, q], "left_semi").select(*bound, q)
        else:
            counted = rows
            for u in near:
                size = _between(links, q, u).groupBy(u).agg(F.count(F.lit(1)).alias(f"__n_{u}"))
                counted = counted.join(size, u)  # a node without a neighbour is on no cycle
            least = F.least(*[F.col(f"__n_{u}") for u in near])
            first = F.coalesce(*[F.when(F.col(f"__n_{u}") == least, F.lit(u)) for u in near])
            counted = counted.select(*bound, first.alias("__by"))
            grown = None
            for u in near:
                part = counted.where(F.col("__by") == u).join(_between(links, q, u), u).select(*bound, q)
                for other in near:
                    if other != u:
                        part = part.join(_between(links, q, other), [other, q], "left_semi").select(*bound, q)
                grown = part if grown is None else grown.union(part)
            rows = grown
        bound.append(q)
    return rows
