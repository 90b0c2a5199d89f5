"""Connected components as joins and combinable aggregations."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexus.sources.scratch import saved

#: A node with more links than one in ``HUB_SHARE`` of them all, and than ``HUB``, is a hub: there are at most 20 000.
HUB, HUB_SHARE = 256, 10_000
#: Tables of up to so many links, and so many bytes of their ends, settle in a task.
LOCAL, LOCAL_BYTES = 100_000, 16 << 20


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node with the smallest of its component, by union-find over all links of the task."""
    up: dict = {}

    def find(x):
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            up.setdefault(a, a)
            up.setdefault(b, b)
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    if up:
        yield pa.RecordBatch.from_arrays([pa.array(list(up), kind), pa.array([find(x) for x in up], kind)], names=["node", "component"])


def _joined(edges: DataFrame, least: DataFrame, key: str, hub: int | None) -> DataFrame:
    """``edges`` with ``m`` of ``least(key, m, n)``; keys of over ``hub`` rows, of a bounded number, meet by broadcast, not in one task."""
    if hub is None:
        return edges.join(least.drop("n"), key)
    hubs = F.broadcast(least.where(F.col("n") > hub).select(F.col(key).alias("__hub"), F.col("m").alias("__m")))
    one = edges.join(hubs, F.col(key) == F.col("__hub"), "left")
    rest = one.where("__hub is null").drop("__hub", "__m").join(least.drop("n"), key)
    return one.where("__hub is not null").select(*edges.columns, F.col("__m").alias("m")).unionByName(rest.select(*edges.columns, "m"))


def _fits(links: DataFrame, kind: str) -> bool:
    """Is the written table ``links(a, b)`` small enough for a task?"""
    if links.count() > LOCAL:
        return False
    return kind != "binary" or (links.agg(F.sum(F.octet_length("a") + F.octet_length("b")).alias("n")).first()["n"] or 0) <= LOCAL_BYTES


def components(edges: DataFrame, native: bool = False) -> DataFrame:
    """Connected components of undirected ``edges(a, b)`` as ``(node, component)``.

    The component is its smallest node.  A written table of at most ``LOCAL`` links of whole numbers or strings
    settles in a task.  Else large-star and small-star steps alternate until the edge set
    is a forest of stars; each round is a few combinable minimum aggregations and equi-joins, cut to
    a table.  Nodes without an edge to another node are not returned; null ends are ignored.
    ``native``: DataFrame operations alone, so tables of any size take the rounds.
    """
    kind = edges.schema[edges.columns[0]].dataType
    edges = edges.toDF("a", "b").where("a <> b")
    now = saved(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    plain = {"bigint": "bigint", "int": "int", "string": "binary"}.get(now.schema["a"].dataType.simpleString())
    if plain and not native and _fits(now, plain):
        ends = now.select(F.col("a").cast(plain), F.col("b").cast(plain)).coalesce(1)
        found = ends.mapInArrow(_settled, f"node {plain}, component {plain}")
        return found.select(F.col("node").cast(kind), F.col("component").cast(kind))
    count = F.count(F.lit(1)).alias("n")
    for _ in range(60):
        ends = now.select(F.col("a").alias("u"), F.lit(1).alias("up"), F.lit(0).alias("down"))
        ends = ends.union(now.select("b", F.lit(0), F.lit(1))).groupBy("u").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
        state = ends.agg(F.count_if(F.expr("up > 1 or up > 0 and down > 0")).alias("bad"), F.max(F.col("up") + F.col("down")).alias("top"), F.sum("up").alias("n")).first()
        if not state["bad"]:  # every node has one smaller neighbour, or none
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                now.select("b", "b").distinct()
            ).select(F.col("node").cast(kind), F.col("component").cast(kind))
        hub = max(HUB, state["n"] // HUB_SHARE)
        hub = hub if state["top"] > hub else None
        both = now.union(now.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m"), count).select("u", F.least("u", "m").alias("m"), "n")
        large = _joined(both, least, "u", hub).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = saved(large.where("a <> b").distinct())
        root = large.groupBy("a").agg(F.min("b").alias("m"), count)
        small_star = _joined(large, root, "a", hub).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        now = saved(small_star.union(root.select("a", "m")).toDF("a", "b").distinct())
    raise RuntimeError("connected components did not settle")
