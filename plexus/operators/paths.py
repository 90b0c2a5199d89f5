"""Bounded paths between pinned nodes, and support graphs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plexus.functions.components import components
from plexus.functions.order import ordered
from plexus.sources.scratch import saved


def connect(edges: DataFrame, start: str, end: str, max_length: int = 4, blocked: DataFrame | None = None,
            degree_limit: int | None = None, through: DataFrame | None = None) -> DataFrame:
    """Simple paths ``(path, length)`` of at most ``max_length`` (1 to 5) edges, any direction.

    Walks from both ends meet in the middle, so no walk is longer than half the way; inner nodes with more
    than ``degree_limit`` neighbours (if given) and ``blocked(id)`` nodes are not passed through.  With
    ``through(id)`` a path counts only if one of its inner nodes is among them.
    """
    if not 1 <= max_length <= 5:
        raise ValueError("max_path_length is 1 to 5")
    both = edges.select("subject", "object").union(edges.select("object", "subject")).toDF("a", "b").where("a <> b").distinct()
    closed = [] if blocked is None else [blocked.select("id")]
    if degree_limit is not None:
        closed.append(both.groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > degree_limit).select("id"))
    if closed:
        shut = saved(reduce(lambda x, y: x.union(y), closed).where(~F.col("id").isin(start, end)).distinct())
        for side in ("a", "b"):
            both = both.join(shut.select(F.col("id").alias(side)), side, "left_anti")
    both = saved(both)  # every step reads it
    spark = edges.sparkSession

    def walks(first: str, other: str, steps: int) -> list[DataFrame]:
        out = [spark.createDataFrame([([first], first)], "path array<string>, last string")]
        for _ in range(steps):
            step = out[-1].where(F.col("last") != other).join(both, F.col("last") == F.col("a"))
            step = step.where(~F.array_contains("path", F.col("b")))
            out.append(step.select(F.concat("path", F.array("b")).alias("path"), F.col("b").alias("last")))
        return out

    forth, back = walks(start, end, (max_length + 1) // 2), walks(end, start, max_length // 2)
    found = []
    for n in range(1, max_length + 1):
        left, right = forth[(n + 1) // 2], back[n // 2].select(F.col("path").alias("tail"), "last")
        met = left.join(right, "last").select("path", F.slice(F.reverse("tail"), 2, 6).alias("tail"))
        met = met.where(~F.arrays_overlap("path", "tail"))
        found.append(met.select(F.concat("path", "tail").alias("path"), F.lit(n).cast("long").alias("length")))
    out = reduce(lambda a, b: a.union(b), found)
    if through is not None:
        out = out.withColumn("__p", F.array_join("path", ">"))
        inner = out.select("__p", F.explode(F.slice("path", 2, F.greatest(F.size("path") - 2, F.lit(0)))).alias("id"))
        met = inner.join(through.select("id").distinct(), "id", "left_semi").select("__p").distinct()
        out = out.join(met, "__p", "left_semi").drop("__p")
    return out


def analyses(found: DataFrame, most: int = 500) -> DataFrame:
    """The shortest ``most`` paths, numbered: each is one analysis that binds the path."""
    top = found.withColumn("__p", F.array_join("path", ">")).orderBy("length", "__p").limit(most)
    number = F.row_number().over(Window.orderBy("length", "__p")).cast("long")  # at most ``most`` rows
    return top.withColumn("analysis", number).drop("__p").withColumn("length", F.col("length").cast("int"))


def support_graphs(virtual: DataFrame, most_named: int = 4) -> DataFrame:
    """``virtual(result_id, option_group, edge_id)`` as one aux graph per result and group: ``(result_id, option_group, edge_ids, aux_id)``.

    Graphs of up to ``most_named`` edges are named by them and shared by all results with the same; larger ones by
    the number of graphs made before them, in the order of results and groups.  A group's name ends the graph's.
    """
    rows = virtual.groupBy("result_id", "option_group").agg(F.array_sort(F.collect_set("edge_id")).alias("edge_ids"))
    rows = rows.withColumn("__none", F.col("option_group").isNotNull())
    short = F.concat(F.array_join("edge_ids", ";"), F.coalesce(F.concat(F.lit("_"), F.col("option_group")), F.lit("")))
    at = ordered(rows.withColumn("__name", F.when(F.size("edge_ids") <= most_named, short)), ["result_id", "__none", "option_group"]).withColumnRenamed("__ix", "__place")
    at = saved(at)
    first = at.where("__name is not null").groupBy("__name").agg(F.min("__place").alias("__first"))
    at = at.join(first, "__name", "left").withColumn("__new", (F.coalesce("__first", "__place") == F.col("__place")).cast("long"))
    at = ordered(at, ["__place"], "__new")
    large = F.concat_ws("_", F.col("__cum").cast("string"), "option_group")
    return at.select("result_id", "option_group", "edge_ids", F.concat(F.lit("aux_"), F.coalesce("__name", large)).alias("aux_id"))


def unbind_virtual(result_edges: DataFrame, result_nodes: DataFrame, edges: DataFrame, qedges: Sequence[str], qnodes: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Bindings of the asked pattern only: ``result_edges(result_id, qedge_key, edge_id)``, ``result_nodes(result_id, qnode_key, node_id)``.

    Virtual query edges and nodes lose their bindings, and so do nodes at no bound edge of their result.
    """
    kept = result_edges.where(F.col("qedge_key").isin(list(qedges)))
    return kept, _touched(result_nodes.where(F.col("qnode_key").isin(list(qnodes))), kept, edges)


def _touched(result_nodes: DataFrame, result_edges: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("id").alias("edge_id"), F.explode(F.array("subject", "object")).alias("node_id"))
    used = result_edges.select("result_id", "edge_id").distinct().join(ends, "edge_id").select("result_id", "node_id").distinct()
    return result_nodes.join(used, ["result_id", "node_id"], "left_semi").select(*result_nodes.columns)


#: What a row of ``_apart`` is: a link, a sign that its aux graph is there, or an asked pair.
LINK, THERE, ASKED = 0, 1, 2
#: Links that one task looks through; an aux graph of more is taken apart by joins.
LOCAL = 250_000


def _apart(rows: pd.DataFrame) -> pd.DataFrame:
    """The asked edges of ``rows(aux_id, a, b, edge_id, kind)`` whose ends the links of their aux graph, which is there, do not connect."""
    there = rows.loc[rows["kind"] != ASKED, "aux_id"].unique()
    rows = rows[(rows["kind"] != THERE) & rows["aux_id"].isin(there)]
    if not len(rows):
        return pd.DataFrame({"edge_id": rows["edge_id"]})
    graph = pd.factorize(rows["aux_id"])[0]
    ends = pd.factorize(np.concatenate([rows["a"].to_numpy(object), rows["b"].to_numpy(object)]), use_na_sentinel=False)[0]
    nodes, at = np.unique(np.concatenate([graph, graph]) * (ends.max() + 1) + ends, return_inverse=True)
    a, b = at[: len(rows)], at[len(rows):]
    asked = (rows["kind"] == ASKED).to_numpy()
    x, y, root = a[~asked], b[~asked], np.arange(len(nodes))
    while (root[x] != root[y]).any():
        low = np.minimum(root[x], root[y])
        old = root.copy()
        np.minimum.at(root, old[x], low)
        np.minimum.at(root, old[y], low)
        while (root[root] != root).any():
            root = root[root]
    return pd.DataFrame({"edge_id": rows["edge_id"].to_numpy(object)[asked & (root[a] != root[b])]})


def supported(support: DataFrame, aux: DataFrame) -> DataFrame:
    """Inferred edges ``(edge_id, aux_id, from_id, to_id)`` that no aux graph of theirs fails; one at least is there.

    ``aux(aux_id, subject, object, ngd)``.  A graph fails an edge if its ends are not connected, over any number of
    steps, without the edges of infinite distance.  Aux graphs that ``aux`` does not have are skipped, but an edge
    without an aux_id is not supported.  Aux graphs of at most ``LOCAL`` links are looked through in one task each, many
    to a task, so their links are shuffled once and written nowhere; larger ones go through the component search.
    """
    named = saved(support.where("aux_id is not null"))
    finite = F.col("ngd").isNull() | (~F.isnan("ngd") & (F.abs("ngd") != float("inf")))
    kind = named.select("edge_id").schema
    none = F.lit(None).cast(kind["edge_id"].dataType).alias("edge_id")
    links = aux.where("aux_id is not null").select("aux_id", F.when(finite, F.col("subject")).alias("a"), F.when(finite, F.col("object")).alias("b"), none, F.when(finite, LINK).otherwise(THERE).alias("kind"))
    rows = links.union(named.where("from_id <> to_id").select("aux_id", "from_id", "to_id", "edge_id", F.lit(ASKED)))
    size = rows.groupBy("aux_id").agg(F.count(F.lit(1)).alias("n"))
    total = size.agg(F.sum("n").alias("n"), F.max("n").alias("top")).first()
    bins = (total["n"] or 0) // LOCAL * 4 + 8
    light = rows
    if some := (total["top"] or 0) > LOCAL:
        heavy = saved(size.where(F.col("n") > LOCAL).select("aux_id"))
        light = rows.join(heavy, "aux_id", "left_anti")
    failed = light.groupBy(F.pmod(F.xxhash64("aux_id"), F.lit(bins)).alias("bin")).applyInPandas(_apart, kind)
    if some:
        failed = failed.union(_apart_by_joins(saved(rows.join(heavy, "aux_id", "left_semi"))))
    return named.select("edge_id").distinct().join(failed, "edge_id", "left_anti")


def _apart_by_joins(rows: DataFrame) -> DataFrame:
    """As ``_apart``, over tables."""
    node = lambda c: F.concat_ws("\u0001", "aux_id", c)
    part = saved(components(rows.where(F.col("kind") == LINK).select(node("a").alias("a"), node("b").alias("b"))))
    asked = rows.where(F.col("kind") == ASKED).join(rows.where(F.col("kind") != ASKED).select("aux_id"), "aux_id", "left_semi")
    for end in ("a", "b"):
        asked = asked.withColumn("node", node(end)).join(part, "node", "left").withColumn(f"__{end}", F.coalesce("component", "node")).drop("node", "component")
    return asked.where("__a <> __b").select("edge_id")


def creative_filter(result_edges: DataFrame, result_nodes: DataFrame, edges: DataFrame, supported_edges: DataFrame, inferred: Sequence[str], qedges: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``result_edges(result_id, qedge_key, edge_id)`` and ``result_nodes(result_id, qnode_key, node_id)`` of covered results.

    Edges bound to an ``inferred`` query edge that are not supported go from all bindings of their result; results
    that then lack an edge for one of ``qedges`` go whole; of the others, nodes at no bound edge lose their binding.
    """
    bad = result_edges.where(F.col("qedge_key").isin(list(inferred)) & F.col("edge_id").isNotNull()).join(supported_edges, "edge_id", "left_anti").select("result_id", "edge_id").distinct()
    bound = result_edges.join(edges.select(F.col("id").alias("edge_id"), "subject", "object"), "edge_id", "left")
    of = lambda df: F.struct(*[df[c] for c in df.columns])
    # one shuffle: edges with their ends, bad edges and nodes meet by result
    rows = bound.select("result_id", "edge_id", F.col("qedge_key").alias("key"), F.array("subject", "object").alias("at"), F.struct(*result_edges.columns).alias("edge"), F.lit(False).alias("bad"))
    rows = rows.unionByName(bad.select("result_id", "edge_id", F.lit(True).alias("bad")), allowMissingColumns=True)
    rows = rows.unionByName(result_nodes.where("node_id is not null").select("result_id", F.array("node_id").alias("at"), of(result_nodes).alias("node")), allowMissingColumns=True)
    rows = rows.where("result_id is not null").repartition("result_id")
    gone = F.max(F.coalesce("bad", F.lit(False))).over(Window.partitionBy("result_id", "edge_id"))
    rows = rows.withColumn("gone", gone).where("not gone")
    asked = F.collect_set(F.when(F.col("key").isin(list(qedges)), F.col("key"))).over(Window.partitionBy("result_id"))
    rows = rows.withColumn("asked", F.size(asked)).where(F.col("asked") == len(set(qedges)))
    ends = rows.select("result_id", "node", F.explode("at").alias("at")).where("at is not null")
    touched = F.max(F.col("node").isNull()).over(Window.partitionBy("result_id", "at"))
    nodes = ends.withColumn("touched", touched).where("touched and node is not null")
    return rows.where("edge is not null").select("edge.*"), nodes.select("node.*")
