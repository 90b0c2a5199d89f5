"""Graph filters.

Edges carry ``id, subject, predicate, object``; attributes are long: ``attrs(id, name, value)`` with
numbers as doubles.  A filter drops edges, and with ``connected`` their end nodes and what hangs on them.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexus.functions.order import ordered
from plexus.sources.lens import PropertyGraph

#: Attributes for which small values are the good ones.
LOW_IS_GOOD = ("ngd", "normalized_google_distance", "chi_square", "fisher_exact", "fisher_exact_test_p-value")


def drop_edges(graph: PropertyGraph, bad: DataFrame, connected: bool = False) -> PropertyGraph:
    """The graph without the edges ``bad(id)``; ``connected`` also drops their ends and all edges there."""
    edges = graph.edges.join(bad.select("id").distinct(), "id", "left_anti")
    if not connected:
        return PropertyGraph(graph.nodes, edges)
    ends = graph.edges.join(bad.select("id").distinct(), "id", "left_semi")
    ends = ends.select(F.explode(F.array("subject", "object")).alias("node")).distinct()
    for end in ("subject", "object"):
        edges = edges.join(ends.select(F.col("node").alias(end)), end, "left_anti")
    return PropertyGraph(graph.nodes.join(ends.select(F.col("node").alias("id")), "id", "left_anti"), edges)


def strip_tags(edges: DataFrame, bad: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``bad(id)`` edges lose the given query-edge tags; an edge goes when its last tag does; untagged edges stay."""
    tags = F.array(*[F.lit(k) for k in keys])
    e = edges.join(bad.select("id", F.lit(True).alias("__bad")).distinct(), "id", "left")
    left = F.when(F.col("__bad"), F.array_except("qedge_keys", tags)).otherwise(F.col("qedge_keys"))
    e = e.withColumn("__left", left).where((F.size("__left") > 0) | (F.size("qedge_keys") == 0))
    return e.withColumn("qedge_keys", F.col("__left")).drop("__left", "__bad")


def by_predicate(edges: DataFrame, predicate: str) -> DataFrame:
    """ids of edges with the predicate."""
    return edges.where(F.col("predicate") == predicate).select("id")


#: Names of provenance that mean one another.
PROVENANCE = (
    "knowledge_source", "primary_knowledge_source", "original_knowledge_source", "aggregator_knowledge_source",
    "supporting_data_source", "original_source", "provided_by",
)


def _named(attrs: DataFrame, name: str) -> DataFrame:
    """Attributes by their name or, where there is one, by their type id."""
    hit = F.col("name") == name
    return attrs.where(hit | (F.col("type_id") == name) if "type_id" in attrs.columns else hit)


def by_continuous(attrs: DataFrame, name: str, direction: str, threshold: float) -> DataFrame:
    """ids with a value strictly above or below the threshold; attributes count by name or type id."""
    value = F.col("value")
    return _named(attrs, name).where((value > threshold) if direction == "above" else (value < threshold)).select("id").distinct()


def by_discrete(edges: DataFrame, column: str, value: str, attrs: DataFrame | None = None, sources: DataFrame | None = None) -> DataFrame:
    """ids whose field equals the value, or whose list field contains it.

    The field may be a column of ``edges`` or the name or type id of a text attribute ``attrs(id, name, type_id, value)``.
    The names in ``PROVENANCE`` stand for one another, and for the resource ids ``sources(id, resource_id)``.
    """
    found = []
    if column in edges.columns:
        listed = edges.schema[column].dataType.typeName() == "array"
        found.append(edges.where(F.array_contains(column, value) if listed else F.col(column) == value).select("id"))
    names = PROVENANCE if column in PROVENANCE else (column,)
    if attrs is not None:
        found.append(attrs.where((F.col("value") == value) & (F.col("name").isin(*names) | F.col("type_id").isin(*names))).select("id"))
    if sources is not None and column in PROVENANCE:
        found.append(sources.where(F.col("resource_id") == value).select("id"))
    if not found:
        return edges.select("id").limit(0)
    return reduce(lambda a, b: a.union(b), found).distinct()


def _beyond(attrs: DataFrame, name: str, limit: DataFrame, direction: str) -> DataFrame:
    v = attrs.where(F.col("name") == name).join(F.broadcast(limit))  # one row
    return v.where((F.col("value") > F.col("limit")) if direction == "above" else (F.col("value") < F.col("limit"))).select("id").distinct()


def defaults(name: str) -> tuple[str, bool]:
    """(direction, top) of the statistical filters for an attribute."""
    return ("above", False) if name in LOW_IS_GOOD else ("below", True)


def by_std_dev(attrs: DataFrame, name: str, threshold: float = 1.0, direction: str | None = None, top: bool | None = None) -> DataFrame:
    """ids beyond mean plus (top) or minus ``threshold`` population standard deviations."""
    base = defaults(name)
    direction, top = direction or base[0], base[1] if top is None else top
    sign = threshold if top else -threshold
    limit = attrs.where(F.col("name") == name).agg((F.avg("value") + sign * F.stddev_pop("value")).alias("limit"))
    return _beyond(attrs, name, limit, direction)


def by_percentile(attrs: DataFrame, name: str, threshold: float | None = None, direction: str | None = None, top: bool | None = None) -> DataFrame:
    """ids beyond the exact, linearly interpolated percentile.

    Default: 95, or 5 for attributes whose small values are good.  The two values around the percentile are
    read off a global range sort.
    """
    base = defaults(name)
    direction, top = direction or base[0], base[1] if top is None else top
    if threshold is None:
        threshold = 95.0 if top else 5.0
    values = attrs.where((F.col("name") == name) & F.col("value").isNotNull()).select(F.col("value").cast("double").alias("value"))
    at = ordered(values, ["value"])
    place = at.agg(((F.count(F.lit(1)) - 1) * (threshold / 100.0)).alias("place"))
    near = at.join(F.broadcast(place)).where("__ix in (floor(place), ceil(place))")  # one row
    limit = near.agg(F.min("value").alias("low"), F.max("value").alias("high"), F.max(F.col("place") - F.floor("place")).alias("part"))
    return _beyond(attrs, name, limit.select((F.col("low") + (F.col("high") - F.col("low")) * F.col("part")).alias("limit")), direction)


def by_top_n(attrs: DataFrame, name: str, n: int = 50, top: bool | None = None) -> DataFrame:
    """ids outside the first ``n`` by value (least first, or largest first if ``top``), ties by id.

    The kept side is a TakeOrdered of n rows; no global sort.
    """
    top = defaults(name)[1] if top is None else top
    mine = attrs.where(F.col("name") == name)
    kept = mine.orderBy(F.desc("value") if top else F.asc("value"), "id").limit(n).select("id")
    return mine.select("id").distinct().join(kept, "id", "left_anti")


def drop_nodes(graph: PropertyGraph, bad: DataFrame) -> PropertyGraph:
    """The graph without ``bad(id)`` nodes and their edges."""
    bad = bad.select("id").distinct()
    edges = graph.edges
    for end in ("subject", "object"):
        edges = edges.join(bad.select(F.col("id").alias(end)), end, "left_anti")
    return PropertyGraph(graph.nodes.join(bad, "id", "left_anti"), edges)


def nodes_by_category(nodes: DataFrame, category: str) -> DataFrame:
    """F7."""
    return nodes.where(F.array_contains("categories", category)).select("id")


def nodes_by_property(nodes: DataFrame, column: str, value: str) -> DataFrame:
    """F8."""
    return by_discrete(nodes, column, value)


def remove_orphans(graph: PropertyGraph, keep: DataFrame | None = None, category: str | None = None) -> PropertyGraph:
    """nodes without edges go, except ``keep(id)``; with a category, only its nodes."""
    touched = graph.edges.select(F.explode(F.array("subject", "object")).alias("id"))
    if keep is not None:
        touched = touched.union(keep.select("id"))
    if category is None:  # a semi-join needs no distinct ids, and sorted rows no table of them
        return PropertyGraph(graph.nodes.join(touched.hint("merge"), "id", "left_semi"), graph.edges)
    orphans = nodes_by_category(graph.nodes.join(touched, "id", "left_anti"), category)
    return PropertyGraph(graph.nodes.join(orphans, "id", "left_anti"), graph.edges)


def general_concepts(nodes: DataFrame, ids: Sequence[str] = (), names: Sequence[str] = (), patterns: Sequence[str] = ()) -> DataFrame:
    """ids of nodes with a blocked equivalent id, or a blocked name or synonym or one that a pattern fits at its start.

    ``nodes(id, name, equivalent_ids, synonyms)``; case is ignored.  Nodes with neither list (null) are not judged.
    """
    low = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), F.lower)
    called = F.concat(low(F.col("synonyms")), F.filter(F.array(F.lower("name")), lambda x: x.isNotNull()))
    blocked = lambda xs: F.array(*[F.lit(x.lower()) for x in xs]).cast("array<string>")
    hit = F.arrays_overlap(low(F.col("equivalent_ids")), blocked(ids)) | F.arrays_overlap(called, blocked(names))
    if patterns:
        fits = "|".join(f"(?:{p})" for p in patterns)
        hit = hit | F.exists(called, lambda x: x.rlike(f"(?i)^(?:{fits})"))
    return nodes.where("equivalent_ids is not null or synonyms is not null").where(hit).select("id")


def remove_general_concepts(graph: PropertyGraph, ids: Sequence[str] = (), names: Sequence[str] = (), patterns: Sequence[str] = ()) -> PropertyGraph:
    """the graph without general concepts, their edges, and all nodes that are then without an edge."""
    return remove_orphans(drop_nodes(graph, general_concepts(graph.nodes, ids, names, patterns)))
