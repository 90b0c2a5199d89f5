"""Canonical graphs from raw ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plexus.functions.order import ordered
from plexus.sources.scratch import saved


def union_sets(column: str) -> Column:
    """All elements of an array column over a group, distinct and sorted; equal arrays are held once."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(column))))


def canonicalize_nodes(nodes: DataFrame, mapping: DataFrame) -> DataFrame:
    """Raw ``nodes(id, name, categories, description, publications, iri)`` by ``mapping(id, canonical_id)``.

    Names are the canonical node's own or else the least; the description is the longest under 10 000
    characters (least on ties); the iri is the canonical node's.
    """
    rows = nodes.join(mapping, "id", "left").withColumn("cid", F.coalesce("canonical_id", "id"))
    own = F.col("id") == F.col("cid")
    best = F.when(F.length("description") < 10_000, F.struct(F.length("description").alias("n"), (-F.xxhash64("description")).alias("h"), "description"))
    return rows.groupBy(F.col("cid").alias("id")).agg(
        F.coalesce(F.max(F.when(own, F.col("name"))), F.min("name")).alias("name"),
        union_sets("categories").alias("categories"), F.max(best)["description"].alias("description"),
        union_sets("publications").alias("publications"), F.max(F.when(own, F.col("iri"))).alias("iri"),
        F.array_sort(F.collect_set("id")).alias("equivalent_ids"))


#: What tells canonical edges apart (B2); columns that a table lacks count as empty.
EDGE_KEY = ("subject", "predicate", "qualified_predicate", "qualified_object_aspect", "qualified_object_direction", "object", "source")


def canonicalize_edges(edges: DataFrame, mapping: DataFrame, dropped: Column | None = None, most_publications: int = 20) -> DataFrame:
    """B2: ends remapped, self edges and ``dropped`` ones gone, edges equal in ``EDGE_KEY`` merged.

    ``publications`` are the first ``most_publications`` of all; so is the map ``publications_info``, where there
    is one (of several entries of a publication the one of the greatest raw id).  Edges that regulate in a direction
    without a qualified predicate get ``causes`` and ``activity_or_abundance``; applied_to_treat edges of chembl go.
    """
    e = edges
    for end in ("subject", "object"):
        m = mapping.select(F.col("id").alias(end), F.col("canonical_id").alias("__c"))
        e = e.join(m, end, "left").withColumn(end, F.coalesce("__c", end)).drop("__c")
    e = e.where("subject <> object")
    e = e.where(~dropped) if dropped is not None else e
    for c in EDGE_KEY:
        e = e.withColumn(c, F.coalesce(F.col(c).cast("string"), F.lit("")) if c in e.columns else F.lit(""))
    e = e.where("not (predicate = 'applied_to_treat' and source = 'chembl')")
    patch = (F.col("predicate") == "regulates") & (F.col("qualified_object_direction") != "") & (F.col("qualified_predicate") == "")
    e = e.withColumns({
        "qualified_predicate": F.when(patch, "causes").otherwise(F.col("qualified_predicate")),
        "qualified_object_aspect": F.when(patch, "activity_or_abundance").otherwise(F.col("qualified_object_aspect"))})
    e = e.withColumn("__key", F.concat_ws("--", *EDGE_KEY))
    merged = e.groupBy("__key", *EDGE_KEY).agg(F.array_sort(F.collect_set("id")).alias("raw_ids"), F.count(F.lit(1)).alias("n_raw"))
    pubs = e.select("__key", F.explode("publications").alias("p")).distinct()
    merged = merged.join(pubs.groupBy("__key").agg(F.slice(F.array_sort(F.collect_list("p")), 1, most_publications).alias("publications")), "__key", "left")
    merged = merged.withColumn("publications", F.coalesce("publications", F.array().cast("array<string>")))
    if "publications_info" in edges.columns:
        info = e.select("__key", "id", F.explode("publications_info").alias("p", "i")).groupBy("__key", "p").agg(F.max_by("i", "id").alias("i"))
        info = info.groupBy("__key").agg(F.map_from_entries(F.slice(F.array_sort(F.collect_list(F.struct("p", "i"))), 1, most_publications)).alias("publications_info"))
        merged = merged.join(info, "__key", "left")
    return merged.withColumnRenamed("__key", "id")


def number_edges(edges: DataFrame) -> DataFrame:
    """``edges`` with ``number``, 1 and up in the order of their ids, by a global range sort."""
    return ordered(edges, ["id"]).withColumn("number", F.col("__ix") + 1).drop("__ix")


def remove_general(nodes: DataFrame, edges: DataFrame, blocked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with an equivalent id in ``blocked(id)`` go, then edges without both ends."""
    bad = nodes.select("id", F.explode("equivalent_ids").alias("eq")).join(blocked.select(F.col("id").alias("eq")), "eq", "left_semi")
    kept = nodes.join(bad.select("id").distinct(), "id", "left_anti")
    for end in ("subject", "object"):
        edges = edges.join(kept.select(F.col("id").alias(end)), end, "left_semi")
    return kept, edges


#: Nodes whose labels one task holds.
HELD = 100_000


def labels(nodes: DataFrame, ontology: DataFrame) -> DataFrame:
    """``(id, label)``: each node's categories with all their ancestors.

    All rows of a node meet before they are opened, in partitions of about ``HELD`` nodes, so what a task holds does not grow.
    """
    rows = nodes.select("id", "categories").repartition(nodes.count() // HELD + 1, "id")
    c = rows.select("id", F.explode("categories").alias("child")).join(F.broadcast(ontology.select("child", "ancestor")), "child")  # a literal list
    return c.select("id", F.col("ancestor").alias("label")).distinct()


def neighbour_counts(nodes: DataFrame, edges: DataFrame, ontology: DataFrame) -> DataFrame:
    """``(id, label, n)``: distinct neighbours by ancestor label, both directions.

    Pairs are told apart, and labels counted, in partitions of about ``HELD`` rows, without a table before the shuffle.
    """
    edges = saved(edges.select("subject", "object"))
    parts = 2 * edges.count() // HELD + 1
    both = edges.union(edges.select("object", "subject")).toDF("id", "near").repartition(parts, "near").distinct()
    near = labels(nodes, ontology).groupBy("id").agg(F.collect_list("label").alias("labels")).withColumnRenamed("id", "near")
    met = both.join(near, "near").select("id", "labels").repartition(parts, "id")
    return met.select("id", F.explode("labels").alias("label")).groupBy("id", "label").agg(F.count(F.lit(1)).alias("n"))


def top_by_degree(edges: DataFrame, most: int = 1_000_000) -> DataFrame:
    """The nodes with most edges."""
    ends = edges.select(F.explode(F.array("subject", "object")).alias("id"))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree")).orderBy(F.desc("degree"), "id").limit(most)


def category_counts(nodes: DataFrame, ontology: DataFrame) -> DataFrame:
    """Nodes per ancestor label."""
    return labels(nodes, ontology).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def marked_neighbours(edges: DataFrame, marker: str) -> DataFrame:
    """Ids next to a marker node."""
    one = edges.where(F.col("object") == marker).select(F.col("subject").alias("id"))
    return one.union(edges.where(F.col("subject") == marker).select(F.col("object").alias("id"))).distinct()


def lite(df: DataFrame, columns: Sequence[str], separator: str = ";") -> DataFrame:
    """A narrow projection with arrays as delimited text."""
    kinds = dict(df.dtypes)
    return df.select(*[F.array_join(c, separator).alias(c) if kinds[c].startswith("array") else F.col(c) for c in columns])


def subclass_extract(edges: DataFrame, mapping: DataFrame, predicate: str = "part_of") -> DataFrame:
    """Subclass edges between canonical ids, ``(child, parent)``."""
    return canonicalize_edges(edges.where(F.col("predicate") == predicate), mapping).select(F.col("subject").alias("child"), F.col("object").alias("parent")).distinct()


def neighbour_table(edges: DataFrame, hubs: DataFrame) -> DataFrame:
    """One row per hub ``(id)`` and neighbour."""
    both = edges.select("subject", "object").union(edges.select("object", "subject")).toDF("id", "neighbour").distinct()
    return both.join(hubs.select("id"), "id", "left_semi")
