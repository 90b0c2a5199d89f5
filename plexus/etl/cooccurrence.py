"""Concept to document indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexus.functions.text import clean_concept


def name_index(staged: DataFrame) -> DataFrame:
    """``staged(name, doc)`` as ``(concept_name, docs)``: cleaned names that differ in case or marks fold to one."""
    named = staged.select(clean_concept(F.col("name")).alias("name"), "doc").where("name is not null").distinct()
    key = F.regexp_replace(F.lower("name"), "[^a-z0-9]", "")
    grouped = named.withColumn("key", key).groupBy("key")
    return grouped.agg(F.min("name").alias("concept_name"), F.array_sort(F.collect_set("doc")).alias("docs")).drop("key")


def harvested(edges: DataFrame, prefix: str = "PMID:") -> DataFrame:
    """``(concept, doc)`` for both ends of edges with publications of the prefix and digits."""
    e = edges.select(F.explode(F.array("subject", "object")).alias("concept"), F.explode("publications").alias("p"))
    return e.where(F.col("p").rlike(f"^{prefix}[0-9]+$")).select("concept", F.substring("p", len(prefix) + 1, 30).cast("long").alias("doc")).distinct()


def concept_index(names: DataFrame, resolved: DataFrame, edge_docs: DataFrame) -> DataFrame:
    """``(concept, docs)`` from resolved names ``(concept_name, concept)`` and documents of edges."""
    by_name = names.join(resolved, "concept_name").select("concept", F.explode("docs").alias("doc"))
    return by_name.union(edge_docs).groupBy("concept").agg(F.array_sort(F.collect_set("doc")).alias("docs"))
