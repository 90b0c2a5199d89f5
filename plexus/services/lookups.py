"""Lookups over the built tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plexus.functions.text import alnum, name_tokens
from plexus.plans.pattern import Pattern
from plexus.sources.lens import PropertyGraph


def meta_graph(graph: PropertyGraph) -> DataFrame:
    """V7: the distinct ``(source, subject_category, predicate, object_category)`` of a graph."""
    kind = graph.nodes.select("id", F.get("categories", F.lit(0)).alias("category"))
    e = graph.edges.select("source", "subject", "predicate", "object")
    for end in ("subject", "object"):
        e = e.join(kind.select(F.col("id").alias(end), F.col("category").alias(f"{end}_category")), end)
    return e.select("source", "subject_category", "predicate", "object_category").distinct()


def canonical(terms: DataFrame, clusters: DataFrame) -> DataFrame:
    """V1: ``terms(term)`` with preferred id, name and category, by id or else by name; unknown gives null.

    ``clusters(cluster_id, name, category, member_id, member_name)``; a name held by several clusters takes
    the largest cluster, then the least id.
    """
    by_id = clusters.select(F.col("member_id").alias("term"), "cluster_id", "name", "category").distinct()
    size = clusters.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    named = clusters.join(size, "cluster_id").groupBy(F.lower("member_name").alias("key"))
    best = F.min(F.struct((-F.col("n")).alias("n"), "cluster_id", "name", "category"))
    by_name = named.agg(best.alias("b")).select("key", *[F.col(f"b.{c}").alias(f"__{c}") for c in ("cluster_id", "name", "category")])
    out = terms.join(by_id, "term", "left").join(by_name, F.lower("term") == F.col("key"), "left")
    return out.select("term", *[F.coalesce(c, f"__{c}").alias(c) for c in ("cluster_id", "name", "category")])


def all_categories(terms: DataFrame, clusters: DataFrame, of: DataFrame) -> DataFrame:
    """V1: ``canonical`` with every category of the cluster's members and how many have it: ``of(member_id, category)``.

    ``categories`` is a map from category to count; unknown terms have an empty one.
    """
    counts = clusters.select("cluster_id", "member_id").distinct().join(of.distinct(), "member_id").groupBy("cluster_id", "category").agg(F.count(F.lit(1)).alias("n"))
    maps = counts.groupBy("cluster_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("categories"))
    empty = F.map_from_entries(F.array().cast("array<struct<category:string,n:bigint>>"))
    return canonical(terms, clusters).join(maps, "cluster_id", "left").withColumn("categories", F.coalesce("categories", empty))


def equivalents(ids: DataFrame, clusters: DataFrame, separator: str | None = None) -> DataFrame:
    """V2: ``(id, equivalents)``: all members of the id's cluster, sorted; as one text with a ``separator``.

    A member list is made once per cluster and joined to its ids.  Ids of several clusters get the union.
    """
    of = clusters.select(F.col("member_id").alias("id"), "cluster_id").distinct()
    several = of.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")
    lists = of.groupBy("cluster_id").agg(F.array_sort(F.collect_set("id")).alias("equivalents"))
    text = (lambda c: c) if separator is None else (lambda c: F.array_join(c, separator))
    of = of.join(ids, "id", "left_semi")
    once = of.join(several, "id", "left_anti").join(lists.withColumn("equivalents", text(F.col("equivalents"))), "cluster_id").select("id", "equivalents")
    union = F.array_sort(F.array_distinct(F.flatten(F.collect_list("equivalents"))))
    more = of.join(several, "id", "left_semi").join(lists, "cluster_id").groupBy("id").agg(text(union).alias("equivalents"))
    return once.union(more)


def deepest_category(categories: DataFrame, ontology: DataFrame) -> DataFrame:
    """V2: ``(id, category)``: the most specific of an id's categories ``(id, category)``, least name on ties."""
    depth = ontology.groupBy(F.col("child").alias("category")).agg(F.max("depth").alias("depth"))
    joined = categories.join(depth, "category")
    return joined.groupBy("id").agg(F.min(F.struct((-F.col("depth")).alias("d"), "category")).alias("b")).select("id", "b.category")


def names_match(a: Column, b: Column) -> Column:
    """V3: equal alphanumeric forms; or the shorter inside the longer at 60 % of its length; or over half the tokens shared."""
    x, y = alnum(a), alnum(b)
    short, long = F.when(F.length(x) <= F.length(y), x).otherwise(y), F.when(F.length(x) <= F.length(y), y).otherwise(x)
    inside = long.contains(short) & (F.length(short) / F.length(long) >= 0.6)
    s, t = name_tokens(a), name_tokens(b)
    shared = F.size(F.filter(s, lambda p: F.exists(t, lambda q: (p == q) | F.startswith(p, q) | F.startswith(q, p))))
    overlap = shared / F.greatest(F.size(s), F.size(t)) > 0.5
    return F.coalesce((F.length(x) > 0) & (F.length(y) > 0) & ((x == y) | inside | overlap), F.lit(False))


def complete(terms: DataFrame, word: str, limit: int) -> DataFrame:
    """V4: terms that start with ``word``, by length and name, then those that contain it; at least two letters."""
    low = F.lower("term")
    if len(word) < 2:
        return terms.select("term", F.lit(0).cast("long").alias("rank")).limit(0)
    once = terms.where(low.contains(word.lower())).groupBy(low.alias("low")).agg(F.min("term").alias("term"))
    kind = F.when(F.startswith("low", F.lit(word.lower())), 0).otherwise(1)
    top = once.withColumn("kind", kind).orderBy("kind", F.length("term"), "term").limit(limit)
    return top.select("term", "kind", F.length("term").alias("length"))


def cache_key(columns: list[str]) -> Column:
    """V5: SHA-256 of a row's JSON with keys in order."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)])), 256)


def denied_clients(ongoing: DataFrame, limit: int = 10) -> DataFrame:
    """V6: clients with more ongoing queries than allowed: ``(client, n)``."""
    return ongoing.groupBy("client").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit)


def recent_queries(tracked: DataFrame, hours: float) -> DataFrame:
    """V6: per status, the queries of the last ``hours`` before the newest: ``(status, n, longest_s)``."""
    newest = tracked.agg(F.max("started").alias("newest"))
    recent = tracked.join(F.broadcast(newest)).where(F.unix_seconds(F.col("newest").cast("timestamp")) - F.unix_seconds(F.col("started").cast("timestamp")) <= hours * 3600)  # one row
    return recent.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.max("elapsed").alias("longest_s"))


def provenance(edges: DataFrame) -> DataFrame:
    """V8: edge counts per predicate and source, with a bucket for edges without one, and the predicate's total."""
    source = F.coalesce("source", F.lit("no provenance"))
    per = edges.groupBy("predicate", source.alias("provided_by")).agg(F.count(F.lit(1)).alias("n"))
    total = per.groupBy("predicate").agg(F.sum("n").alias("n_predicate"), F.count(F.lit(1)).alias("n_sources"))
    return per.join(total, "predicate")


def expansive_categories(categories: DataFrame, ontology: DataFrame, conflated: DataFrame, root: str) -> DataFrame:
    """Each category with its conflations, the ancestors below the root, and their conflations."""
    both = conflated.union(conflated.select("b", "a")).toDF("category", "other")
    up = categories.join(ontology.select(F.col("child").alias("category"), "ancestor"), "category").where(F.col("ancestor") != root)
    base = up.select("category", F.col("ancestor").alias("expanded"))
    more = base.join(both.select(F.col("category").alias("expanded"), "other"), "expanded").select("category", F.col("other").alias("expanded"))
    return base.union(more).distinct()


def untagged(kg_nodes: DataFrame, kg_edges: DataFrame) -> DataFrame:
    """V9: ``(what, n)``: nodes and edges without a key of the pattern."""
    empty = lambda c: F.col(c).isNull() | (F.size(c) == 0)
    return kg_nodes.where(empty("qnode_keys")).agg(F.lit("nodes").alias("what"), F.count(F.lit(1)).alias("n")).union(
        kg_edges.where(empty("qedge_keys")).agg(F.lit("edges").alias("what"), F.count(F.lit(1)).alias("n")))


def infer_tags(pattern: Pattern, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """V9: ``kg_nodes(qnode_key, node_id)`` and ``kg_edges(qedge_key, id, subject, object)`` of a graph without tags.

    A node fits a query node by its id, or else by a category; a query node that names neither takes every node.  An
    edge fits a query edge by its predicate, if one is named, and by the tags of its ends, in either direction.
    """
    tags = []
    for n in pattern.nodes:
        fits = F.col("id").isin(list(n.ids)) if n.ids else F.arrays_overlap("categories", F.array(*[F.lit(c) for c in n.categories])) if n.categories else F.lit(True)
        tags.append(F.when(fits, F.lit(n.key)))
    kg_nodes = nodes.select(F.explode(F.filter(F.array(*tags), lambda x: x.isNotNull())).alias("qnode_key"), F.col("id").alias("node_id"))
    keys = kg_nodes.groupBy("node_id").agg(F.collect_set("qnode_key").alias("keys"))
    e = edges.join(keys.toDF("subject", "__s"), "subject").join(keys.toDF("object", "__o"), "object")
    tags = []
    for q in pattern.edges:
        both = lambda a, b: F.array_contains("__s", a) & F.array_contains("__o", b)
        fits = both(q.subject, q.object) | both(q.object, q.subject)
        tags.append(F.when(fits & (F.col("predicate").isin(list(q.predicates)) if q.predicates else F.lit(True)), F.lit(q.key)))
    return kg_nodes, e.select(F.explode(F.filter(F.array(*tags), lambda x: x.isNotNull())).alias("qedge_key"), "id", "subject", "object")
