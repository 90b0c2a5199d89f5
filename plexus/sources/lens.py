"""The relational test tables seen as a property graph.

``nodes(id, name, categories, prefix)`` and ``edges(id, subject, predicate, object, source, amount,
evidence)``.  Line items have no key, so their edges are groups.  All of it is lazy: a query that
touches one predicate scans one table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PropertyGraph:
    """Nodes and edges; operators take one and give a new one."""

    nodes: DataFrame
    edges: DataFrame


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def curie(prefix: str, key: str) -> Column:
    return F.concat(F.lit(prefix + ":"), F.col(key).cast("string"))


def _edges(df: DataFrame, subject: Column, predicate: str, obj: Column, source: str, amount: Column, evidence: Column):
    df = df.select(subject.alias("subject"), F.lit(predicate).alias("predicate"), obj.alias("object"),
                   F.lit(source).alias("source"), amount.cast("double").alias("amount"), evidence.cast("long").alias("evidence"))
    return df.select(F.concat_ws("--", "subject", "predicate", "object").alias("id"), "*")


def edges_of(spark: SparkSession, sf_dir: str, predicate: str) -> DataFrame:
    """The edges of one predicate."""
    t = lambda name: table(spark, sf_dir, name)
    one = F.lit(1)
    if predicate == "placed":
        return _edges(t("orders"), curie("C", "o_custkey"), predicate, curie("O", "o_orderkey"), "orders", F.col("o_totalprice"), one)
    if predicate in ("contains", "supplies"):
        key, prefix = ("l_orderkey", "O") if predicate == "contains" else ("l_suppkey", "S")
        lines = t("lineitem").groupBy(key, "l_partkey").agg(F.sum("l_quantity").alias("q"), F.count(one).alias("n"))
        return _edges(lines, curie(prefix, key), predicate, curie("P", "l_partkey"), "lineitem", F.col("q"), F.col("n"))
    if predicate == "located_in":
        c = _edges(t("customer"), curie("C", "c_custkey"), predicate, curie("N", "c_nationkey"), "customer", F.col("c_acctbal"), one)
        return c.unionByName(_edges(t("supplier"), curie("S", "s_suppkey"), predicate, curie("N", "s_nationkey"), "supplier", F.col("s_acctbal"), one))
    if predicate == "part_of":
        return _edges(t("nation"), curie("N", "n_nationkey"), predicate, curie("R", "n_regionkey"), "nation", F.lit(0.0), one)
    raise ValueError(f"no such predicate: {predicate}")


PREDICATES = ("placed", "contains", "supplies", "located_in", "part_of")


def nodes_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes, from the six entity tables."""
    spec = (
        ("customer", "C", "c_custkey", "c_name", F.array(F.lit("Customer"), F.col("c_mktsegment"))),
        ("supplier", "S", "s_suppkey", "s_name", F.array(F.lit("Supplier"))),
        ("part", "P", "p_partkey", "p_name", F.array(F.lit("Part"), F.col("p_brand"))),
        ("orders", "O", "o_orderkey", None, F.array(F.lit("Order"), F.col("o_orderpriority"))),
        ("nation", "N", "n_nationkey", "n_name", F.array(F.lit("Nation"))),
        ("region", "R", "r_regionkey", "r_name", F.array(F.lit("Region"))),
    )
    out = None
    for name, prefix, key, label, categories in spec:
        part = table(spark, sf_dir, name).select(
            curie(prefix, key).alias("id"), (F.col(label) if label else curie(prefix, key)).alias("name"),
            categories.alias("categories"), F.lit(prefix).alias("prefix"))
        out = part if out is None else out.unionByName(part)
    return out


def graph(spark: SparkSession, sf_dir: str, predicates=PREDICATES) -> PropertyGraph:
    edges = None
    for predicate in predicates:
        part = edges_of(spark, sf_dir, predicate)
        edges = part if edges is None else edges.unionByName(part)
    return PropertyGraph(nodes_of(spark, sf_dir), edges)


#: child, ancestor: every category is below itself and the root.
ONTOLOGY = (
    ("Customer", "Agent"), ("Supplier", "Agent"), ("Agent", "Thing"), ("Part", "Item"), ("Item", "Thing"),
    ("Nation", "Place"), ("Region", "Place"), ("Place", "Thing"), ("Order", "Event"), ("Event", "Thing"),
)


def ontology(spark: SparkSession, pairs=ONTOLOGY) -> DataFrame:
    """``(child, ancestor, depth)``: the reflexive transitive closure of child-parent pairs (a small table)."""
    parents: dict[str, set[str]] = {}
    for child, parent in pairs:
        parents.setdefault(child, set()).add(parent)
        parents.setdefault(parent, set())
    rows = []
    for start in parents:
        layer, depth, seen = {start}, 0, set()
        while layer:
            rows += [(start, x, depth) for x in layer - seen]
            seen |= layer
            layer, depth = {p for x in layer for p in parents[x]} - seen, depth + 1
    return spark.createDataFrame(rows, "child string, ancestor string, depth int")


#: The same graph for DuckDB.
SQL = """
edges as (
  select subject || '--' || predicate || '--' || object as id, * from (
    select 'C:' || o_custkey as subject, 'placed' as predicate, 'O:' || o_orderkey as object, 'orders' as source,
      cast(o_totalprice as double) as amount, cast(1 as bigint) as evidence from orders
    union all select 'O:' || l_orderkey, 'contains', 'P:' || l_partkey, 'lineitem', cast(sum(l_quantity) as double), count(*)
      from lineitem group by l_orderkey, l_partkey
    union all select 'S:' || l_suppkey, 'supplies', 'P:' || l_partkey, 'lineitem', cast(sum(l_quantity) as double), count(*)
      from lineitem group by l_suppkey, l_partkey
    union all select 'C:' || c_custkey, 'located_in', 'N:' || c_nationkey, 'customer', cast(c_acctbal as double), 1 from customer
    union all select 'S:' || s_suppkey, 'located_in', 'N:' || s_nationkey, 'supplier', cast(s_acctbal as double), 1 from supplier
    union all select 'N:' || n_nationkey, 'part_of', 'R:' || n_regionkey, 'nation', cast(0 as double), 1 from nation)),
nodes as (
  select 'C:' || c_custkey as id, c_name as name, ['Customer', c_mktsegment] as categories, 'C' as prefix from customer
  union all select 'S:' || s_suppkey, s_name, ['Supplier'], 'S' from supplier
  union all select 'P:' || p_partkey, p_name, ['Part', p_brand], 'P' from part
  union all select 'O:' || o_orderkey, 'O:' || o_orderkey, ['Order', o_orderpriority], 'O' from orders
  union all select 'N:' || n_nationkey, n_name, ['Nation'], 'N' from nation
  union all select 'R:' || r_regionkey, r_name, ['Region'], 'R' from region),
ontology(child, ancestor) as (values ('Customer', 'Customer'), ('Customer', 'Agent'), ('Customer', 'Thing'), ('Supplier', 'Supplier'),
  ('Supplier', 'Agent'), ('Supplier', 'Thing'), ('Agent', 'Agent'), ('Agent', 'Thing'), ('Part', 'Part'), ('Part', 'Item'), ('Part', 'Thing'),
  ('Item', 'Item'), ('Item', 'Thing'), ('Nation', 'Nation'), ('Nation', 'Place'), ('Nation', 'Thing'), ('Region', 'Region'), ('Region', 'Place'),
  ('Region', 'Thing'), ('Place', 'Place'), ('Place', 'Thing'), ('Order', 'Order'), ('Order', 'Event'), ('Order', 'Thing'), ('Event', 'Event'),
  ('Event', 'Thing'), ('Thing', 'Thing'))
"""
