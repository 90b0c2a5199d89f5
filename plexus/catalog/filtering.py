"""Filter queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plexus.catalog.base import query
from plexus.operators import filters as X
from plexus.sources import lens
from plexus.sources.lens import PropertyGraph, edges_of, nodes_of

AT = "av as (select id, amount as value from edges where predicate = 'placed')"


def attrs(spark, d, name="order_value"):
    return edges_of(spark, d, "placed").select("id", F.lit(name).alias("name"), F.col("amount").alias("value"))


def kept(spark, d, bad):
    return edges_of(spark, d, "placed").join(bad, "id", "left_anti").select("id")


@query("f1_remove_by_predicate", "select id from edges where predicate <> 'supplies'")
def f1(spark, d):
    g = lens.graph(spark, d)
    return X.drop_edges(g, X.by_predicate(g.edges, "supplies")).edges.select("id")


@query("f1_remove_by_predicate_connected", """
select id from edges e where predicate not in ('part_of') and predicate in ('located_in', 'placed') and object not in (select subject from edges where predicate = 'part_of' union select object from edges where predicate = 'part_of')
  and subject not in (select subject from edges where predicate = 'part_of' union select object from edges where predicate = 'part_of')""")
def f1c(spark, d):
    g = lens.graph(spark, d, ("placed", "located_in", "part_of"))
    return X.drop_edges(g, X.by_predicate(g.edges, "part_of"), connected=True).edges.select("id")


@query("f1_strip_tags", """
select id, case when predicate = 'located_in' and amount < 0 then 'e2' else 'e1,e2' end as tags from edges where predicate = 'located_in'
union all select id, 'e1' from edges where predicate = 'part_of'""")
def f1s(spark, d):
    two, one = F.array(F.lit("e1"), F.lit("e2")), F.array(F.lit("e1"))
    e = edges_of(spark, d, "located_in").withColumn("qedge_keys", two).union(edges_of(spark, d, "part_of").withColumn("qedge_keys", one))
    bad = e.where("predicate = 'located_in' and amount < 0").select("id")
    return X.strip_tags(e, bad, ["e1"]).select("id", F.array_join(F.array_sort("qedge_keys"), ",").alias("tags"))


@query("f2_remove_by_continuous", "select id from av where not value > 250000", AT)
def f2(spark, d):
    return kept(spark, d, X.by_continuous(attrs(spark, d), "order_value", "above", 250000.0))


@query("f3_remove_by_discrete", "select id from edges where source <> 'orders' and predicate <> 'contains' and predicate <> 'supplies'")
def f3(spark, d):
    g = lens.graph(spark, d, ("placed", "located_in", "part_of"))
    return X.drop_edges(g, X.by_discrete(g.edges, "source", "orders")).edges.select("id")


@query("f4_remove_by_std_dev", "select id from av where not value > (select round(avg(value) + 1.5 * stddev_pop(value), 6) from av)", AT)
def f4(spark, d):
    return kept(spark, d, X.by_std_dev(attrs(spark, d), "order_value", 1.5, "above", True))


@query("f4_std_dev_defaults", "select id from av where not value < (select avg(value) + stddev_pop(value) from av)", AT)
def f4d(spark, d):
    return kept(spark, d, X.by_std_dev(attrs(spark, d), "order_value"))


@query("f5_remove_by_percentile", "select id from av where not value < (select quantile_cont(value, 0.95::double) from av)", AT)
def f5(spark, d):
    return kept(spark, d, X.by_percentile(attrs(spark, d), "order_value"))


@query("f5_percentile_low_is_good", "select id from av where not value > (select quantile_cont(value, 0.05::double) from av)", AT)
def f5l(spark, d):
    return kept(spark, d, X.by_percentile(attrs(spark, d, "ngd"), "ngd"))


@query("f6_remove_by_top_n", "select id from av order by value desc, id limit 50", AT)
def f6(spark, d):
    return kept(spark, d, X.by_top_n(attrs(spark, d), "order_value"))


@query("f7_remove_nodes_by_category", "select id from edges where predicate in ('placed', 'located_in') and subject not in (select id from nodes where list_contains(categories, 'BUILDING'))")
def f7(spark, d):
    g = lens.graph(spark, d, ("placed", "located_in"))
    return X.drop_nodes(g, X.nodes_by_category(g.nodes, "BUILDING")).edges.select("id")


@query("f8_remove_nodes_by_property", "select id from nodes where coalesce(name, '') <> (select n_name from nation where n_nationkey = 3)")
def f8(spark, d):
    name = lens.table(spark, d, "nation").where("n_nationkey = 3").first()["n_name"]
    g = PropertyGraph(nodes_of(spark, d), edges_of(spark, d, "part_of"))
    return X.drop_nodes(g, X.nodes_by_property(g.nodes, "name", name)).nodes.select("id")


@query("f9_remove_orphans", "select id from nodes where id in (select subject from edges where predicate = 'placed' union select object from edges where predicate = 'placed') or id in (select id from nodes where prefix = 'R')")
def f9(spark, d):
    g = PropertyGraph(nodes_of(spark, d), edges_of(spark, d, "placed"))
    return X.remove_orphans(g, keep=g.nodes.where("prefix = 'R'")).nodes.select("id")


@query("f9_remove_orphans_of_category", "select id from nodes where not (prefix = 'C' and id not in (select subject from edges where predicate = 'placed'))")
def f9c(spark, d):
    g = PropertyGraph(nodes_of(spark, d), edges_of(spark, d, "placed"))
    return X.remove_orphans(g, category="Customer").nodes.select("id")


#: Customers and suppliers have synonyms and equivalent ids; nations and regions have neither and are not judged.
GENERAL = """
gn as (select *, cast(substr(id, 3) as int) as k from nodes where prefix in ('C', 'S', 'N', 'R')),
ge as (select * from edges where predicate in ('located_in', 'part_of')),
gb as (select id from gn where prefix in ('C', 'S') and ('eq:' || (k % 500) in ('eq:1', 'eq:77') or 'syn ' || (k % 300) = 'syn 7' or lower(name) = 'customer#000000012' or regexp_matches('syn ' || (k % 300), '(?i)^(?:SYN 1[0-3]$|yn)'))),
gk as (select * from ge where subject not in (select id from gb) and object not in (select id from gb))"""


@query("f10_remove_general_concepts", "select id from gn where id in (select subject from gk union select object from gk)", GENERAL)
def f10(spark, d):
    k = F.substring("id", 3, 9).cast("int")
    named = F.col("prefix").isin("C", "S")
    n = nodes_of(spark, d).where("prefix in ('C', 'S', 'N', 'R')")
    n = n.withColumn("equivalent_ids", F.when(named, F.array("id", F.concat(F.lit("Eq:"), (k % 500).cast("string")))))
    n = n.withColumn("synonyms", F.when(named, F.array(F.lit("other"), F.concat(F.lit("Syn "), (k % 300).cast("string")))))
    g = PropertyGraph(n, edges_of(spark, d, "located_in").union(edges_of(spark, d, "part_of")))
    return X.remove_general_concepts(g, ["EQ:1", "eq:77", "N:1"], ["SYN 7", "Customer#000000012"], ["SYN 1[0-3]$", "yn"]).nodes.select("id")


@query("f3_provenance_names", """
select id from edges where predicate in ('placed', 'located_in', 'part_of') and source <> 'nation' and not (predicate = 'located_in' and amount < 0)""")
def f3p(spark, d):
    g = lens.graph(spark, d, ("placed", "located_in", "part_of"))
    minus = g.edges.where("predicate = 'located_in' and amount < 0")
    listed = minus.select("id", F.lit("aggregator_knowledge_source").alias("name"), F.when(F.col("source") == "customer", "original_source").alias("type_id"), F.lit("nation").alias("value"))
    other = g.edges.select("id", F.lit("note").alias("name"), F.lit("text").alias("type_id"), F.lit("nation").alias("value"))
    sources = g.edges.select("id", F.col("source").alias("resource_id"))
    return X.drop_edges(g, X.by_discrete(g.edges, "provided_by", "nation", listed.union(other), sources)).edges.select("id")


@query("f2_remove_by_type_id", "select id from av where not value < 50000", AT)
def f2t(spark, d):
    a = attrs(spark, d, "some name").withColumn("type_id", F.lit("order_value"))
    return kept(spark, d, X.by_continuous(a.union(attrs(spark, d, "other").selectExpr("id", "name", "0.0", "'x'")), "order_value", "below", 50000.0))
