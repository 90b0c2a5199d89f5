"""Inference and lookup queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plexus.catalog.base import query
from plexus.catalog.batch import SYN, syn_nodes
from plexus.functions.text import prefix_of, to_pascal, to_snake
from plexus.operators import infer as I
from plexus.plans.pattern import Pattern, QEdge, QNode
from plexus.services import lookups as V
from plexus.sources import lens
from plexus.sources.lens import edges_of, nodes_of, ontology
from plexus.sources.scratch import saved

#: Scores of (supplier, nation) pairs stand in for a prediction table; a path goes over a part to a supplier of the nation.
SCORES = """
sc as (select s.subject as drug, l.object as disease, round(max(s.amount) / 200, 6) as score from edges s join edges t on t.object = s.object and t.predicate = 'supplies' and t.subject <> s.subject
  join edges l on l.subject = t.subject and l.predicate = 'located_in' where s.predicate = 'supplies' and s.amount >= 40 group by 1, 2),
tp as (select drug, disease, score from (select *, row_number() over (partition by drug order by score desc, disease) as r from sc) where r <= 20),
ho as (select tp.drug, tp.disease, tp.score, tp.drug || '->located_in->' || tp.disease as one, tp.drug || '->located_in->' || n.object || '->SELF_LOOP_RELATION->' || n.object as loop,
  tp.drug || '->supplies->' || p.object || '->near->' || tp.disease as two, n.object as n from tp join edges n on n.subject = tp.drug and n.predicate = 'located_in' and n.source = 'supplier'
  join (select subject, min(object) as object from edges where predicate = 'supplies' group by subject) p on p.subject = tp.drug),
pa as (select drug, disease, one as path, score as path_score from ho union all select drug, disease, loop, score / 2 from ho where n < disease union all select drug, disease, two, 0.0 from ho),
sv as (select drug, disease, one as path, 1 as length, 1 as n_hops from ho where n = disease union all select drug, disease, loop, 2, 1 from ho where n < disease)"""


def supplies(spark, d):
    """The supplies, cut to a table: every query of predictions reads them more than once."""
    return saved(edges_of(spark, d, "supplies").select("subject", "predicate", "object", "amount"))


def scores(spark, d, e):
    """The best score of each drug and disease.

    A part lists the diseases of its suppliers, with the supplier where there is only one; so pairs of suppliers are
    never made, and lists are opened where all rows of a drug meet.
    """
    home = edges_of(spark, d, "located_in").select("subject", F.col("object").alias("disease"))
    reach = e.join(home, "subject").groupBy("object", "disease").agg(F.min("subject").alias("one"), F.max("subject").alias("last"))
    only = F.when(F.col("one") == F.col("last"), F.col("one")).alias("only")
    lists = reach.groupBy("object").agg(F.collect_list(F.struct("disease", only)).alias("to"))
    s = e.where("amount >= 40").select(F.col("subject").alias("drug"), "object", "amount")
    met = s.join(lists, "object").select("drug", "amount", "to").repartition("drug")
    met = met.select("drug", "amount", F.explode("to").alias("t")).where("t.only is null or t.only <> drug")
    return met.groupBy("drug", F.col("t.disease").alias("disease")).agg(F.round(F.max("amount") / 200, 6).alias("score"))


def top(spark, d, e=None):
    s = saved(scores(spark, d, supplies(spark, d) if e is None else e))
    return saved(I.top_scored(s, "drug", s.select(F.col("drug").alias("id")).distinct(), 20))


def paths(spark, d, e, t):
    n = edges_of(spark, d, "located_in").where("source = 'supplier'").select(F.col("subject").alias("drug"), F.col("object").alias("n"))
    p = e.groupBy(F.col("subject").alias("drug")).agg(F.min("object").alias("p"))
    t = saved(t.join(n, "drug").join(p, "drug"))
    join = lambda *xs: F.concat_ws("->", *xs).alias("path")
    one = t.select("drug", "disease", join("drug", F.lit("located_in"), "disease"), F.col("score").alias("path_score"))
    loop = t.where("n < disease").select("drug", "disease", join("drug", F.lit("located_in"), "n", F.lit(I.SELF_LOOP), "n"), F.col("score") / 2)
    two = t.select("drug", "disease", join("drug", F.lit("supplies"), "p", F.lit("near"), "disease"), F.lit(0.0))
    return one.union(loop).union(two)


def predictions(spark, d):
    """``(supplies, top pairs, their paths)``."""
    e = supplies(spark, d)
    t = top(spark, d, e)
    return e, t, paths(spark, d, e, t)


def hops_of(spark, d, e):
    columns = ("subject", "predicate", "object")
    return e.select(*columns).union(edges_of(spark, d, "located_in").select(*columns))


@query("i1_top_predictions", "select drug, disease, score from tp", SCORES)
def i1(spark, d):
    return top(spark, d)


@query("i1_surviving_paths", "select drug, disease, path, cast(length as bigint) as length, 'paths_of_' || length as option_group, cast(n_hops as bigint) as n_hops from sv", SCORES)
def i1p(spark, d):
    e, _, ways = predictions(spark, d)
    return I.surviving_paths(ways, hops_of(spark, d, e))


@query("i1_predicted_edges", "select drug || '--predicted_treats--' || disease as id, score, n_paths from tp join (select drug as a, disease as b, count(*) as n_paths from sv group by 1, 2) on a = drug and b = disease", SCORES)
def i1e(spark, d):
    e, t, ways = predictions(spark, d)
    return I.predicted_edges(t, I.surviving_paths(ways, hops_of(spark, d, e))).select("id", "score", "n_paths")


@query("i1_no_pair_has_a_path", "select drug || '--predicted_treats--' || disease as id, score, cast(0 as bigint) as n_paths from tp", SCORES)
def i1n(spark, d):
    _, t, ways = predictions(spark, d)
    return I.predicted_edges(t, I.surviving_paths(ways, edges_of(spark, d, "part_of"))).select("id", "score", "n_paths")


@query("i4_regulation", """
select subject, object, regulation, score, place from (select *, row_number() over (partition by subject order by score desc, object) as place from (
  select subject, object, case when evidence >= 2 then 'increased' else 'decreased' end as regulation, round(amount / 100, 6) as score from edges where predicate = 'supplies')
  where regulation = 'increased' and score >= 0.5) where place <= 30""")
def i4(spark, d):
    e = edges_of(spark, d, "supplies")
    s = e.select("subject", "object", F.when(F.col("evidence") >= 2, "increased").otherwise("decreased").alias("regulation"), F.round(F.col("amount") / 100, 6).alias("score"))
    return I.predicted_regulation(s, "increased", subjects=e.select(F.col("subject").alias("id")))


@query("i9_source_chain", "select id, source || case when evidence > 1 then ',hub' else '' end || ',plexus' as sources from edges where predicate in ('placed', 'supplies')")
def i9(spark, d):
    e = edges_of(spark, d, "placed").union(edges_of(spark, d, "supplies"))
    e = e.select("id", F.col("source").alias("primary"), F.when(F.col("evidence") > 1, F.array("source", F.lit("hub"))).alias("aggregators"))
    return I.source_chain(e, "plexus").select("id", F.array_join("sources", ",").alias("sources"))


@query("i2_path_length", "select path, cast(len(string_split(path, '->')) // 2 as bigint) as length from pa", SCORES)
def i2(spark, d):
    return predictions(spark, d)[2].select("path", I.path_length("path").alias("length"))


@query("i3_sort_by_prediction", "select id as result_id, coalesce(score, 0) as score from nodes left join (select disease, max(score) as score from tp group by disease) on disease = id where prefix in ('N', 'R')", SCORES)
def i3(spark, d):
    r = nodes_of(spark, d).where("prefix in ('N', 'R')").select(F.col("id").alias("result_id"))
    return I.by_prediction(r, top(spark, d).groupBy(F.col("disease").alias("result_id")).agg(F.max("score").alias("score")))


@query("i5_nearest_embeddings", """
select query_id, vec_id, probability, place from (select q.vec_id as query_id, e.vec_id,
  round(1 / (1 + exp(-5 * (list_dot_product(cast(e.embedding as double[]), cast(q.embedding as double[])) / (sqrt(list_dot_product(cast(e.embedding as double[]), cast(e.embedding as double[]))) * sqrt(list_dot_product(cast(q.embedding as double[]), cast(q.embedding as double[]))))))), 6) as probability,
  row_number() over (partition by q.vec_id order by probability desc, e.vec_id) as place
  from embeddings e join (select * from embeddings where vec_id % 20 = 0) q on q.vec_id <> e.vec_id) where probability >= 0.5 and place <= 30""")
def i5(spark, d):
    e = lens.table(spark, d, "embeddings").select("vec_id", "embedding")
    return I.nearest(e, e.where("vec_id % 20 = 0").toDF("query_id", "query"))


#: Paths from each part over a nation to a region: over a supplier to the nation, from there one edge.
HUBS = """
wy as (select s.object as answer, l.object as hub, s.id as e1, l.id as e2, s.subject as mid, cast(substr(s.subject, 3) as int) % 2 as odd
  from edges s join edges l on l.subject = s.subject and l.predicate = 'located_in' where s.predicate = 'supplies'),
wb as (select * from (select *, row_number() over (partition by answer, hub order by odd, e1, e2) as r from wy) where r = 1),
ff as (select * from (select answer, target, hub, e1, e2, mid, r.id as e3, odd = 0 as relevant, row_number() over (partition by answer, target order by odd, hub) as place
  from wb join (select 'P:' || p_partkey as p, 'R:' || (p_partkey % 5) as target from part) on p = answer join edges r on r.predicate = 'part_of' and r.subject = hub and r.object = target) where place <= 3)"""


def hub_paths(spark, d):
    answers = lens.table(spark, d, "part").select(lens.curie("P", "p_partkey").alias("answer"), F.concat(F.lit("R:"), (F.col("p_partkey") % 5).cast("string")).alias("target"))
    depth = spark.createDataFrame([("supplies", 2), ("located_in", 1), ("part_of", 3)], "predicate string, depth int")
    n = nodes_of(spark, d)
    even = n.where("prefix = 'S'").where(F.substring("id", 3, 9).cast("int") % 2 == 0).select("id")
    e = lens.graph(spark, d, ("supplies", "located_in", "part_of")).edges
    return I.via_hubs(answers, e, n.where("prefix = 'N'").select("id"), depth, even, 3)


@query("i6_hub_paths", "select answer, target, hub, e1 || ',' || e2 as way_1, mid as mid_1, e3 as way_2, relevant, place from ff", HUBS)
def i6(spark, d):
    out = hub_paths(spark, d)
    return out.select("answer", "target", "hub", F.array_join("way_1", ",").alias("way_1"), "mid_1", F.array_join("way_2", ",").alias("way_2"), "relevant", "place")


@query("i7_path_graph", "select 'e1_2_0' as qedge_key, e1 as edge_id from ff union select 'e1_2_1', e2 from ff union select 'e2_1_0', e3 from ff", HUBS)
def i7(spark, d):
    return I.path_graph(hub_paths(spark, d))[1]


@query("i7_path_nodes", "select 'n0' as qnode_key, answer as node_id from ff union select 'n01', mid from ff union select 'n1', hub from ff union select 'n2', target from ff", HUBS)
def i7n(spark, d):
    return I.path_graph(hub_paths(spark, d))[0]


@query("markov_transitions", """
select from_type, to_type, round(count(*) / cast(sum(count(*)) over (partition by from_type) as double), 6) as chance from (
  select event_type as from_type, lead(event_type) over (partition by user_id order by ts, event_id) as to_type from events) where to_type is not null group by from_type, to_type""")
def markov(spark, d):
    from pyspark.sql import Window

    after = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    steps = lens.table(spark, d, "events").select(F.col("event_type").alias("from_type"), after.alias("to_type")).where("to_type is not null")
    return I.transitions(steps).withColumn("chance", F.round("chance", 6))


CLUSTERS = SYN + """, cu as (select 'B:' || name as cluster_id, name, branch as category, id as member_id, name || ' ' || substr(id, 3) as member_name from sn)"""


def cluster_table(spark, d):
    n = syn_nodes(spark, d)
    return n.select(F.concat(F.lit("B:"), "name").alias("cluster_id"), "name", F.col("branch").alias("category"), F.col("id").alias("member_id"), F.concat_ws(" ", "name", F.substring("id", 3, 9)).alias("member_name"))


@query("v1_canonical_lookup", """
select t.term, c.cluster_id, c.name, c.category from (values ('P:7'), ('P:11'), ('nothing')) t(term) left join cu c on c.member_id = t.term
union all select upper(member_name), cluster_id, name, category from cu where member_id in ('P:3', 'P:4')""", CLUSTERS)
def v1(spark, d):
    c = cluster_table(spark, d)
    terms = spark.createDataFrame([("P:7",), ("P:11",), ("nothing",)], "term string")
    named = c.where("member_id in ('P:3', 'P:4')").select(F.upper("member_name").alias("term"))
    return V.canonical(terms.union(named), c)


@query("v1_all_categories", """
select member_id as term, cluster_id, name, category, (select string_agg(c || '=' || n, ',' order by c) from (select category as c, count(*) as n from cu y where y.cluster_id = cu.cluster_id group by category)) as categories from cu""", CLUSTERS)
def v1a(spark, d):
    c = cluster_table(spark, d)
    of = c.select("member_id", "category")
    out = V.all_categories(c.select(F.col("member_id").alias("term")), c, of)
    return out.select("term", "cluster_id", "name", "category", F.array_join(F.transform(F.map_entries("categories"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("categories"))


@query("v2_equivalents", "select a.member_id as id, string_agg(distinct b.member_id, ',' order by b.member_id) as equivalents from cu a join cu b on a.cluster_id = b.cluster_id group by a.member_id", CLUSTERS)
def v2(spark, d):
    c = cluster_table(spark, d)
    return V.equivalents(c.select(F.col("member_id").alias("id")), c, ",")


@query("v2_deepest_category", "select id, categories[1] as category from nodes")
def v2d(spark, d):
    c = nodes_of(spark, d).select("id", F.explode("categories").alias("category"))
    return V.deepest_category(c.join(ontology(spark).select(F.col("child").alias("category")).distinct(), "category", "left_semi"), ontology(spark))


@query("v3_names_match", """
select a, b, coalesce(x = y or (contains(l, s) and length(s) / cast(length(l) as double) >= 0.6)
  or len(list_filter(ta, lambda p: len(list_filter(tb, lambda q: p = q or starts_with(p, q) or starts_with(q, p))) > 0)) / cast(greatest(len(ta), len(tb)) as double) > 0.5, false) as matches
from (select *, case when length(x) <= length(y) then x else y end as s, case when length(x) <= length(y) then y else x end as l from (
  select p_name as a, p_type || ' ' || p_name as b, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') as x, regexp_replace(lower(p_type || ' ' || p_name), '[^a-z0-9]', '', 'g') as y,
    list_filter(string_split_regex(lower(p_name), '[^a-z0-9]+'), lambda t: t <> '') as ta, list_filter(string_split_regex(lower(p_type || ' ' || p_name), '[^a-z0-9]+'), lambda t: t <> '') as tb from part))""")
def v3(spark, d):
    p = lens.table(spark, d, "part").select(F.col("p_name").alias("a"), F.concat_ws(" ", "p_type", "p_name").alias("b"))
    return p.select("a", "b", V.names_match(F.col("a"), F.col("b")).alias("matches"))


@query("v4_autocomplete", """
select term, case when starts_with(low, 'cust') then 0 else 1 end as kind, cast(length(term) as int) as length from (select lower(term) as low, min(term) as term from (select c_name as term from customer union all select p_name from part) group by 1)
where contains(low, 'cust') order by 2, 3, 1 limit 40""")
def v4(spark, d):
    t = lens.table(spark, d, "customer").select(F.col("c_name").alias("term")).union(lens.table(spark, d, "part").select("p_name"))
    return V.complete(t, "cust", 40)


@query("v5_cache_key", "select n_nationkey, sha256('{\"n_name\":\"' || n_name || '\",\"n_regionkey\":' || n_regionkey || '}') as key from nation")
def v5(spark, d):
    n = lens.table(spark, d, "nation")
    return n.select("n_nationkey", V.cache_key(["n_regionkey", "n_name"]).alias("key"))


@query("v6_denied_clients", "select user_id as client, count(*) as n from events where event_type = 'purchase' group by user_id having count(*) > 10")
def v6(spark, d):
    return V.denied_clients(lens.table(spark, d, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("client")))


@query("v6_recent_queries", "select event_type as status, count(*) as n, max(value) as longest_s from events where epoch(date_trunc('second', (select max(ts) from events))) - epoch(date_trunc('second', ts)) <= 48 * 3600 group by event_type")
def v6r(spark, d):
    e = lens.table(spark, d, "events").select(F.col("event_type").alias("status"), F.col("ts").alias("started"), F.col("value").alias("elapsed"))
    return V.recent_queries(e, 48)


@query("v7_meta_graph", "select distinct e.source, s.categories[1] as subject_category, e.predicate, o.categories[1] as object_category from edges e join nodes s on s.id = e.subject join nodes o on o.id = e.object")
def v7(spark, d):
    return V.meta_graph(lens.graph(spark, d))


@query("v8_provenance", """
select predicate, provided_by, n, cast(sum(n) over (partition by predicate) as bigint) as n_predicate, count(*) over (partition by predicate) as n_sources from (
  select predicate, case when amount < 0 then 'no provenance' else source end as provided_by, count(*) as n from edges group by 1, 2)""")
def v8(spark, d):
    e = lens.graph(spark, d).edges.withColumn("source", F.when(F.col("amount") >= 0, F.col("source")))
    return V.provenance(e)


@query("v10_expansive_categories", """
select distinct category, expanded from (select child as category, ancestor as expanded from ontology where child in (select unnest(categories) from nodes) and ancestor <> 'Thing'
  union all select child, case ancestor when 'Customer' then 'Supplier' when 'Supplier' then 'Customer' when 'Item' then 'Place' when 'Place' then 'Item' end
  from ontology where child in (select unnest(categories) from nodes) and ancestor in ('Customer', 'Supplier', 'Item', 'Place'))""")
def v10(spark, d):
    c = nodes_of(spark, d).select(F.explode("categories").alias("category")).distinct()
    same = spark.createDataFrame([("Supplier", "Customer"), ("Item", "Place")], "a string, b string")
    return V.expansive_categories(c, ontology(spark), same, "Thing")


@query("v9_untagged", "select 'nodes' as what, (select count(*) from nodes where prefix = 'R') as n union all select 'edges', (select count(*) from edges where predicate = 'part_of')")
def v9u(spark, d):
    n = nodes_of(spark, d).withColumn("qnode_keys", F.when(F.col("prefix") != "R", F.array("prefix")))
    e = lens.graph(spark, d, ("located_in", "part_of")).edges.withColumn("qedge_keys", F.when(F.col("predicate") != "part_of", F.array(F.lit("e"))))
    return V.untagged(n, e)


@query("v9_infer_tags", """
select 'e0' as qedge_key, id from edges where predicate = 'located_in' and object = 'N:3' and source = 'customer' union all select 'e1', id from edges where predicate = 'part_of' and subject = 'N:3'""")
def v9(spark, d):
    p = Pattern((QNode("c", categories=("Customer",)), QNode("n", ids=("N:3",)), QNode("r", categories=("Region",))), (QEdge("e0", "n", "c", ("located_in",)), QEdge("e1", "n", "r")))
    g = lens.graph(spark, d, ("placed", "located_in", "part_of"))
    return V.infer_tags(p, g.nodes, g.edges)[1].select("qedge_key", "id")


@query("text_prefix_and_case", """
select distinct upper(split_part(p_name, ' ', 1)) as prefix, lower(replace(p_name, ' ', '_')) as snake,
  array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1:1]) || x[2:]), '') as pascal from part""")
def text(spark, d):
    name = F.col("p_name")
    p = lens.table(spark, d, "part")
    return p.select(prefix_of(F.replace(name, F.lit(" "), F.lit(":"))).alias("prefix"), to_snake(name).alias("snake"), to_pascal(name).alias("pascal")).distinct()
