"""Expansion queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plexus.catalog.base import query
from plexus.operators import expand as X
from plexus.plans.hierarchy import hierarchy
from plexus.sources import lens
from plexus.sources.lens import edges_of, nodes_of, ontology
from plexus.sources.scratch import saved


def joined(column: str):
    """An array as sorted text, for results that are compared."""
    return F.array_join(F.array_sort(column), ",")


@query("e1_one_hop_expand", """
select e.id, e.subject as from_id, e.object as to_id from edges e join nodes s on s.id = e.subject
where e.predicate = 'placed' and list_contains(s.categories, 'BUILDING') and e.object in (select id from nodes where prefix = 'O')""")
def e1(spark, d):
    nodes = nodes_of(spark, d)
    start = nodes.where(F.array_contains("categories", "BUILDING"))
    end = X.of_category(nodes, ontology(spark), ["Event"])
    return X.one_hop(edges_of(spark, d, "placed"), start, end, ["placed"], directed=True).select("id", "from_id", "to_id")


#: child, parent: predicates below others; one has two parents.
PREDICATES = (
    ("placed", "trades"), ("supplies", "trades"), ("contains", "has_part"), ("part_of", "has_part"), ("located_in", "placed_at"), ("part_of", "placed_at"),
    ("trades", "related_to"), ("has_part", "related_to"), ("placed_at", "related_to"))


@query("e1_parent_predicate", """
select e.id, e.subject as from_id, e.object as to_id, e.predicate from edges e join nodes s on s.id = e.subject
where e.predicate in ('placed', 'supplies') and s.prefix in ('C', 'S') union all
select e.id, e.subject, e.object, e.predicate from edges e where e.predicate in ('located_in', 'part_of')""")
def e1_parent(spark, d):
    h = hierarchy(PREDICATES)
    g = lens.graph(spark, d)
    edges = saved(h.numbered(g.edges, "predicate", "predicate_no").repartitionByRange("predicate_no", "subject").sortWithinPartitions("predicate_no"))
    agents = X.of_category(g.nodes, ontology(spark), ["Agent"])
    trades = X.one_hop(edges, agents, g.nodes, ["trades"], directed=True, hierarchy=h)
    places = X.one_hop(edges, g.nodes, g.nodes, ["placed_at"], directed=True, hierarchy=h)
    return trades.select("id", "from_id", "to_id", "predicate").union(places.select("id", "from_id", "to_id", "predicate"))


@query("e1_two_hop_bound_ids", """
select distinct c.id, c.subject as from_id, c.object as to_id from edges c join edges p on p.object = c.subject
where p.predicate = 'placed' and c.predicate = 'contains' and p.subject in ('C:1', 'C:2', 'C:4', 'C:7')""")
def e1_two(spark, d):
    start = spark.createDataFrame([(f"C:{i}",) for i in (1, 2, 4, 7)], "id string")
    nodes = nodes_of(spark, d)
    first = X.one_hop(edges_of(spark, d, "placed"), start, nodes.where("prefix = 'O'"), directed=True)
    bound = first.select(F.col("to_id").alias("id"))
    return X.one_hop(edges_of(spark, d, "contains"), bound, nodes.where("prefix = 'P'"), directed=True).select("id", "from_id", "to_id")


@query("e2_single_node", "select id, name from nodes where id in ('C:1', 'P:3', 'N:5')")
def e2(spark, d):
    return X.single_node(nodes_of(spark, d), ["C:1", "P:3", "N:5"]).select("id", "name")


@query("e3_source_union", "select id, source from edges where predicate in ('placed', 'located_in')")
def e3(spark, d):
    return X.union_sources([edges_of(spark, d, p) for p in ("placed", "located_in")]).select("id", "source")


@query("e4_source_selection", """
select distinct m.source from meta m where m.p in ('placed', 'supplies') and (
  (m.s in (select child from ontology where ancestor = 'Agent') and m.o in (select child from ontology where ancestor = 'Event')) or
  (m.o in (select child from ontology where ancestor = 'Agent') and m.s in (select child from ontology where ancestor = 'Event')))""",
       "meta as (select distinct e.source, s.categories[1] as s, e.predicate as p, o.categories[1] as o from edges e join nodes s on s.id = e.subject join nodes o on o.id = e.object)")
def e4(spark, d):
    from plexus.services.lookups import meta_graph

    return X.select_sources(meta_graph(lens.graph(spark, d)), ontology(spark), "Agent", ["placed", "supplies"], "Event")


@query("e5_id_conversion", """
select id, converted from (select p.id, x.other as converted, row_number() over (partition by p.id order by case substr(x.other, 1, 1) when 'S' then 1 else 2 end, x.other) as r
  from nodes p join (select object as id, subject as other from edges where predicate in ('supplies', 'contains')) x on x.id = p.id where p.prefix = 'P') where r = 1
union all select p.id, null from nodes p where p.prefix = 'P' and p.id not in (select object from edges where predicate in ('supplies', 'contains'))""")
def e5(spark, d):
    other = edges_of(spark, d, "supplies").union(edges_of(spark, d, "contains"))
    ids = nodes_of(spark, d).where("prefix = 'P'").select("id")
    return X.convert_ids(ids, other.select(F.col("object").alias("id"), F.col("subject").alias("other")), ["S", "O"])


@query("e6_answer_merge", """
select o.id, min_by(o.name, o.src) as name, string_agg(distinct o.c, ',' order by o.c) as categories, string_agg(distinct o.q, ',' order by o.q) as query_ids
from (select n.id, n.name, e.source as src, unnest(n.categories) as c, e.subject as q from nodes n join edges e on e.object = n.id where e.predicate in ('supplies', 'placed')) o group by o.id""")
def e6(spark, d):
    e = edges_of(spark, d, "supplies").union(edges_of(spark, d, "placed"))
    n = nodes_of(spark, d).join(e.select(F.col("object").alias("id"), "source", F.col("subject").alias("query_id")), "id")
    return X.merge_nodes(n).select("id", "name", joined("categories").alias("categories"), joined("query_ids").alias("query_ids"))


@query("e6_answer_merge_edges", """
select subject || '--' || predicate || '--' || object || '--' || prim as id, string_agg(distinct source, ',' order by source) as sources, string_agg(distinct q, ',' order by q) as qedge_keys,
  min_by(evidence, source) filter (where evidence is not null) as evidence
from (select subject, predicate, object, 'lineitem' as prim, 'a' as source, 'e0' as q, case when evidence > 1 then evidence end as evidence from edges where predicate = 'supplies'
  union all select subject, predicate, object, 'lineitem', 'b', 'e1', evidence + 10 from edges where predicate = 'supplies' and amount > 30) group by subject, predicate, object, prim""")
def e6e(spark, d):
    e = edges_of(spark, d, "supplies").select("subject", "predicate", "object", F.col("source").alias("primary_source"), "evidence", "amount")
    a = e.select("*", F.lit("a").alias("source"), F.lit("e0").alias("qedge_key")).withColumn("evidence", F.when(F.col("evidence") > 1, F.col("evidence")))
    b = e.where("amount > 30").select("*", F.lit("b").alias("source"), F.lit("e1").alias("qedge_key")).withColumn("evidence", F.col("evidence") + 10)
    return X.merge_edges(a.union(b)).select("id", joined("sources").alias("sources"), joined("qedge_keys").alias("qedge_keys"), "evidence")


@query("e8_bind_nodes", """
select id from nodes where prefix in ('N', 'R') or (prefix = 'C' and id in (select subject from edges where predicate = 'located_in' and amount > 9000))""")
def e8n(spark, d):
    n = nodes_of(spark, d).where("prefix in ('C', 'N', 'R')").withColumn("qnode_key", F.when(F.col("prefix") != "C", F.col("prefix")))
    e = edges_of(spark, d, "located_in")
    return X.bind_nodes(n, e, e.where("amount > 9000").select(F.lit("aux0").alias("aux_id"), F.col("id").alias("edge_id"))).select("id")


@query("e7_edge_key", "select subject || '--' || predicate || '----' || object || '--' || source as key, evidence from edges where predicate = 'supplies'")
def e7(spark, d):
    e = edges_of(spark, d, "supplies").withColumn("qualifier", F.lit(None).cast("string"))
    return e.select(X.edge_key("subject", "predicate", "qualifier", "object", "source").alias("key"), "evidence")


@query("e8_answer_bind", """
select id from edges where predicate = 'placed' and amount > 200000 union all
select id from edges where predicate = 'placed' and amount <= 200000 and evidence = 1 and subject in (select id from nodes where list_contains(categories, 'MACHINERY'))""")
def e8(spark, d):
    e = edges_of(spark, d, "placed").withColumn("qedge_key", F.when(F.col("amount") > 200000, "e0"))
    machines = nodes_of(spark, d).where(F.array_contains("categories", "MACHINERY")).select(F.col("id").alias("subject"))
    aux = e.join(machines, "subject", "left_semi").select(F.lit("aux0").alias("aux_id"), F.col("id").alias("edge_id"))
    return X.bind_answers(e, aux).select("id")


@query("e9_pinned_guard", """
select n.id as node_id, q.k as qnode_key from nodes n, (values ('n0'), ('n1')) q(k)
where n.prefix = 'S' and (cast(substr(n.id, 3) as int) > 20 or q.k = 'n0')""")
def e9(spark, d):
    s = nodes_of(spark, d).where("prefix = 'S'").select(F.col("id").alias("node_id"))
    kg = s.withColumn("qnode_key", F.explode(F.array(F.lit("n0"), F.lit("n1"))))
    pinned = s.where(F.substring("node_id", 3, 9).cast("int") <= 20).withColumn("qnode_key", F.lit("n0"))
    return X.pinned_guard(kg, pinned)


@query("e9_fulfilled_edges", """
select e.id from edges e where e.predicate = 'supplies' and cast(substr(e.subject, 3) as int) % 3 = 0 and cast(substr(e.object, 3) as int) % 2 = 0""")
def e9b(spark, d):
    e = edges_of(spark, d, "supplies").select(F.lit("e0").alias("qedge_key"), "id", "subject", "object")
    n = nodes_of(spark, d).select(F.col("id").alias("node_id"), "prefix", F.substring("id", 3, 9).cast("int").alias("k"))
    kg = n.where("prefix = 'S' and k % 3 = 0").select("node_id", F.lit("n0").alias("qnode_key"))
    kg = kg.union(n.where("prefix = 'P' and k % 2 = 0").select("node_id", F.lit("n1").alias("qnode_key")))
    q = spark.createDataFrame([("e0", "n1", "n0")], "qedge_key string, from_key string, to_key string")
    return X.fulfilled_edges(e, kg, q).select("id")


@query("e10_remove_self_edges", """
select n.id from nodes n where n.prefix in ('S', 'N') and n.id in (
  select subject from e where subject <> object union select object from e where subject <> object)""",
       "e as (select subject, case when amount < 0 then subject else object end as object from edges where predicate = 'located_in' and source = 'supplier')")
def e10(spark, d):
    e = edges_of(spark, d, "located_in").where("source = 'supplier'")
    e = e.withColumn("object", F.when(F.col("amount") < 0, F.col("subject")).otherwise(F.col("object")))
    return X.remove_self_edges(nodes_of(spark, d).where("prefix in ('S', 'N')"), e)[0].select("id")


@query("e11_kryptonite", """
select e.id from edges e where e.predicate = 'contains' and not (
  e.subject in (select subject from a) and e.object in (select object from a))""",
       "a as (select subject, object from edges where predicate = 'contains' and amount > 49)")
def e11(spark, d):
    e = edges_of(spark, d, "contains")
    return X.kryptonite(e, e.where("amount > 49"), ["subject", "object"]).select("id")


@query("e12_dead_end_removal", """
select a.subject as c, a.object as o from edges a where a.predicate = 'placed'
  and a.object in (select b.subject from edges b join edges s on s.object = b.object where b.predicate = 'contains' and s.predicate = 'supplies' and s.amount > 60)""")
def e12(spark, d):
    a = edges_of(spark, d, "placed").select(F.col("subject").alias("c"), F.col("object").alias("o"))
    b = edges_of(spark, d, "contains").select(F.col("subject").alias("o"), F.col("object").alias("p"))
    s = edges_of(spark, d, "supplies").where("amount > 60").select(F.col("object").alias("p"), F.col("subject").alias("s"))
    return X.remove_dead_ends([saved(x) for x in (a, b, s)], ["c", "o", "p", "s"])[0]


@query("e13_prune_intermediate", """
select node_id, score from (select object as node_id, max(amount) as score from edges where predicate = 'contains' group by object)
order by score desc, node_id limit 200""")
def e13(spark, d):
    e = edges_of(spark, d, "contains")
    bound = e.select(F.col("subject").alias("result_id"), F.col("object").alias("node_id"), "amount")
    best = bound.groupBy("node_id", "result_id").agg(F.max("amount").alias("score"))
    scored = best.withColumn("result_id", F.concat_ws("|", "result_id", "node_id"))
    return X.prune_to_top(scored.select("result_id", "node_id"), scored.select("result_id", "score"), X.prune_threshold(0, True, False))


@query("e14_source_constraint", """
select id from edges where predicate = 'placed' and not (amount < 100000 and evidence = 1)""")
def e14(spark, d):
    e = edges_of(spark, d, "placed").withColumn("sources", F.when(F.col("amount") < 100000, F.array(F.lit("bad"), F.lit("plexus"))).otherwise(F.array(F.lit("orders"), F.lit("bad"))))
    return X.source_constraint(e, allow=["orders"], deny=["bad"]).select("id")


@query("e15_node_constraint", "select id from nodes where prefix = 'C' and not list_contains(categories, 'BUILDING')")
def e15(spark, d):
    c = nodes_of(spark, d).where("prefix = 'C'")
    return X.node_constraint(c, c.where(F.array_contains("categories", "BUILDING")), negate=True).select("id")


#: Edges of several sources: which one depends on the part.
LUMP = """
le as (select id, subject, 'G:' || cast(substr(object, 3) as int) % 40 as object, cast(substr(object, 3) as int) % 6 as k, amount, evidence from edges where predicate = 'supplies'),
el as (select * from le where case k when 0 then amount > 24 when 1 then evidence >= 2 when 2 then evidence * 5 >= 10 when 3 then true else false end)"""


def lump_edges(spark, d):
    """Edges and attributes: faers needs cases, trials a flag, semmeddb publications, ctd nothing; the rest has no rule."""
    k = F.substring("object", 3, 9).cast("int")
    e = edges_of(spark, d, "supplies").withColumn("k", k % 6).withColumn("object", F.concat(F.lit("G:"), (k % 40).cast("string")))
    pick = lambda *xs: F.get(F.array(*[F.lit(x) for x in xs]), F.col("k"))
    e = e.withColumn("sources", F.array(pick("faers", "multiomics-clinicaltrials", "semmeddb", "ctd", "unlisted", "faers"), F.lit("aggregator")))
    e = e.withColumn("predicate", pick("applied_to_treat", "in_clinical_trials_for", "treats_or_applied_or_studied_to_treat", "studied_to_treat", "applied_to_treat", "studied_to_treat"))
    name = F.get(F.array(F.lit("number_of_cases"), F.lit("elevate_to_prediction"), F.lit("publications"), F.lit(None), F.lit("number_of_cases"), F.lit("number_of_cases")), F.col("k"))
    value = F.when(F.col("k") == 1, (F.col("evidence") >= 2).cast("double")).when(F.col("k") == 2, F.col("evidence") * 5.0).otherwise(F.col("amount"))
    return e.select("id", "subject", "predicate", "object", "sources"), e.select("id", name.alias("name"), value.alias("value")).where("name is not null")


@query("e16_lump_edges", """
select subject, object, 'treats' as predicate, 'q' as qedge_key, count(*) as n_edges, string_agg(id, ',' order by id) as support from el group by subject, object""", LUMP)
def e16(spark, d):
    return X.lump(*lump_edges(spark, d), "q")[0].drop("id").withColumn("support", joined("support"))


@query("e16_support_edges", "select id, 'creative_q' as qedge_key from el", LUMP)
def e16s(spark, d):
    return X.lump(*lump_edges(spark, d), "q")[1].select("id", "qedge_key")


@query("e17_subclass_edges", "select n || '--subclass_of--' || q as id, n as subject, q as object from (select distinct object as n, 'R:' || cast(substr(object, 3) as int) % 5 as q from edges where predicate = 'located_in')")
def e17(spark, d):
    a = edges_of(spark, d, "located_in").select(F.col("object").alias("node_id"), F.concat(F.lit("R:"), (F.substring("object", 3, 9).cast("int") % 5).cast("string")).alias("query_id"))
    return X.subclass_edges(a).select("id", "subject", "object")


@query("e18_map_back", """
select id, subject, case when substr(object, 1, 2) = 'N:' and cast(substr(object, 3) as int) < 10 then 'in:' || substr(object, 3) else object end as object
from edges where predicate = 'located_in'""")
def e18(spark, d):
    n = nodes_of(spark, d).where("prefix = 'N'").where(F.substring("id", 3, 9).cast("int") < 10)
    one = n.select(F.col("id").alias("canonical_id"), F.concat(F.lit("in:"), F.substring("id", 3, 9)).alias("input_id"))
    two = n.select(F.col("id").alias("canonical_id"), F.concat(F.lit("out:"), F.substring("id", 3, 9)).alias("input_id"))
    return X.map_back(edges_of(spark, d, "located_in"), one.union(two)).select("id", "subject", "object")


@query("e19_low_evidence", "select id from nodes where prefix = 'P' and id in (select object from edges where predicate = 'supplies' and evidence >= 2)")
def e19(spark, d):
    return X.low_evidence(nodes_of(spark, d).where("prefix = 'P'"), edges_of(spark, d, "supplies"), "lineitem", 2)[0].select("id")


@query("e20_domain_range", "select id from edges where predicate = 'placed' and not amount > 300000")
def e20(spark, d):
    e = edges_of(spark, d, "placed").withColumn("domain_range_exclusion", F.when(F.col("amount") > 300000, "True"))
    return X.domain_range(e).select("id")


@query("e21_scrub_attributes", "select id, array_to_string(list_filter(categories, lambda x: x not in ('FURNITURE', 'None')), ',') as categories from nodes where prefix = 'C'")
def e21(spark, d):
    return X.scrub(nodes_of(spark, d).where("prefix = 'C'"), "categories", ["FURNITURE", "None"]).select("id", F.array_join("categories", ",").alias("categories"))


#: What is known of customers: a segment, and for some a description, which others of the tables repeat.
ATTRIBUTES = """
att as (select 'C:' || c_custkey as id, 'segment' as type, c_mktsegment as value, 'customer' as source from customer
  union all select 'C:' || o_custkey, 'description', min(o_orderpriority), 'orders' from orders where o_totalprice > 400000 group by o_custkey),
me as (select 'C:' || c_custkey as id, 'segment' as type, c_mktsegment as value, case when c_acctbal > 0 then 'customer' else 'accounts' end as source from customer
  union all select 'C:' || o_custkey, 'description', min(o_orderpriority), 'orders' from orders group by o_custkey
  union all select 'C:' || c_custkey, 'note', case when c_acctbal < 500 then '' else c_name end, 'customer' from customer)"""


def attribute_tables(spark, d):
    c, o = lens.table(spark, d, "customer"), lens.table(spark, d, "orders")
    cid = lens.curie("C", "c_custkey").alias("id")
    words = lambda df: df.groupBy("o_custkey").agg(F.min("o_orderpriority").alias("value")).select(
        lens.curie("C", "o_custkey").alias("id"), F.lit("description").alias("type"), "value", F.lit("orders").alias("source"))
    segment = lambda source: c.select(cid, F.lit("segment").alias("type"), F.col("c_mktsegment").alias("value"), source.alias("source"))
    at = segment(F.lit("customer")).union(words(o.where("o_totalprice > 400000")))
    me = segment(F.when(F.col("c_acctbal") > 0, "customer").otherwise("accounts")).union(words(o))
    return at, me.union(c.select(cid, F.lit("note"), F.when(F.col("c_acctbal") < 500, "").otherwise(F.col("c_name")), F.lit("customer")))


@query("e22_novel_attributes", "select * from att union all (select * from (select distinct * from me where value <> '') except select * from att)", ATTRIBUTES)
def e22_novel(spark, d):
    at, me = attribute_tables(spark, d)
    return X.decorate_attributes(at, me, nodes_of(spark, d))


@query("e22_bare_nodes_only", """
select * from att union all (select * from (select distinct * from me where value <> '' and id not in (select id from att where type = 'description')) except select * from att)""", ATTRIBUTES)
def e22_bare(spark, d):
    at, me = attribute_tables(spark, d)
    return X.decorate_attributes(at, me, nodes_of(spark, d), bare_only=True)


@query("e22_node_decoration", "select n.id, n.name, p.p_size as size from nodes n left join part p on n.id = 'P:' || p.p_partkey where n.prefix in ('P', 'R')")
def e22(spark, d):
    meta = lens.table(spark, d, "part").select(lens.curie("P", "p_partkey").alias("id"), F.lit("other").alias("name"), F.col("p_size").alias("size"))
    return X.decorate_nodes(nodes_of(spark, d).where("prefix in ('P', 'R')").select("id", "name"), meta)


@query("e23_edge_decoration", """
select e.id, string_agg(distinct l_returnflag || l_linestatus, ',' order by l_returnflag || l_linestatus) as supporting_text
from edges e join lineitem l on e.subject = 'S:' || l_suppkey and e.object = 'P:' || l_partkey where e.predicate = 'supplies' group by e.id""")
def e23(spark, d):
    lines = lens.table(spark, d, "lineitem").select(
        lens.curie("S", "l_suppkey").alias("subject"), lens.curie("P", "l_partkey").alias("object"), F.concat("l_returnflag", "l_linestatus").alias("text"))
    out = X.decorate_edges(edges_of(spark, d, "supplies"), lines, ["subject", "object"])
    return out.select("id", F.array_join("supporting_text", ",").alias("supporting_text"))


@query("e24_fulfilment", """
select 'n0' as key, count(*) as n from nodes where prefix = 'S' union all select 'n1', count(*) from nodes where prefix = 'R'
union all select 'e0', 0""")
def e24(spark, d):
    n = nodes_of(spark, d).where("prefix in ('S', 'R')").select(F.when(F.col("prefix") == "S", "n0").otherwise("n1").alias("qnode_key"), F.col("id").alias("node_id"))
    e = edges_of(spark, d, "part_of").where("amount > 0").select(F.lit("e0").alias("qedge_key"), "id")
    return X.fulfilled(n, e, ["n0", "n1"], ["e0"])


@query("e25_score_edges", """
select subject || '--treats--' || object as id, subject, object, amount as score from edges where predicate = 'contains' and amount >= 30 and subject in ('O:1', 'O:2', 'O:3', 'O:4', 'O:5', 'O:6', 'O:7')""")
def e25(spark, d):
    ids = spark.createDataFrame([(f"O:{i}",) for i in range(1, 8)], "id string")
    scores = edges_of(spark, d, "contains").select("subject", "object", F.col("amount").alias("score"))
    return X.score_edges(scores, ids, 30.0, "treats").select("id", "subject", "object", "score")


@query("p9_canonical_direction", """
select id, case when predicate = 'supplies' then 'supplied_by' else predicate end as predicate,
  case when predicate = 'supplies' then object else subject end as subject, case when predicate = 'supplies' then subject else object end as object
from edges where predicate in ('supplies', 'part_of')""")
def p9(spark, d):
    e = edges_of(spark, d, "supplies").union(edges_of(spark, d, "part_of"))
    inverse = spark.createDataFrame([("supplies", "supplied_by")], "predicate string, canonical string")
    return X.canonical_direction(e, inverse).select("id", "predicate", "subject", "object")
