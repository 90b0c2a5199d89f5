"""Matching queries (R1-R15, X1-X5) and the flagship."""

from __future__ import annotations

from pyspark.sql import functions as F

from plexus.catalog.base import query
from plexus.operators import expand, match, overlay, paths, rank
from plexus.plans.pattern import Pattern, QEdge, QNode
from plexus.sources import lens
from plexus.sources.lens import edges_of, nodes_of
from plexus.sources.scratch import saved

#: customer - order - parts (a set)
CHAIN = Pattern((QNode("c", categories=("Customer",)), QNode("o"), QNode("p", is_set=True)), (QEdge("e0", "c", "o"), QEdge("e1", "o", "p")))


def chain_kg(spark, d, segment="BUILDING"):
    nodes = nodes_of(spark, d)
    some = nodes.where(F.array_contains("categories", segment)).select(F.col("id").alias("subject"))
    e0 = edges_of(spark, d, "placed").join(some, "subject", "left_semi")
    e1 = edges_of(spark, d, "contains").join(e0.select(F.col("object").alias("subject")), "subject", "left_semi")
    cols = ("id", "subject", "object", "amount")
    kg_edges = saved(e0.select(F.lit("e0").alias("qedge_key"), *cols).union(e1.select(F.lit("e1").alias("qedge_key"), *cols)))  # read many times
    kg_nodes = None
    for edge, col, key in (("e0", "subject", "c"), ("e0", "object", "o"), ("e1", "object", "p")):
        part = kg_edges.where(F.col("qedge_key") == edge).select(F.lit(key).alias("qnode_key"), F.col(col).alias("node_id")).distinct()
        kg_nodes = part if kg_nodes is None else kg_nodes.union(part)
    return saved(kg_nodes), kg_edges


KG = """
e0 as (select * from edges where predicate = 'placed' and subject in (select id from nodes where list_contains(categories, 'BUILDING'))),
e1 as (select * from edges where predicate = 'contains' and subject in (select object from e0)),
r as (select e0.subject as c, e0.object as o, string_agg(distinct e1.object, ',' order by e1.object) as p, count(distinct e1.object) as n from e0 join e1 on e1.subject = e0.object group by e0.subject, e0.object)"""


@query("r3_match_chain_set", "select c, o, p from r", KG)
def r3(spark, d):
    return match.match(CHAIN, *chain_kg(spark, d)).select("c", "o", F.array_join("p", ",").alias("p"))


@query("r3_match_chain_no_set", "select e0.subject as c, e0.object as o, e1.object as p from e0 join e1 on e1.subject = e0.object", KG)
def r3b(spark, d):
    plain = Pattern((QNode("c"), QNode("o"), QNode("p")), CHAIN.edges)
    return match.match(plain, *chain_kg(spark, d))


@query("r5_match_middle_set", """
select e0.subject as c, e1.object as p, string_agg(distinct e0.object, ',' order by e0.object) as o from e0 join e1 on e1.subject = e0.object group by e0.subject, e1.object""", KG)
def r5(spark, d):
    middle = Pattern((QNode("c"), QNode("o", is_set=True), QNode("p")), CHAIN.edges)
    return match.match(middle, *chain_kg(spark, d)).select("c", "p", F.array_join("o", ",").alias("o"))


@query("r4_parallel_edges", """
select a.subject as s, string_agg(a.object, ',' order by a.object) as p from edges a where a.predicate = 'supplies' and a.amount >= 50 and a.evidence >= 2 group by a.subject""")
def r4(spark, d):
    s = edges_of(spark, d, "supplies")
    pattern = Pattern((QNode("s"), QNode("p", is_set=True)), (QEdge("e0", "s", "p"), QEdge("e1", "p", "s")))
    e = s.where("amount >= 50").withColumn("qedge_key", F.lit("e0")).union(s.where("evidence >= 2").withColumn("qedge_key", F.lit("e1")))
    n = s.select(F.lit("s").alias("qnode_key"), F.col("subject").alias("node_id")).union(s.select(F.lit("p"), "object")).distinct()
    return match.match(pattern, n, e).select("s", F.array_join("p", ",").alias("p"))


@query("r6_directed_match", "select subject as s, object as p from edges where predicate = 'supplies' and amount >= 80")
def r6(spark, d):
    s = edges_of(spark, d, "supplies").where("amount >= 80").withColumn("qedge_key", F.lit("e0"))
    n = s.select(F.lit("s").alias("qnode_key"), F.col("subject").alias("node_id")).union(s.select(F.lit("p"), "object")).distinct()
    return match.match(Pattern((QNode("s"), QNode("p")), (QEdge("e0", "s", "p"),)), n, s, ignore_direction=False)


@query("r7_edge_bindings", """
select c || '|' || o as result_id, 'e0' as qedge_key, c || '--placed--' || o as edge_id from r
union all select r.c || '|' || r.o, 'e1', e1.id from r join e1 on e1.subject = r.o""", KG)
def r7(spark, d):
    kg_nodes, kg_edges = chain_kg(spark, d)
    results = saved(match.result_id(match.match(CHAIN, kg_nodes, kg_edges), CHAIN))
    return match.bound_edges(match.bound_nodes(results, CHAIN), CHAIN, kg_edges)


OPTION = Pattern(
    (QNode("c"), QNode("o"), QNode("p", is_set=True, option_group="g")), (QEdge("e0", "c", "o"), QEdge("e1", "o", "p", option_group="g")))


@query("r8_option_groups", """
select e0.subject as c, e0.object as o, string_agg(distinct x.object, ',' order by x.object) as p from e0 left join (select * from e1 where amount >= 45) x on x.subject = e0.object group by e0.subject, e0.object""", KG)
def r8(spark, d):
    kg_nodes, kg_edges = chain_kg(spark, d)
    out = match.with_options(OPTION, kg_nodes, kg_edges.where("qedge_key = 'e0' or amount >= 45"))
    return out.select("c", "o", F.array_join("p", ",").alias("p"))


@query("r9_subclass_collapse", """
select id, subject, 'N:' || least(cast(substr(object, 3) as int), cast(substr(object, 3) as int) // 5 * 5) as object, object as real_object from edges where predicate = 'located_in'""")
def r9(spark, d):
    n = nodes_of(spark, d).where("prefix = 'N'").select("id", F.substring("id", 3, 9).cast("int").alias("k"))
    sub = n.where("k % 5 <> 0").select(F.col("id").alias("child"), F.concat(F.lit("N:"), (F.floor(F.col("k") / 5) * 5).cast("string")).alias("parent"))
    return match.collapse_subclasses(edges_of(spark, d, "located_in"), sub).select("id", "subject", "object", "real_object")


@query("r10_edgeless_pattern", "select (select string_agg(id, ',' order by id) from nodes where prefix = 'N') as a, (select string_agg(id, ',' order by id) from nodes where prefix = 'R') as b")
def r10(spark, d):
    n = nodes_of(spark, d).where("prefix in ('N', 'R')").select(F.when(F.col("prefix") == "N", "a").otherwise("b").alias("qnode_key"), F.col("id").alias("node_id"))
    out = match.match(Pattern((QNode("a"), QNode("b"))), n, n)
    return out.select(F.array_join("a", ",").alias("a"), F.array_join("b", ",").alias("b"))


@query("r11_essence", "select r.c, r.o, nodes.name || case when cast(substr(r.o, 3) as int) % 2 = 0 then ' (' || nodes.categories[2] || ')' else '' end as essence from r join nodes on nodes.id = r.o", KG)
def r11(spark, d):
    pattern = Pattern((QNode("c", ids=("C:1",)), QNode("o"), QNode("p", is_set=True)), CHAIN.edges)
    even = F.substring("id", 3, 9).cast("int") % 2 == 0
    nodes = nodes_of(spark, d).where("prefix = 'O'").withColumn("symbol", F.when(even, F.get("categories", F.lit(1))).otherwise(F.col("name")))
    return match.essences(match.match(CHAIN, *chain_kg(spark, d)), pattern, nodes).select("c", "o", "essence")


@query("r2_integrity", """
select 'MissingQNodeKeys' as error, 0 as n union all select 'MissingQEdgeKeys', 0 union all select 'UnknownQNodeKey', (select count(distinct object) from e1)
union all select 'UnknownQEdgeKey', (select count(*) from e1) union all select 'OrphanEdges', (select count(*) from e1 where amount >= 49)
union all select 'MissingIds', 0 union all select 'MissingEnds', (select count(*) from e1 where amount < 2) union all select 'RepeatedEdgeIds', (select count(*) from e0)
union all select 'MismatchedNodes', (select count(*) from e0 where amount > 200000)
union all select 'BoundNodesNotInGraph', 0""", KG)
def r2(spark, d):
    kg_nodes, kg_edges = chain_kg(spark, d)
    # some orders are bound as customers
    dear = kg_edges.where("qedge_key = 'e0' and amount > 200000").select(F.col("object").alias("node_id"), F.lit("c").alias("__as")).distinct()
    kg_nodes = saved(kg_nodes.join(dear, "node_id", "left").select(F.coalesce("__as", "qnode_key").alias("qnode_key"), "node_id"))
    far = F.when((F.col("qedge_key") == "e1") & (F.col("amount") >= 49), F.concat(F.lit("X"), "object")).when((F.col("qedge_key") != "e1") | (F.col("amount") >= 2), F.col("object"))
    broken = kg_edges.withColumn("object", far).union(kg_edges.where("qedge_key = 'e0'"))
    return match.integrity(Pattern(CHAIN.nodes[:2], CHAIN.edges[:1]), kg_nodes, broken.withColumn("id", F.col("id")))


PARENTS = """
lc as (select subject as c, object as n, 'N:' || (cast(substr(object, 3) as int) // 5 * 5) as p from edges where predicate = 'located_in' and source = 'customer')"""


@query("r9_match_on_parents", """
select c || '|' || p as result_id, 'c' as qnode_key, c as node_id from lc union select c || '|' || p, 'n', p from lc union select c || '|' || p, 'n', n from lc""", PARENTS)
def r9m(spark, d):
    n = nodes_of(spark, d).where("prefix = 'N'").select("id", F.substring("id", 3, 9).cast("int").alias("k"))
    sub = n.where("k % 5 <> 0").select(F.col("id").alias("child"), F.concat(F.lit("N:"), (F.floor(F.col("k") / 5) * 5).cast("string")).alias("parent"))
    e = edges_of(spark, d, "located_in").where("source = 'customer'").select(F.lit("e").alias("qedge_key"), "id", "subject", "object")
    kg = nodes_of(spark, d).where("prefix in ('C', 'N')").select(F.lower("prefix").alias("qnode_key"), F.col("id").alias("node_id"))
    return match.match_collapsed(Pattern((QNode("c"), QNode("n")), (QEdge("e", "c", "n"),)), kg, e, sub)[1]


@query("r13_query_ids", "select o as node_id, case when substr(c, 3) <> substr(o, 3) then c end as query_id from r", KG)
def r13(spark, d):
    m = match.match(CHAIN, *chain_kg(spark, d))
    alias = F.when(F.substring("c", 3, 9) == F.substring("o", 3, 9), F.col("o")).otherwise(F.col("c"))
    asked = m.select(F.col("o").alias("node_id"), F.array(alias, F.lit("Z:0")).alias("query_ids"))
    return match.query_ids(m.select(F.col("o").alias("node_id")), asked)


@query("r14_prune_graph", """
select distinct e.id from edges e where (e.predicate = 'placed' and e.object in (select o from t) and e.subject in (select c from t))
or (e.predicate = 'contains' and e.subject in (select o from t) and e.object in (select object from e1 where subject in (select o from t)))""",
       KG + ", t as (select c, o from r where n >= 7)")
def r14(spark, d):
    kg_nodes, kg_edges = chain_kg(spark, d)
    results = saved(match.result_id(match.match(CHAIN, kg_nodes, kg_edges).where(F.size("p") >= 7), CHAIN))
    bound = match.bound_nodes(results, CHAIN)
    g = lens.graph(spark, d, ("placed", "contains"))
    return match.prune_graph(g.nodes, g.edges, bound, match.bound_edges(bound, CHAIN, kg_edges))[1].select("id")


@query("r15_recompute_keys", "select c as node_id, 'c' as qnode_keys from r group by c union all select o, 'o' from r union all select distinct object, 'p' from e1", KG)
def r15(spark, d):
    results = match.result_id(match.match(CHAIN, *chain_kg(spark, d)), CHAIN)
    return match.recompute_keys(match.bound_nodes(results, CHAIN)).select("node_id", F.array_join("qnode_keys", ",").alias("qnode_keys"))


@query("flagship", """
select c, o, p, jaccard, row_number() over (order by jaccard desc, c, o) as place from (
  select r.c, r.o, r.p, round(r.n / cast(t.n as double), 6) as jaccard from r join (select e0.subject as c, count(distinct e1.object) as n from e0 join e1 on e1.subject = e0.object group by e0.subject) t on t.c = r.c)
order by jaccard desc, c, o limit 500""", KG)
def flagship(spark, d):
    kg_nodes, kg_edges = chain_kg(spark, d)
    results = saved(match.result_id(match.match(CHAIN, kg_nodes, kg_edges), CHAIN))
    bound = match.bound_nodes(results, CHAIN)
    part_of_customer = overlay.result_pairs(bound, "c", "p").groupBy(F.col("subject").alias("c")).agg(F.count(F.lit(1)).alias("n"))
    scored = results.join(part_of_customer, "c").withColumn("jaccard", F.round(F.size("p") / F.col("n"), 6))
    top = rank.limit_results(scored, [F.desc("jaccard"), F.asc("c"), F.asc("o")], 500)
    return top.select("c", "o", F.array_join("p", ",").alias("p"), "jaccard", "place")


#: The nearest other customer, by id, of C:1's region and another nation.
ENDS = """
cn as (select subject as c, object as n from edges where predicate = 'located_in' and source = 'customer'),
cr as (select cn.c, cn.n, r.object as r from cn join edges r on r.subject = cn.n and r.predicate = 'part_of'),
goal as (select min(x.c) as c from cr x join cr y on y.c = 'C:1' and x.r = y.r and x.n <> y.n),
ed as (select subject as a, object as b from edges where predicate in ('located_in', 'part_of')),
un as (select a, b from ed union select b, a from ed),
walk(path, last, length) as (select ['C:1'], 'C:1', cast(0 as bigint) union all select list_append(path, b), b, length + 1 from walk join un on un.a = last
  where length < 4 and not list_contains(path, b) and last <> (select c from goal))"""


def ends(spark, d):
    home = edges_of(spark, d, "located_in").where("source = 'customer'").select(F.col("subject").alias("c"), F.col("object").alias("n"))
    home = home.join(edges_of(spark, d, "part_of").select(F.col("subject").alias("n"), F.col("object").alias("r")), "n")
    one = home.where("c = 'C:1'").select(F.col("n").alias("n1"), F.col("r").alias("r1"))
    goal = home.join(F.broadcast(one)).where("r = r1 and n <> n1").agg(F.min("c").alias("c")).first()["c"]  # one row
    return edges_of(spark, d, "located_in").union(edges_of(spark, d, "part_of")), "C:1", goal


@query("x1_connect_paths", "select array_to_string(path, '>') as path, length from walk where last = (select c from goal)", ENDS, recursive=True)
def x1(spark, d):
    return paths.connect(*ends(spark, d), 4).select(F.array_join("path", ">").alias("path"), "length")


@query("x1_connect_through", """
select array_to_string(path, '>') as path, length from walk where last = (select c from goal) and len(list_filter(path, lambda x: x[1:1] = 'R')) > 0""", ENDS, recursive=True)
def x1t(spark, d):
    regions = nodes_of(spark, d).where("prefix = 'R'").select("id")
    return paths.connect(*ends(spark, d), 4, through=regions).select(F.array_join("path", ">").alias("path"), "length")


@query("x3_path_analyses", """
select row_number() over (order by p) as analysis, p as path, 2 as length from (select c || '>' || o || '>' || b as p from (select a.subject as c, a.object as o, b.object as b from edges a join edges b on a.object = b.subject
where a.predicate = 'located_in' and a.source = 'supplier' and b.predicate = 'part_of' and a.subject = 'S:1'))""")
def x3(spark, d):
    e = edges_of(spark, d, "located_in").where("source = 'supplier'").union(edges_of(spark, d, "part_of"))
    nation = e.where("subject = 'S:1'").first()["object"]
    region = e.where(F.col("subject") == nation).first()["object"]
    return paths.analyses(paths.connect(e, "S:1", region, 2)).select("analysis", F.array_join("path", ">").alias("path"), "length")


@query("x4_support_graphs", """
select result_id, case when n <= 4 then 'aux_' || ids || '_g' else 'aux_' || (row_number() over (order by result_id) - 1) || '_g' end as aux_id, n as n_edges from (
  select r.c || '|' || r.o as result_id, string_agg(e1.id, ';' order by e1.id) as ids, count(*) as n from r join e1 on e1.subject = r.o where e1.amount >= 10 group by r.c, r.o)""", KG)
def x4(spark, d):
    kg_nodes, kg_edges = chain_kg(spark, d)
    results = saved(match.result_id(match.match(CHAIN, kg_nodes, kg_edges), CHAIN))
    bound = match.bound_edges(match.bound_nodes(results, CHAIN), CHAIN, kg_edges)
    virtual = bound.where("qedge_key = 'e1'").join(kg_edges.where("amount >= 10").select(F.col("id").alias("edge_id")), "edge_id", "left_semi")
    return paths.support_graphs(virtual.withColumn("option_group", F.lit("g"))).select("result_id", "aux_id", F.size("edge_ids").cast("long").alias("n_edges"))


@query("x4_unbind_virtual", "select c || '|' || o as result_id, 'c' as qnode_key, c as node_id from r union all select c || '|' || o, 'o', o from r", KG)
def x4u(spark, d):
    kg_nodes, kg_edges = chain_kg(spark, d)
    results = saved(match.result_id(match.match(CHAIN, kg_nodes, kg_edges), CHAIN))
    bound = match.bound_nodes(results, CHAIN)
    lost = results.select("result_id", F.lit("o").alias("qnode_key"), F.lit("O:parent").alias("node_id"))  # at no edge
    return paths.unbind_virtual(match.bound_edges(bound, CHAIN, kg_edges), bound.union(lost), kg_edges, ["e0"], ["c", "o"])[1]


def order_lines(spark, d):
    """``(c, o, p, amount)`` of the orders that were placed, with their parts, written once: edges get their ids where they are needed."""
    placed = edges_of(spark, d, "placed").select(F.col("subject").alias("c"), F.col("object").alias("o"))
    contains = edges_of(spark, d, "contains").select(F.col("subject").alias("o"), F.col("object").alias("p"), "amount")
    return saved(placed.join(contains, "o").select("c", "o", "p", "amount"))


def support(spark, d, lines):
    """Each order's aux graph joins customer and order through its parts; the edges of parts of little quantity are infinite."""
    asked = edges_of(spark, d, "placed").select(F.col("id").alias("edge_id"), F.col("object").alias("aux_id"), F.col("subject").alias("from_id"), F.col("object").alias("to_id"))
    value = F.when(F.col("amount") >= 30, 0.5).otherwise(float("inf"))
    hop = lambda a, b, ngd: F.struct(F.col(a).alias("subject"), F.col(b).alias("object"), ngd.alias("ngd"))
    aux = lines.select(F.col("o").alias("aux_id"), F.explode(F.array(hop("c", "p", value), hop("p", "o", F.lit(0.1)))).alias("x"))
    return asked, aux.select("aux_id", "x.*")


@query("x5_supported_edges", """
select e.id from edges e where e.predicate = 'placed' and (e.object in (select subject from edges where predicate = 'contains' and amount >= 30)
  or e.object not in (select subject from edges where predicate = 'contains'))""")
def x5(spark, d):
    return paths.supported(*support(spark, d, order_lines(spark, d))).select(F.col("edge_id").alias("id"))


@query("x5_creative_filter", """
select e.subject || '|' || e.object as result_id, case x when 1 then 'c' else 'o' end as qnode_key, case x when 1 then e.subject else e.object end as node_id
from edges e, (values (1), (2)) v(x) where e.predicate = 'placed' and e.object in (select subject from edges where predicate = 'contains' and amount >= 30)""")
def x5c(spark, d):
    lines = order_lines(spark, d)
    placed = edges_of(spark, d, "placed").select("id", "subject", "object")
    name = placed.select(F.concat_ws("|", "subject", "object").alias("result_id"), "id", "subject", "object")
    edge = F.concat_ws("--", "o", F.lit("contains"), "p").alias("id")  # as the lens names it
    e1 = lines.select(F.concat_ws("|", "c", "o").alias("result_id"), F.lit("e1"), edge)
    bound = name.select("result_id", F.lit("e0").alias("qedge_key"), F.col("id").alias("edge_id")).union(e1)
    nodes = name.select("result_id", F.lit("c").alias("qnode_key"), F.col("subject").alias("node_id")).union(name.select("result_id", F.lit("o"), "object"))
    nodes = nodes.union(name.select("result_id", F.lit("o"), F.lit("O:orphan")))
    ok = saved(paths.supported(*support(spark, d, lines)))
    edges = placed.union(lines.select(edge, "o", "p"))
    return paths.creative_filter(bound, nodes, edges, ok, ["e0"], ["e0", "e1"])[1]


@query("e11_kryptonite_pattern", """
select c, o, p from r where o not in (select subject from e1 where amount = 50)""", KG)
def kryptonite(spark, d):
    kg_nodes, kg_edges = chain_kg(spark, d)
    bad = kg_edges.where("qedge_key = 'e1' and amount = 50").select(F.col("subject").alias("o"))
    kept = expand.kryptonite(kg_edges.where("qedge_key = 'e0'").withColumn("o", F.col("object")), bad, ["o"]).drop("o")
    return match.match(CHAIN, kg_nodes, kept.union(kg_edges.where("qedge_key = 'e1'"))).select("c", "o", F.array_join("p", ",").alias("p"))
