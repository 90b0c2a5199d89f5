"""Overlay queries (O1-O10, C1-C9 and the archived similarity and enrichment tests)."""

from __future__ import annotations

from pyspark.sql import functions as F

from plexus.catalog.base import query
from plexus.operators import overlay as O
from plexus.sources import lens
from plexus.sources.lens import edges_of, nodes_of


def part_docs(spark, d):
    """The co-occurrence index: parts are concepts, orders documents."""
    return edges_of(spark, d, "contains").select(F.col("object").alias("concept"), F.col("subject").alias("doc"))


def part_pairs(spark, d):
    """Pairs of parts of one supplier's supplies that are in an order of a small customer group."""
    e = edges_of(spark, d, "contains").where("amount >= 40")
    a, b = e.select("subject", F.col("object").alias("x")), e.select("subject", F.col("object").alias("y"))
    return a.join(b, "subject").where("x < y").select(F.col("x").alias("subject"), F.col("y").alias("object")).distinct()


PAIRS = """
ix as (select object as concept, subject as doc from edges where predicate = 'contains'),
pairs as (select distinct a.object as subject, b.object as object from edges a join edges b on a.subject = b.subject and a.object < b.object
  where a.predicate = 'contains' and b.predicate = 'contains' and a.amount >= 40 and b.amount >= 40),
f as (select concept, count(*) as f from ix group by concept),
sh as (select p.subject, p.object, count(*) as fxy, list(a.doc order by a.doc)[1:30] as docs
  from pairs p join ix a on a.concept = p.subject join ix b on b.concept = p.object and a.doc = b.doc group by p.subject, p.object),
ngd as (select sh.subject, sh.object, round((greatest(ln(x.f), ln(y.f)) - ln(fxy)) / (ln(700000000.0::double) - least(ln(x.f), ln(y.f))), 6) as ngd, array_to_string(docs, ',') as docs
  from sh join f x on x.concept = sh.subject join f y on y.concept = sh.object)"""


@query("o1_compute_ngd", "select subject, object, ngd, docs from ngd", PAIRS)
def o1(spark, d):
    out = O.ngd(part_docs(spark, d), part_pairs(spark, d), default=0.0)
    return out.select("subject", "object", F.round("ngd", 6).alias("ngd"), F.array_join("docs", ",").alias("docs"))


@query("o1_virtual_edges", "select 'N1--' || subject || '--' || object as id, 'N1' as qedge_key, ngd as value from ngd", PAIRS)
def o1v(spark, d):
    out = O.ngd(part_docs(spark, d), part_pairs(spark, d)).withColumn("ngd", F.round("ngd", 6))
    return O.virtual_edges(out, "N1", "has_normalized_google_distance_with", "ngd").select("id", "qedge_key", "value")


@query("o1m_multi_ngd", """
select g.group_id, round((ln(max(c.f)) - ln(any_value(s.n))) / (ln(700000000.0::double) - ln(min(c.f))), 6) as ngd
from g join c on c.concept = g.concept join s on s.group_id = g.group_id group by g.group_id""", """
g as (select distinct subject as group_id, object as concept from edges where predicate = 'contains' and subject in (select subject from edges where predicate = 'contains' group by subject having count(*) = 3)),
c as (select object as concept, count(*) as f from edges where predicate = 'contains' group by object),
s as (select group_id, count(*) as n from (select g.group_id, e.subject from g join edges e on e.object = g.concept and e.predicate = 'contains' group by g.group_id, e.subject having count(*) = 3) group by group_id)""")
def o1m(spark, d):
    e = edges_of(spark, d, "contains")
    three = e.groupBy("subject").count().where("count = 3").select("subject")
    groups = e.join(three, "subject", "left_semi").select(F.col("subject").alias("group_id"), F.col("object").alias("concept"))
    return O.multi_ngd(part_docs(spark, d), groups).select("group_id", F.round("ngd", 6).alias("ngd"))


JACCARD = """
m as (select subject as c, object as o from edges where predicate = 'placed'), q as (select subject as o, object as p from edges where predicate = 'contains'),
st as (select id from nodes where list_contains(categories, 'BUILDING')), n as (select c, count(*) as n from m where c in (select id from st) group by c)"""


@query("o2_compute_jaccard", """
select m.c as start, q.p as "end", round(count(*) / cast(any_value(n.n) as double), 6) as jaccard_index
from m join n on n.c = m.c join q on q.o = m.o group by m.c, q.p""", JACCARD)
def o2(spark, d):
    nodes = nodes_of(spark, d)
    placed, contains = edges_of(spark, d, "placed"), edges_of(spark, d, "contains")
    e = placed.union(contains).select(F.col("subject").alias("a"), F.col("object").alias("b"))
    out = O.jaccard(e, nodes.where(F.array_contains("categories", "BUILDING")).select("id"),
                    nodes.where("prefix = 'O'").select("id"), nodes.where("prefix = 'P'").select("id"))
    return out.withColumn("jaccard_index", F.round("jaccard_index", 6))


@query("o2_jaccard_with_zeros", """
select s.id as start, e.id as "end", round(coalesce(x.m, 0) / cast(n.n as double), 6) as jaccard_index
from st s join n on n.c = s.id cross join (select id from nodes where id in ('P:1', 'P:2', 'P:3')) e
left join (select m.c, q.p, count(*) as m from m join q on q.o = m.o group by m.c, q.p) x on x.c = s.id and x.p = e.id""", JACCARD)
def o2z(spark, d):
    nodes = nodes_of(spark, d)
    placed = edges_of(spark, d, "placed")
    start = nodes.where(F.array_contains("categories", "BUILDING")).select("id")
    few = "id in ('P:1', 'P:2', 'P:3')"
    end = nodes.where(few).select("id")
    # lines of other parts lead to no end: they go before anything is joined
    e = placed.select("subject", "object").union(edges_of(spark, d, "contains").select("subject", "object").where(few.replace("id", "object")))
    e = e.toDF("a", "b")
    found = O.jaccard(e, start, nodes.where("prefix = 'O'").select("id"), end)
    starts = placed.join(start.toDF("subject"), "subject", "left_semi").select(F.col("subject").alias("start")).distinct()
    return O.with_zeros(found, starts, end.toDF("end")).withColumn("jaccard_index", F.round("jaccard_index", 6))


@query("similar_neighbours", """
select a.s as a, b.s as b, round(count(*) / cast(any_value(a.n) + any_value(b.n) - count(*) as double), 6) as similarity
from x a join x b on a.o = b.o and a.s < b.s group by a.s, b.s having count(*) / cast(any_value(a.n) + any_value(b.n) - count(*) as double) >= 0.1""",
       "x as (select subject as s, object as o, count(*) over (partition by subject) as n from edges where predicate = 'supplies')")
def similar(spark, d):
    return O.similar_neighbours(edges_of(spark, d, "supplies"), 0.1).withColumn("similarity", F.round("similarity", 6))


def _fisher_sql(degree: str) -> str:
    return f"""
l as (select subject, object from edges where predicate = 'supplies' and subject in (select subject from edges where predicate = 'located_in' and source = 'supplier' and amount > 5000)),
deg as ({degree}), pop as (select count(*) as n from nodes where prefix = 'S'), nn as (select count(distinct subject) as n from l),
t as (select l.object, count(*) as a, any_value(deg.g) - count(*) as b, any_value(nn.n) - count(*) as c, any_value(pop.n) - any_value(deg.g) - (any_value(nn.n) - count(*)) as d
  from l join deg on deg.object = l.object, pop, nn group by l.object),
u as (select distinct a, b, c, d, unnest(range(greatest(0, a + b + a + c - (a + b + c + d)), least(a + b, a + c) + 1)) as k from t where b >= 0 and c >= 0 and d >= 0),
v as (select *, lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(a + b + c + d + 1) as base from u),
w as (select *, base - lgamma(k + 1) - lgamma(a + b - k + 1) - lgamma(a + c - k + 1) - lgamma(d - a + k + 1) as lp,
  base - lgamma(a + 1) - lgamma(b + 1) - lgamma(c + 1) - lgamma(d + 1) as lo from v),
fr as (select t.object, t.a, t.b, t.c, t.d, least(sum(case when lp <= lo + 1e-7 then exp(lp) else 0 end), 1.0) as raw from t join w using (a, b, c, d) group by all),
fp as (select *, round(raw, 6) as p from fr)"""


def _some_suppliers(spark, d):
    few = edges_of(spark, d, "located_in").where("source = 'supplier' and amount > 5000").select("subject")
    return edges_of(spark, d, "supplies").join(few, "subject", "left_semi")


def _population(spark, d):
    return nodes_of(spark, d).where("prefix = 'S'").count()


@query("o3_fisher_exact_test", "select object, a, b, c, d, p from fp", _fisher_sql("select object, count(distinct subject) as g from edges where predicate = 'supplies' group by object"))
def o3(spark, d):
    degree = O.category_degree(edges_of(spark, d, "supplies"), nodes_of(spark, d), "Supplier")
    return O.fisher(_some_suppliers(spark, d), degree, _population(spark, d)).withColumn("p", F.round("p", 6))


@query("o3_fisher_cutoff_top_n", "select object, p from fp where raw < 0.45 order by round(raw, 9), object limit 25", _fisher_sql("select object, count(distinct subject) as g from edges where predicate = 'supplies' group by object"))
def o3t(spark, d):
    degree = O.category_degree(edges_of(spark, d, "supplies"), nodes_of(spark, d), "Supplier")
    return O.fisher(_some_suppliers(spark, d), degree, _population(spark, d), cutoff=0.45, top_n=25).select("object", F.round("p", 6).alias("p"))


@query("o3b_fisher_by_predicate", "select object, a, b, p from fp", _fisher_sql("select object, count(*) as g from edges where predicate = 'supplies' group by object"))
def o3b(spark, d):
    degree = edges_of(spark, d, "supplies").groupBy("object").agg(F.count(F.lit(1)).alias("degree"))
    return O.fisher(_some_suppliers(spark, d), degree, _population(spark, d)).select("object", "a", "b", F.round("p", 6).alias("p"))


CLINIC = """
ev as (select distinct user_id as patient, event_type || ':' || (cast(floor(value) as bigint) % 7) as concept from events),
pn as (select cast(count(distinct patient) as double) as n from ev), sg as (select concept, cast(count(*) as double) as c from ev group by concept),
bt as (select a.concept as concept_1, b.concept as concept_2, count(*) as concept_count from ev a join ev b on a.patient = b.patient and a.concept < b.concept group by a.concept, b.concept),
pt as (select concept_1, concept_2, concept_count, concept_count / n as concept_frequency, x.c * y.c / n as expected_count, ln(concept_count / (x.c * y.c / n)) as ln_ratio,
  case when x.c * y.c * (n - x.c) * (n - y.c) > 0 then n * pow(concept_count * (n - x.c - y.c + concept_count) - (x.c - concept_count) * (y.c - concept_count), 2) / (x.c * y.c * (n - x.c) * (n - y.c)) else 0 end as chi_square,
  concept_count / x.c as relative_frequency_1, concept_count / y.c as relative_frequency_2
  from bt join sg x on x.concept = concept_1 join sg y on y.concept = concept_2, pn),
sy as (select * from pt union all select concept_2, concept_1, concept_count, concept_frequency, expected_count, ln_ratio, chi_square, relative_frequency_2, relative_frequency_1 from pt)"""


def clinic(spark, d):
    concept = F.concat_ws(":", "event_type", (F.floor("value") % 7).cast("string"))
    return lens.table(spark, d, "events").select(F.col("user_id").alias("patient"), concept.alias("concept"))


_STATS = ("concept_frequency", "expected_count", "ln_ratio", "chi_square", "relative_frequency_1", "relative_frequency_2")


@query("c0_pair_statistics", "select concept_1, concept_2, concept_count, " + ", ".join(f"round({c}, 6) as {c}" for c in _STATS) + " from pt", CLINIC)
def c0(spark, d):
    return O.pair_statistics(clinic(spark, d)).select("concept_1", "concept_2", F.col("concept_count").cast("long").alias("concept_count"), *[F.round(c, 6).alias(c) for c in _STATS])


def _lookup(name, measure, other=None):
    where = "concept_1 = 'click:1'" + (f" and concept_2 = '{other}'" if other else "")

    @query(name, f"select concept_1, concept_2, round({measure}, 6) as {measure}, row_number() over (order by round({measure}, 6) desc, concept_2) as rank from sy where {where}", CLINIC)
    def run(spark, d):
        table = O.pair_statistics(clinic(spark, d))
        table = table.withColumns({c: F.round(c, 6) for c in _STATS})
        return O.clinical_lookup(table, "click:1", measure, other).select("concept_1", "concept_2", measure, "rank")

    return run


for _name, _measure, _other in (
    ("c1_paired_frequency", "concept_frequency", None), ("c1_paired_frequency_of_two", "concept_frequency", "click:2"),
    ("c6_observed_expected_ratio", "ln_ratio", None), ("c7_chi_square", "chi_square", None), ("c8_relative_frequency", "relative_frequency_2", None),
):
    _lookup(_name, _measure, _other)


@query("c2_concept_frequency", "select concept, count(*) as concept_count, round(count(*) / any_value(n), 6) as concept_frequency from ev, pn group by concept", CLINIC)
def c2(spark, d):
    return O.concept_frequency(clinic(spark, d)).withColumn("concept_frequency", F.round("concept_frequency", 6))


@query("c3_associated_frequency", """
select concept_2 as concept, round(concept_frequency, 6) as concept_frequency, row_number() over (order by round(concept_frequency, 9) desc, concept_2) as rank
from sy where concept_1 = 'click:1' and split_part(concept_2, ':', 1) = 'view'""", CLINIC)
def c3(spark, d):
    table = O.pair_statistics(clinic(spark, d)).withColumn("concept_frequency", F.round("concept_frequency", 9))
    rows = O.clinical_lookup(table, "click:1", "concept_frequency", domain="view")
    return rows.select(F.col("concept_2").alias("concept"), F.round("concept_frequency", 6).alias("concept_frequency"), "rank")


@query("c4_vocabularies", "select split_part(concept, ':', 1) as vocabulary, count(*) as n from sg group by 1", CLINIC)
def c4(spark, d):
    return O.vocabularies(clinic(spark, d).select("concept"))


@query("c4_get_concepts", "select concept, split_part(concept, ':', 1) as vocabulary, split_part(concept, ':', 2) as code from sg where concept in ('click:1', 'view:3', 'view:99')", CLINIC)
def c4g(spark, d):
    ids = spark.createDataFrame([("click:1",), ("view:3",), ("view:99",)], "concept string")
    return O.get_concepts(clinic(spark, d).select("concept"), ids)


@query("c5_most_frequent_concepts", "select concept, count(*) as concept_count from ev group by concept order by 2 desc, 1 limit 10", CLINIC)
def c5(spark, d):
    return O.concept_frequency(clinic(spark, d)).select("concept", "concept_count").orderBy(F.desc("concept_count"), "concept").limit(10)


@query("c9_domain_counts", "select event_type as domain, count(distinct user_id) as patients, count(*) as records from events group by event_type")
def c9(spark, d):
    return O.domain_counts(lens.table(spark, d, "events").select(F.col("user_id").alias("patient"), F.col("event_type").alias("domain")))


@query("c9_domain_pair_counts", "select a.t as domain_1, b.t as domain_2, count(*) as patients from (select distinct user_id as u, event_type as t from events) a join (select distinct user_id as u, event_type as t from events) b on a.u = b.u and a.t < b.t group by a.t, b.t")
def c9b(spark, d):
    return O.domain_pair_counts(lens.table(spark, d, "events").select(F.col("user_id").alias("patient"), F.col("event_type").alias("domain")))


@query("c9_patient_count", "select count(distinct user_id) as patients, count(distinct event_type || ':' || (cast(floor(value) as bigint) % 7)) as concepts, count(*) as records from events", CLINIC)
def c9p(spark, d):
    return O.patient_count(clinic(spark, d))


@query("c10_concept_ids", """
select id, concept, min(distance) as distance from (select 'X:' || split_part(concept, ':', 1) as id, concept, cast(split_part(concept, ':', 2) as int) as distance from sg) where id in ('X:click', 'X:view') and distance <= 3 group by id, concept""", CLINIC)
def c10(spark, d):
    c = clinic(spark, d).select("concept").distinct()
    mapping = c.select(F.concat(F.lit("X:"), F.substring_index("concept", ":", 1)).alias("id"), "concept", F.substring_index("concept", ":", -1).cast("int").alias("distance"))
    return O.map_ids(spark.createDataFrame([("X:click",), ("X:view",)], "id string"), mapping, 3)


_MAP = "mp as (select 'X:' || split_part(concept, ':', 1) as id, concept from sg), pr as (select a.id as subject, b.id as object from (select distinct id from mp) a, (select distinct id from mp) b where a.id < b.id)"


def _mapped(spark, d):
    concepts = clinic(spark, d).select("concept").distinct()
    mapping = concepts.select(F.concat(F.lit("X:"), F.substring_index("concept", ":", 1)).alias("id"), "concept")
    ids = mapping.select("id").distinct()
    return mapping, ids.toDF("subject").join(ids.toDF("object"), F.col("subject") < F.col("object"))


@query("o4_clinical_frequency", "select subject, object, round(coalesce(max(s.concept_frequency), 0), 6) as concept_frequency from pr left join mp x on x.id = subject left join mp y on y.id = object left join sy s on s.concept_1 = x.concept and s.concept_2 = y.concept group by subject, object", CLINIC + ", " + _MAP)
def o4(spark, d):
    mapping, pairs = _mapped(spark, d)
    out = O.clinical(pairs, mapping, O.pair_statistics(clinic(spark, d)), "concept_frequency")
    return out.withColumn("concept_frequency", F.round("concept_frequency", 6))


@query("o4q_clinical_p_value", "select subject, object, round(arg_max(1 / (1 + round(s.chi_square, 6)), struct_pack(a := round(s.chi_square, 6), b := -1 / (1 + round(s.chi_square, 6)))), 6) as p_value from pr join mp x on x.id = subject join mp y on y.id = object join sy s on s.concept_1 = x.concept and s.concept_2 = y.concept group by subject, object", CLINIC + ", " + _MAP)
def o4q(spark, d):
    mapping, pairs = _mapped(spark, d)
    table = O.pair_statistics(clinic(spark, d)).withColumn("chi_square", F.round("chi_square", 6)).withColumn("p_value", 1 / (1 + F.col("chi_square")))
    return O.clinical_p(pairs, mapping, table).withColumn("p_value", F.round("p_value", 6))


@query("o5_node_docs", "select concept, array_to_string(list(distinct doc order by doc)[1:10], ',') as docs from (select object as concept, subject as doc from edges where predicate = 'contains') group by concept")
def o5(spark, d):
    ids = nodes_of(spark, d).where("prefix = 'P'").select(F.col("id").alias("concept"))
    return O.node_docs(part_docs(spark, d), ids, 10).select("concept", F.array_join("docs", ",").alias("docs"))


@query("o6_exposures", "select subject, object, round(coalesce(any_value(p), 1.0), 6) as p_value from pairs left join (select object as o, 1 / cast(count(*) as double) as p from edges where predicate = 'supplies' group by object) on o = object group by subject, object", PAIRS)
def o6(spark, d):
    p = edges_of(spark, d, "supplies").groupBy("object").agg((1 / F.count(F.lit(1))).alias("p_value"))
    return O.attach(part_pairs(spark, d), part_pairs(spark, d).join(p, "object"), "p_value", 1.0).withColumn("p_value", F.round("p_value", 6))


@query("o7_result_pairs", "select distinct a.subject, c.object from edges a join edges c on c.subject = a.object where a.predicate = 'placed' and c.predicate = 'contains'")
def o7(spark, d):
    a = edges_of(spark, d, "placed")
    r = a.select(F.col("object").alias("result_id"), F.lit("n0").alias("qnode_key"), F.col("subject").alias("node_id"))
    c = edges_of(spark, d, "contains").select(F.col("subject").alias("result_id"), F.lit("n2").alias("qnode_key"), F.col("object").alias("node_id"))
    return O.result_pairs(r.union(c), "n0", "n2")


@query("o8_inherited_groups", """
select e.id, case when coalesce(u.g, p.g) = coalesce(p.g, u.g) then coalesce(u.g, p.g) end as option_group, coalesce(u.g <> p.g, false) as clash
from edges e left join g u on u.id = e.subject left join g p on p.id = e.object where e.predicate = 'contains'""", """
g as (select id, case when list_contains(categories, '1-URGENT') or list_contains(categories, 'Brand#12') then 'a'
  when list_contains(categories, '5-LOW') or list_contains(categories, 'Brand#23') then 'b' end as g from nodes where prefix in ('O', 'P'))""")
def o8(spark, d):
    has = lambda *names: F.arrays_overlap("categories", F.array(*[F.lit(x) for x in names]))
    group = F.when(has("1-URGENT", "Brand#12"), "a").when(has("5-LOW", "Brand#23"), "b")
    groups = nodes_of(spark, d).where("prefix in ('O', 'P')").select(F.col("id").alias("node_id"), group.alias("option_group"))
    return O.inherited_groups(edges_of(spark, d, "contains"), groups)


@query("o9_rebind_virtual", """
select subject as result_id, 'e1' as qedge_key, id as edge_id from edges where predicate = 'contains'
union select subject, 'V1', 'V1--' || subject || '--' || object from edges where predicate = 'contains' and amount >= 40""")
def o9(spark, d):
    e = edges_of(spark, d, "contains")
    bound = e.select(F.col("subject").alias("result_id"), F.explode(F.array("subject", "object")).alias("node_id"))
    virtual = O.virtual_edges(e.where("amount >= 40"), "V1", "near", "amount")
    return O.rebind(e.select(F.col("subject").alias("result_id"), F.lit("e1").alias("qedge_key"), F.col("id").alias("edge_id")), bound, virtual)


@query("o_attach_attribute", """
select e.id, coalesce(n.v, 0.0) as score from edges e left join (select 'S:' || l_suppkey as s, 'P:' || l_partkey as p, cast(max(l_quantity) as double) as v from lineitem where l_returnflag = 'R' group by 1, 2) n
on n.s = e.subject and n.p = e.object where e.predicate = 'supplies'""")
def attach(spark, d):
    v = lens.table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(lens.curie("P", "l_partkey").alias("subject"), lens.curie("S", "l_suppkey").alias("object")).agg(F.max("l_quantity").cast("double").alias("score"))
    return O.attach(edges_of(spark, d, "supplies"), v, "score", 0.0).select("id", "score")
