"""Ranking and ordering queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plexus.catalog.base import query
from plexus.functions import scores as N
from plexus.operators import rank as R
from plexus.sources.lens import edges_of
from plexus.sources.scratch import saved

#: A result is an order of a customer; its query edges are e0 (placed) and e1 (contains).
RES = """
b as (select object as result_id, 'e0' as qedge_key, id as edge_id from edges where predicate = 'placed'
  union all select subject, 'e1', id from edges where predicate = 'contains'),
cf as (select id, case when source = 'lineitem' then 1 - (1 - 0.5::double) * (1 - 0.9::double * (1 / (1 + exp(-0.1::double * (amount - 25)))))
  when amount > 250000 then 0.9 else 1 - (1 - 0.93::double) * (1 - 0.5::double * (1 / (1 + exp(-0.1::double * (evidence - 25))))) end as confidence,
  case when source = 'lineitem' then cast(cast(floor(amount / 10) as bigint) as varchar) else source end as kind from edges where predicate in ('placed', 'contains')),
wk as (select result_id, qedge_key, kind, avg(confidence) as confidence from b join cf on cf.id = b.edge_id group by result_id, qedge_key, kind),
w as (select result_id, qedge_key, 1 - product(1 - confidence) as weight from wk group by result_id, qedge_key),
s as (select result_id, min(weight) as max_flow, product(weight) / 2 as longest_path, sqrt(sum(weight * weight)) as frobenius from w group by result_id),
q as (select *, round((cume_dist() over (order by round(max_flow, 9)) + cume_dist() over (order by round(longest_path, 9)) + cume_dist() over (order by round(frobenius, 9))) / 3, 3) as score from s)"""


def bound(spark, d):
    e0 = edges_of(spark, d, "placed").select(F.col("object").alias("result_id"), F.lit("e0").alias("qedge_key"), F.col("id").alias("edge_id"))
    return e0.union(edges_of(spark, d, "contains").select("subject", F.lit("e1"), "id"))


def confidences(spark, d):
    e = edges_of(spark, d, "placed").union(edges_of(spark, d, "contains"))
    x = F.when(F.col("source") == "lineitem", F.col("amount")).otherwise(F.col("evidence").cast("double"))
    weight = F.when(F.col("source") == "lineitem", 0.9).otherwise(0.5)
    s = e.select("id", weight.alias("weight"), N.logistic(x, 0.1, 25.0).alias("score"))
    manual = (F.col("source") == "orders") & (F.col("amount") > 250000)
    kind = F.when(F.col("source") == "lineitem", F.floor(F.col("amount") / 10).cast("string")).otherwise(F.col("source"))
    e = e.select("id", "source", manual.alias("manual"), kind.alias("kind"))
    return R.edge_confidence(e, s, {"orders": 0.93}).select("id", "kind", "confidence")


def chain(spark, d):
    return R.chain_scores(R.qedge_weights(bound(spark, d), confidences(spark, d)), 2)


@query("k1_attribute_ranges", "select predicate as name, min(amount) as least, max(amount) as most, count(*) as n from edges group by predicate")
def k1(spark, d):
    from plexus.sources import lens

    g = lens.graph(spark, d).edges
    a = g.select("id", F.col("predicate").alias("name"), F.col("amount").alias("value"))
    odd = a.limit(1).select("id", "name", F.lit(float("nan")).alias("value"))
    return R.attribute_ranges(a.union(odd))


_NORMAL = ("probability_treats", "normalized_google_distance", "probability", "paired_concept_frequency", "observed_expected_ratio", "jaccard_index", "cmap")
_LOGS = ("chi_square", "pValue", "fisher_exact_test_p-value", "feature_coefficient")


def _normal_sql() -> str:
    out = []
    for n in _NORMAL + _LOGS:
        if n == "jaccard_index":
            e = "x / 50.0::double"
        elif n == "cmap":
            e = "abs(x / 100)"
        else:
            form, k, x0 = N.LOGISTIC[n]
            y = {"x": "x", "-ln": "-ln(x)", "ln|x|": "ln(abs(x))"}[form]
            e = f"1 / (1 + exp(-({k}::double) * ({y} - {x0}::double)))"
        out.append(f"select '{n}' as name, id, round({e}, 6) as score from (select id, amount / 50 as x from edges where predicate = 'contains')")
    return " union all ".join(out)


@query("k2_normalizers", _normal_sql())
def k2(spark, d):
    x = edges_of(spark, d, "contains").select("id", (F.col("amount") / 50).alias("x"))
    out = None
    for n in _NORMAL + _LOGS:
        part = x.select(F.lit(n).alias("name"), "id", F.round(N.normalized(n, F.col("x"), F.lit(50.0)), 6).alias("score"))
        out = part if out is None else out.union(part)
    return out


@query("k3_publications", "select id, round(1 / (1 + exp(-3.16993::double * (ln(evidence) - 1.60943::double))), 6) as score from edges where predicate = 'supplies'")
def k3(spark, d):
    return edges_of(spark, d, "supplies").select("id", F.round(N.publications_score(F.col("evidence")), 6).alias("score"))


@query("k4_edge_confidence", "select id, round(confidence, 6) as confidence from cf", RES)
def k4(spark, d):
    return confidences(spark, d).select("id", F.round("confidence", 6).alias("confidence"))


@query("k5_result_edge_weight", "select result_id, qedge_key, round(weight, 6) as weight from w", RES)
def k5(spark, d):
    return R.qedge_weights(bound(spark, d), confidences(spark, d)).withColumn("weight", F.round("weight", 6))


@query("k6_chain_scores", "select result_id, round(max_flow, 6) as max_flow, round(longest_path, 6) as longest_path, round(frobenius, 6) as frobenius from s", RES)
def k6(spark, d):
    return chain(spark, d).select("result_id", *[F.round(c, 6).alias(c) for c in ("max_flow", "longest_path", "frobenius")])


@query("k6_pattern_scores", """
select result_id, round(1 - product(1 - least(weight, 1)), 6) as max_flow, round(1 - product(1 - least(weight, 1)), 6) as longest_path, round(sqrt(sum(weight * weight)), 6) as frobenius
from w where result_id in (select result_id from w group by result_id having count(*) = 2) group by result_id""", RES)
def k6p(spark, d):
    w = R.qedge_weights(bound(spark, d), confidences(spark, d))
    both = w.groupBy("result_id").count().where("count = 2").select("result_id")
    out = R.pattern_scores(w.join(both, "result_id", "left_semi"), {"e0": ("o", "c"), "e1": ("o", "p")})
    return out.select("result_id", *[F.round(c, 6).alias(c) for c in ("max_flow", "longest_path", "frobenius")])


#: Two ways through an order: over its quantities and discounts, or over its lines and taxes; a third edge joins the ways.
DIAMOND = {"e0": ("a", "b"), "e1": ("b", "d"), "e2": ("a", "c"), "e3": ("c", "d"), "e4": ("b", "c")}


@query("k6_diamond_scores", """
select result_id, round(least(e0 + e2, e1 + e3, e0 + e3, e1 + e4 + e2), 10) as max_flow, round(least((e0 * e1 + e2 * e3) / 2, 1), 10) as longest_path,
  round(sqrt(e0 * e0 + e1 * e1 + e2 * e2 + e3 * e3 + e4 * e4), 10) as frobenius
from (select result_id, e0, e1, e2, e3, e4 from x)""", """
x as (select 'O:' || l_orderkey as result_id, least(avg(l_quantity) / 100, 1) as e0, avg(l_discount) * 4 as e1, count(*) / 20.0::double as e2, avg(l_tax) * 5 as e3,
  min(l_quantity) / 200 as e4 from lineitem group by l_orderkey)""")
def k6d(spark, d):
    from plexus.sources.lens import table

    x = table(spark, d, "lineitem").groupBy(F.concat(F.lit("O:"), F.col("l_orderkey").cast("string")).alias("result_id")).agg(
        F.least(F.avg("l_quantity") / 100, F.lit(1.0)).alias("e0"), (F.avg("l_discount") * 4).alias("e1"), (F.count(F.lit(1)) / 20).alias("e2"),
        (F.avg("l_tax") * 5).alias("e3"), (F.min("l_quantity") / 200).alias("e4"))
    long = x.select("result_id", F.explode(F.array(*[F.struct(F.lit(k).alias("qedge_key"), F.col(k).alias("weight")) for k in DIAMOND])).alias("x")).select("result_id", "x.*")
    out = R.pattern_scores(long, DIAMOND)
    return out.select("result_id", *[F.round(c, 10).alias(c) for c in ("max_flow", "longest_path", "frobenius")])


def scored(spark, d):
    s = chain(spark, d)
    return R.quantile_ranks(s.select("result_id", *[F.round(c, 9).alias(c) for c in ("max_flow", "longest_path", "frobenius")]))


@query("k9_quantile_rank", "select result_id, score from q", RES)
def k9(spark, d):
    return scored(spark, d).select("result_id", "score")


@query("k10_rank_results", "select result_id, score, row_number() over (order by score desc, result_id) as place from q order by score desc, result_id limit 200", RES)
def k10(spark, d):
    return R.limit_results(scored(spark, d).select("result_id", "score"), [F.desc("score"), F.asc("result_id")], 200)


@query("k11_tie_breaking", """
select result_id, round(greatest(min(score + i * 0.001::double) over (order by i) - i * 0.001::double, 0), 3) as score from t where i < 1000
union all select result_id, 0 from t where i >= 1000""", RES + ", t as (select result_id, score, row_number() over (order by score desc, result_id) - 1 as i from q)")
def k11(spark, d):
    return R.break_ties(scored(spark, d), [F.desc("score"), F.asc("result_id")]).select("result_id", "score")


@query("s1_sort_by_edge_attribute", """
select result_id, key, row_number() over (order by key desc nulls last, result_id) as place from (
  select result_id, sum(amount) as key from b left join (select id, amount from edges where amount < 48) e on e.id = b.edge_id and b.qedge_key = 'e1' group by result_id)
order by key desc nulls last, result_id limit 300""", RES)
def s1(spark, d):
    a = edges_of(spark, d, "contains").where("amount < 48").select("id", F.lit("quantity").alias("name"), F.col("amount").alias("value"))
    return R.sorted_by(R.attribute_sums(bound(spark, d), a, "quantity"), True, 300)


@query("s2_sort_by_node_attribute", """
select result_id, key, row_number() over (order by key nulls last, result_id) as place from (
  select e.subject as result_id, cast(sum(p_size) as double) as key from edges e join part on e.object = 'P:' || p_partkey where e.predicate = 'contains' group by e.subject)
order by key nulls last, result_id limit 300""")
def s2(spark, d):
    from plexus.sources import lens

    nodes = edges_of(spark, d, "contains").select(F.col("subject").alias("result_id"), F.col("object").alias("node_id"))
    size = lens.table(spark, d, "part").select(lens.curie("P", "p_partkey").alias("id"), F.lit("size").alias("name"), F.col("p_size").cast("double").alias("value"))
    return R.sorted_by(R.attribute_sums(nodes, size, "size", "node_id"), False, 300)


@query("s2_category_attribute", """
select result_id, key, row_number() over (order by key nulls last, result_id) as place from (
  select e.subject as result_id, cast(sum(case when p_brand = 'Brand#13' then p_size end) as double) as key from edges e join part on e.object = 'P:' || p_partkey where e.predicate = 'contains' group by e.subject)
order by key nulls last, result_id limit 300""")
def s2c(spark, d):
    from plexus.sources import lens

    nodes = edges_of(spark, d, "contains").select(F.col("subject").alias("result_id"), F.col("object").alias("node_id"))
    size = lens.table(spark, d, "part").select(lens.curie("P", "p_partkey").alias("id"), F.lit("size").alias("name"), F.col("p_size").cast("double").alias("value"))
    return R.sorted_by(R.attribute_sums(nodes, size, "size", "node_id", category="Brand#13", nodes=lens.nodes_of(spark, d)), False, 300)


@query("s2_document_counts", """
select result_id, key, row_number() over (order by key desc nulls last, result_id) as place from (
  select e.subject as result_id, count(distinct s.subject) as key from edges e join edges s on s.object = e.object and s.predicate = 'supplies' where e.predicate = 'contains' group by e.subject)
order by key desc nulls last, result_id limit 300""")
def s2d(spark, d):
    nodes = edges_of(spark, d, "contains").select(F.col("subject").alias("result_id"), F.col("object").alias("node_id"))
    docs = edges_of(spark, d, "supplies").select(F.col("object").alias("id"), F.col("subject").alias("doc"))
    return R.top_document_counts(nodes, docs, 300)


@query("s3_sort_by_score", "select result_id, score as key, row_number() over (order by score, result_id) as place from q order by score, result_id limit 100", RES)
def s3(spark, d):
    return R.sorted_by(scored(spark, d).select("result_id", F.col("score").alias("key")), False, 100)


@query("s4_sort_by_edge_count", "select result_id, count(*) as key, row_number() over (order by count(*) desc, result_id) as place from b group by result_id order by 2 desc, 1 limit 100", RES)
def s4(spark, d):
    return R.sorted_by(R.binding_counts(bound(spark, d)), True, 100)


@query("s5_sort_by_node_count", "select e.subject as result_id, count(distinct object) as key, row_number() over (order by count(distinct object), e.subject) as place from edges e where predicate = 'contains' group by e.subject order by 2, 1 limit 100")
def s5(spark, d):
    nodes = edges_of(spark, d, "contains").select(F.col("subject").alias("result_id"), F.col("object").alias("node_id")).distinct()
    return R.sorted_by(R.binding_counts(nodes), False, 100)


@query("s6_limit_results", "select result_id, row_number() over (order by result_id) as place from (select distinct result_id from b) order by 1 limit 50", RES)
def s6(spark, d):
    return R.limit_results(bound(spark, d).select("result_id").distinct(), [F.asc("result_id")], 50)


@query("s7_prune_after_limit", "select id from nodes where id in (select edge_node from (select unnest([e.subject, e.object]) as edge_node from b join edges e on e.id = b.edge_id where b.result_id in (select distinct result_id from b order by 1 limit 50)))", RES)
def s7(spark, d):
    from plexus.operators.match import prune_graph
    from plexus.sources import lens

    g = lens.graph(spark, d, ("placed", "contains"))
    g = lens.PropertyGraph(g.nodes, saved(g.edges))  # read four times
    b = saved(bound(spark, d))
    top = R.limit_results(b.select("result_id").distinct(), [F.asc("result_id")], 50)
    kept = b.join(top.select("result_id"), "result_id", "left_semi")
    nodes = kept.join(g.edges.select(F.col("id").alias("edge_id"), "subject", "object"), "edge_id")
    nodes = nodes.select("result_id", F.explode(F.array("subject", "object")).alias("node_id"))
    return prune_graph(g.nodes, g.edges, nodes, kept)[0].select("id")
