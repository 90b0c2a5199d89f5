"""Batch pipeline queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plexus.catalog.base import query
from plexus.etl import canonical as C
from plexus.etl import cooccurrence as Y
from plexus.etl import synonyms as S
from plexus.functions.text import clean_concept, simple_name
from plexus.sources import lens
from plexus.sources.lens import edges_of, nodes_of, ontology

#: Raw customers fold to one canonical customer of each hundred.
MAP = """
mp as (select id, 'C:' || (cast(substr(id, 3) as int) // 100 * 100 + 1) as canonical_id from nodes where prefix = 'C'),
rn as (select n.id, n.name, n.categories, n.name || ' of ' || n.categories[2] as description, coalesce(m.canonical_id, n.id) as cid from nodes n left join mp m on m.id = n.id where n.prefix = 'C')"""


def mapping(spark, d):
    k = F.floor(F.substring("id", 3, 9).cast("int") / 100) * 100 + 1
    return nodes_of(spark, d).where("prefix = 'C'").select("id", F.concat(F.lit("C:"), k.cast("string")).alias("canonical_id"))


def raw_nodes(spark, d):
    n = nodes_of(spark, d).where("prefix = 'C'")
    return n.select("id", "name", "categories", F.concat("name", F.lit(" of "), F.get("categories", F.lit(1))).alias("description"),
                    F.array(F.concat(F.lit("PMID:"), F.substring("id", 3, 9))).alias("publications"), F.concat(F.lit("http://example.org/"), "id").alias("iri"))


@query("b1_canonicalize_nodes", """
select cid as id, coalesce(max(case when id = cid then name end), min(name)) as name, string_agg(distinct c, ',' order by c) as categories,
  max(case when id = cid then 'http://example.org/' || id end) as iri, count(distinct id) as n, max(length(description)) as longest
from (select *, unnest(categories) as c from rn) group by cid""", MAP)
def b1(spark, d):
    out = C.canonicalize_nodes(raw_nodes(spark, d), mapping(spark, d))
    return out.select("id", "name", F.array_join("categories", ",").alias("categories"), "iri",
                      F.size("equivalent_ids").cast("long").alias("n"), F.length("description").cast("long").alias("longest"))


#: Edges with qualifiers: the direction asks for the patched predicate, the aspect tells edges apart.
RAW = MAP + """,
re as (select e.id, coalesce(m.canonical_id, e.subject) as subject, e.object, case when amount > 5000 then 'increased' else '' end as dir, case when cast(substr(e.subject, 3) as int) % 2 = 0 then 'activity' else '' end as asp,
    'PMID:' || evidence || '.' || (cast(floor(amount) as bigint) % 30) as pub
  from edges e left join mp m on m.id = e.subject where e.predicate = 'located_in' and e.source = 'customer' and not e.amount < 0),
rc as (select subject || '--regulates--' || case when dir <> '' then 'causes' else '' end || '--' || case when dir <> '' then 'activity_or_abundance' else asp end || '--' || dir || '--' || object || '--customer' as id,
  count(*) as n_raw, array_to_string(list(distinct pub order by pub)[1:5], ',') as pubs, string_agg(distinct pub, ',' order by pub) as all_pubs, max(id) as last_raw from re group by 1)"""


def canonical_edges(spark, d):
    e = edges_of(spark, d, "located_in").where("source = 'customer'").withColumn("predicate", F.lit("regulates"))
    pub = F.concat(F.lit("PMID:"), F.col("evidence").cast("string"), F.lit("."), (F.floor("amount") % 30).cast("string"))
    e = e.withColumn("qualified_object_direction", F.when(F.col("amount") > 5000, "increased"))
    e = e.withColumn("qualified_object_aspect", F.when(F.substring("subject", 3, 9).cast("int") % 2 == 0, "activity"))
    e = e.withColumn("publications", F.array(pub)).withColumn("publications_info", F.create_map(pub, F.col("id")))
    gone = e.limit(1).withColumn("predicate", F.lit("applied_to_treat")).withColumn("source", F.lit("chembl"))
    return C.canonicalize_edges(e.unionByName(gone), mapping(spark, d), F.col("amount") < 0, 5)


@query("b2_canonicalize_edges", "select id, n_raw, pubs from rc", RAW)
def b2(spark, d):
    return canonical_edges(spark, d).select("id", "n_raw", F.array_join("publications", ",").alias("pubs"))


@query("b2_publications_info", "select id, array_to_string(list(p || '=' || i order by p)[1:5], ',') as info from (select r.subject || '--regulates--' || case when dir <> '' then 'causes' else '' end || '--' || case when dir <> '' then 'activity_or_abundance' else asp end || '--' || dir || '--' || object || '--customer' as id, pub as p, max(r.id) as i from re r group by 1, 2) group by id", RAW)
def b2i(spark, d):
    entries = F.array_join(F.transform(F.map_entries("publications_info"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return canonical_edges(spark, d).select("id", entries.alias("info"))


@query("b4_number_edges", "select id, row_number() over (order by id) as number from rc", RAW)
def b4(spark, d):
    return C.number_edges(canonical_edges(spark, d).select("id"))


@query("b3_best_description", "select cid as id, max(length(description)) as n from rn where length(description) < 10000 group by cid", MAP)
def b3(spark, d):
    return C.canonicalize_nodes(raw_nodes(spark, d), mapping(spark, d)).select("id", F.length("description").cast("long").alias("n"))


@query("b5_remove_general", "select id from edges where predicate = 'located_in' and subject not in (select canonical_id from mp where id in ('C:150', 'C:320')) and (substr(subject, 1, 1) <> 'C' or subject in (select canonical_id from mp))", MAP)
def b5(spark, d):
    n = C.canonicalize_nodes(raw_nodes(spark, d), mapping(spark, d)).select("id", "equivalent_ids")
    others = nodes_of(spark, d).where("prefix <> 'C'").select("id", F.array("id").alias("equivalent_ids"))
    blocked = spark.createDataFrame([("C:150",), ("C:320",)], "id string")
    return C.remove_general(n.union(others), edges_of(spark, d, "located_in"), blocked)[1].select("id")


LABELS = "lb as (select distinct n.id, o.ancestor as label from (select id, unnest(categories) as c from nodes) n join ontology o on o.child = n.c)"


@query("b6_neighbour_counts", """
select x.id, l.label, count(*) as n from (select distinct * from (select subject as id, object as near from edges where predicate in ('placed', 'contains') union all select object, subject from edges where predicate in ('placed', 'contains'))) x
join lb l on l.id = x.near group by x.id, l.label""", LABELS)
def b6(spark, d):
    g = lens.graph(spark, d, ("placed", "contains"))
    return C.neighbour_counts(g.nodes, g.edges, ontology(spark))


@query("b6_top_by_degree", "select id, count(*) as degree from (select subject as id from edges union all select object from edges) group by id order by 2 desc, 1 limit 100")
def b6t(spark, d):
    return C.top_by_degree(lens.graph(spark, d).edges, 100)


@query("b7_category_counts", "select label, count(*) as n from lb group by label", LABELS)
def b7(spark, d):
    return C.category_counts(nodes_of(spark, d), ontology(spark))


@query("b8_marked_neighbours", "select subject as id from edges where object = 'N:3' union select object from edges where subject = 'N:3'")
def b8(spark, d):
    return C.marked_neighbours(lens.graph(spark, d, ("located_in", "part_of")).edges, "N:3")


@query("b9_lite_export", "select id, name, array_to_string(categories, ';') as categories from nodes")
def b9(spark, d):
    return C.lite(nodes_of(spark, d), ["id", "name", "categories"])


@query("b10_match_graph", "select subject as a, object as b, predicate as kind, source as upstream from edges where predicate in ('supplies', 'located_in')")
def b10(spark, d):
    return S.match_graph(lens.graph(spark, d).edges, ("supplies", "located_in"))


MERGE = """
m1 as (select 'P:' || p_partkey as id, p_name as name, p_brand as category from part where p_partkey % 3 <> 0),
m2 as (select 'P:' || p_partkey as id, upper(p_name) as name, p_type as category from part where p_partkey % 2 = 0)"""


@query("b11_merge_match_graphs", "select coalesce(m1.id, m2.id) as id, coalesce(m2.name, m1.name) as name, coalesce(m2.category, m1.category) as category from m1 full join m2 on m1.id = m2.id", MERGE)
def b11(spark, d):
    p = lens.table(spark, d, "part")
    one = p.where("p_partkey % 3 <> 0").select(lens.curie("P", "p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("category"))
    two = p.where("p_partkey % 2 = 0").select(lens.curie("P", "p_partkey").alias("id"), F.upper("p_name").alias("name"), F.col("p_type").alias("category"))
    return S.merge_nodes(one, two)


#: Parts of one brand and size go by the same name.
SYN = """
sn as (select 'P:' || p_partkey as id, p_brand || ' size-' || p_size as name, p_type as branch from part),
ne as (select a.id as a, b.id as b from sn a join sn b on regexp_replace(lower(a.name), '[^a-z0-9]', '', 'g') = regexp_replace(lower(b.name), '[^a-z0-9]', '', 'g') and a.id < b.id)"""


def syn_nodes(spark, d):
    p = lens.table(spark, d, "part")
    return p.select(lens.curie("P", "p_partkey").alias("id"), F.concat("p_brand", F.lit(" size-"), F.col("p_size").cast("string")).alias("name"), F.col("p_type").alias("branch"))


@query("b12_name_similarity_edges", "select a, b from ne", SYN)
def b12(spark, d):
    return S.name_edges(syn_nodes(spark, d))


def syn_pairs(spark, d):
    n = S.name_edges(syn_nodes(spark, d)).withColumn("kind", F.lit("similar_name"))
    k = F.substring("a", 3, 9).cast("int") + F.substring("b", 3, 9).cast("int")
    return S.weighted(n.union(n.where(k % 4 == 0).select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit("same_as").alias("kind"))))


def syn_groups(n):
    """The pairs of ``syn_pairs`` as groups: a name's bearers, and those whose numbers' sum is a multiple of four."""
    named = S.name_groups(n).withColumn("r", F.substring("id", 3, 9).cast("int") % 4)
    same = lambda r: F.concat_ws(" ", "key", r)
    here, there = F.col("r"), (4 - F.col("r")) % 4
    spoken = named.select(same(here).alias("group"), "id", F.lit(S.WEIGHTS["same_as"]).alias("weight"), (here == there).alias("hears"), F.lit(True).alias("speaks"))
    heard = named.where(here != there).select(same(there), "id", F.lit(S.WEIGHTS["same_as"]), F.lit(True), F.lit(False))
    return named.select(F.col("key").alias("group"), "id", F.lit(S.WEIGHTS["similar_name"]).alias("weight"), F.lit(True).alias("hears"), F.lit(True).alias("speaks")).union(spoken).union(heard)


PAIRS = ", wp as (select a, b, 0.1::double + case when (cast(substr(a, 3) as int) + cast(substr(b, 3) as int)) % 4 = 0 then 1.0::double else 0 end as weight from ne)"


@query("b13_weighted_pairs", "select a, b, round(weight, 6) as weight from wp", SYN + PAIRS)
def b13(spark, d):
    return syn_pairs(spark, d).withColumn("weight", F.round("weight", 6))


@query("b14_conflict_removal", "select wp.a, wp.b from wp join sn x on x.id = wp.a join sn y on y.id = wp.b where x.branch = y.branch or (wp.a < 'P:2')", SYN + PAIRS)
def b14(spark, d):
    pairs = syn_pairs(spark, d)
    branch = syn_nodes(spark, d).select("id", "branch")
    return S.without_conflicts(pairs, branch, pairs.where("a < 'P:2'").select("a", "b")).select("a", "b")


@query("b15_label_propagation")
def b15(spark, d):
    n = syn_nodes(spark, d)
    return S.label_propagation(n.select("id"), None, groups=syn_groups(n))


CLUSTER = SYN + PAIRS + """,
lab as (select id, 'P:' || min(cast(substr(id, 3) as int)) over (partition by name) as label, name from sn),
cl as (select l.label as cluster_id, count(*) as size, coalesce(max(case when id = label then name end), min(name)) as name, string_agg(id, ',' order by id) as member_ids from lab l group by l.label),
ce as (select x.label as cluster_id, count(*) as n_edges from wp join lab x on x.id = wp.a join lab y on y.id = wp.b where x.label = y.label group by x.label)"""


def built_clusters(spark, d):
    n = syn_nodes(spark, d)
    first = n.groupBy("name").agg(F.concat(F.lit("P:"), F.min(F.substring("id", 3, 9).cast("int")).cast("string")).alias("label"))
    return S.clusters(n, n.join(first, "name").select("id", "label"), None, S.name_groups(n))  # each pair of a name is one edge


@query("b16_clusters_table", "select cl.cluster_id, cl.size, cl.name, cl.member_ids, coalesce(n_edges, 0) as n_edges from cl left join ce on ce.cluster_id = cl.cluster_id", CLUSTER)
def b16(spark, d):
    return built_clusters(spark, d).withColumn("member_ids", F.array_join("member_ids", ","))


@query("b17_cluster_histogram", "select size, count(*) as n, round(avg(case when size > 1 then coalesce(n_edges, 0) / (size * (size - 1) / 2) end), 6) as density from cl left join ce on ce.cluster_id = cl.cluster_id group by size", CLUSTER)
def b17(spark, d):
    return S.size_histogram(built_clusters(spark, d)).withColumn("density", F.round("density", 6))


STAGED = "stg as (select distinct p.p_brand || '  “Size” ' || p.p_size || '–β' as raw, l.l_orderkey as doc from lineitem l join part p on p.p_partkey = l.l_partkey), cn as (select regexp_replace(replace(replace(replace(replace(raw, 'β', 'beta'), '–', '-'), '“', ''''), '”', ''''), '\\s+', ' ', 'g') as name, doc from stg), nx as (select min(name) as concept_name, list(distinct doc order by doc) as docs from cn group by regexp_replace(lower(name), '[^a-z0-9]', '', 'g'))"


def staged(spark, d):
    p = lens.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_size")
    x = lens.table(spark, d, "lineitem").select("l_partkey", F.col("l_orderkey").alias("doc")).join(p, "l_partkey")
    return x.select(F.concat("p_brand", F.lit("  “Size” "), F.col("p_size").cast("string"), F.lit("–β")).alias("name"), "doc").distinct()


@query("b18_concept_name_index", "select concept_name, len(docs) as n, array_to_string(docs[1:5], ',') as docs from nx", STAGED)
def b18(spark, d):
    out = Y.name_index(staged(spark, d))
    return out.select("concept_name", F.size("docs").cast("long").alias("n"), F.array_join(F.slice("docs", 1, 5).cast("array<string>"), ",").alias("docs"))


@query("b19_concept_index", """
select concept, count(*) as n, cast(sum(doc) as bigint) as total from (
  select distinct 'B:' || substr(concept_name, 7, 2) as concept, unnest(docs) as doc from nx
  union select x, cast(floor(amount) as bigint) from (select unnest([subject, object]) as x, amount from edges where predicate = 'located_in' and source = 'supplier' and amount >= 0)) group by concept""", STAGED)
def b19(spark, d):
    names = Y.name_index(staged(spark, d))
    resolved = names.select("concept_name", F.concat(F.lit("B:"), F.substring("concept_name", 7, 2)).alias("concept"))
    e = edges_of(spark, d, "located_in").where("source = 'supplier'")
    e = e.withColumn("publications", F.array(F.concat(F.lit("PMID:"), F.floor("amount").cast("string")), F.lit("DOI:1")))
    out = Y.concept_index(names, resolved, Y.harvested(e))
    return out.select("concept", F.size("docs").cast("long").alias("n"), F.aggregate("docs", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("b20_concept_cleaning", "select distinct raw as name, name as cleaned from (select stg.raw, cn.name from stg join cn on cn.doc = stg.doc and regexp_replace(stg.raw, '[^A-Za-z0-9]', '', 'g') || 'beta' = regexp_replace(cn.name, '[^A-Za-z0-9]', '', 'g'))", STAGED)
def b20(spark, d):
    return staged(spark, d).select("name", clean_concept(F.col("name")).alias("cleaned")).distinct()


@query("b21_neighbour_table", "select 'S:1' as id, object as neighbour from edges where predicate = 'supplies' and subject = 'S:1' union select 'P:5', subject from edges where predicate = 'supplies' and object = 'P:5'")
def b21(spark, d):
    return C.neighbour_table(edges_of(spark, d, "supplies"), spark.createDataFrame([("S:1",), ("P:5",)], "id string"))


@query("b22_subclass_extract", "select distinct coalesce(m.canonical_id, e.subject) as child, e.object as parent from edges e left join mp m on m.id = e.subject where e.predicate = 'located_in'", MAP)
def b22(spark, d):
    e = edges_of(spark, d, "located_in").withColumn("publications", F.array().cast("array<string>"))
    return C.subclass_extract(e, mapping(spark, d), "located_in")


@query("text_simple_name", "select distinct p_name as name, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') as simple from part")
def simple(spark, d):
    return lens.table(spark, d, "part").select(F.col("p_name").alias("name"), simple_name(F.col("p_name")).alias("simple")).distinct()
