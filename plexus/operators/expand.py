"""Pattern expansion over edge tables.

Edges have at least ``id, subject, predicate, object``; nodes ``id, name, categories``.  Bound answers
are long tables: ``kg_nodes(qnode_key, node_id)`` and ``kg_edges(qedge_key, id, subject, object)``.
Small id lists and the ontology are literals or broadcast by their size; everything else is equi-joins.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plexus.plans.hierarchy import Hierarchy


def descendants(ontology: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """``(child)``: every type at or below one of ``wanted``."""
    return ontology.where(F.col("ancestor").isin(list(wanted))).select("child").distinct()


def of_category(nodes: DataFrame, ontology: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Nodes with a category at or below one of ``wanted``."""
    hit = nodes.select("id", F.explode("categories").alias("child")).join(descendants(ontology, wanted), "child")
    return nodes.join(hit.select("id").distinct(), "id", "left_semi")


def either_way(edges: DataFrame) -> DataFrame:
    """Every edge in both directions, as ``(id, from_id, to_id, ...)``."""
    keep = [c for c in edges.columns if c not in ("subject", "object")]
    one = edges.select(*keep, F.col("subject").alias("from_id"), F.col("object").alias("to_id"))
    two = edges.select(*keep, F.col("object").alias("from_id"), F.col("subject").alias("to_id"))
    return one.unionByName(two.where("from_id <> to_id"))


def one_hop(edges: DataFrame, start: DataFrame, end: DataFrame, predicates: Sequence[str] | None = None, directed: bool = False,
            hierarchy: Hierarchy | None = None) -> DataFrame:
    """Edges between bound start ids and end ids, ``(id, from_id, to_id, predicate)``.

    ``start(id)`` and ``end(id)`` may come from pinned ids, categories or the bindings of an earlier hop.  With a
    ``hierarchy`` the predicates stand for all below them: ``edges`` have their numbers as ``predicate_no``.
    """
    if predicates and hierarchy is not None:
        edges = edges.where(hierarchy.below("predicate_no", predicates))
    elif predicates:
        edges = edges.where(F.col("predicate").isin(list(predicates)))
    edges = edges.select("id", "subject", "object", "predicate")
    hops = edges.toDF("id", "from_id", "to_id", "predicate") if directed else either_way(edges)
    hops = hops.join(start.select(F.col("id").alias("from_id")).distinct(), "from_id", "left_semi")
    return hops.join(end.select(F.col("id").alias("to_id")).distinct(), "to_id", "left_semi")


def single_node(nodes: DataFrame, ids: Sequence[str]) -> DataFrame:
    """The pinned nodes themselves; no ids is an invalid query."""
    if not ids:
        raise ValueError("InvalidQuery: a query of one node needs ids")
    return nodes.where(F.col("id").isin(list(ids)))


def union_sources(sources: Sequence[DataFrame]) -> DataFrame:
    """The answers of all sources; absent columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)


def select_sources(meta: DataFrame, ontology: DataFrame, subject: str, predicates: Sequence[str], obj: str) -> DataFrame:
    """Sources whose metadata ``(source, subject_category, predicate, object_category)`` can answer, either way."""
    s, o = descendants(ontology, [subject]), descendants(ontology, [obj])
    ways = []
    for left, right in ((s, o), (o, s)):
        hit = meta.where(F.col("predicate").isin(list(predicates)))
        hit = hit.join(left.toDF("subject_category"), "subject_category", "left_semi")
        ways.append(hit.join(right.toDF("object_category"), "object_category", "left_semi").select("source"))
    return ways[0].union(ways[1]).distinct()


def convert_ids(ids: DataFrame, equivalents: DataFrame, supported: Sequence[str]) -> DataFrame:
    """E5: ``(id, converted)``: the id itself if its prefix is supported, else its first supported equivalent.

    ``equivalents(id, other)``; the order of ``supported`` decides, then the id.
    """
    rank = F.array_position(F.array(*[F.lit(p) for p in supported]), F.substring_index("other", ":", 1))
    # the least supported equivalent of each id comes first, in fixed memory: one number and one string
    known = equivalents.where((rank > 0) & (F.col("other") != F.col("id"))).select("id", "other", rank.alias("rank"))
    best = known.groupBy("id", "rank").agg(F.min("other").alias("other")).groupBy("id").agg(F.min(F.struct("rank", "other")).alias("b"))
    own = F.array_position(F.array(*[F.lit(p) for p in supported]), F.substring_index("id", ":", 1)) > 0
    out = ids.join(best, "id", "left")
    return out.select(*ids.columns, F.when(own, F.col("id")).otherwise(F.col("b.other")).alias("converted"))


def merge_nodes(answers: DataFrame) -> DataFrame:
    """One row per id: categories and query ids united, the name of the least source that has one."""
    named = F.min(F.when(F.col("name").isNotNull(), F.struct("source", "name")))
    return answers.groupBy("id").agg(
        named["name"].alias("name"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("categories")))).alias("categories"),
        F.array_sort(F.collect_set("query_id")).alias("query_ids"),
    )


def merge_edges(answers: DataFrame, key: Sequence[str] = ("subject", "predicate", "object", "primary_source")) -> DataFrame:
    """One row per edge key: the key of E7 as id, sources and query edges united, the first non-null evidence by least source."""
    return answers.groupBy(edge_key(*key).alias("id"), *key).agg(
        F.array_sort(F.collect_set("source")).alias("sources"), F.array_sort(F.collect_set("qedge_key")).alias("qedge_keys"),
        F.min(F.when(F.col("evidence").isNotNull(), F.struct("source", "evidence")))["evidence"].alias("evidence"))


def edge_key(*parts: Column | str) -> Column:
    """The canonical key of an edge; null parts are empty."""
    return F.concat_ws("--", *[F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts])


def bind_answers(edges: DataFrame, aux: DataFrame) -> DataFrame:
    """Bound edges (``qedge_key`` set) and those unbound ones that an aux graph ``(aux_id, edge_id)`` needs."""
    needed = aux.select(F.col("edge_id").alias("id")).distinct()
    return edges.where("qedge_key is not null").union(edges.where("qedge_key is null").join(needed, "id", "left_semi"))


def bind_nodes(nodes: DataFrame, edges: DataFrame, aux: DataFrame) -> DataFrame:
    """Bound nodes (``qnode_key`` set) and those unbound ones at an end of an edge that an aux graph needs."""
    needed = edges.join(aux.select(F.col("edge_id").alias("id")).distinct(), "id", "left_semi")
    ends = needed.select(F.explode(F.array("subject", "object")).alias("id")).distinct()
    return nodes.where("qnode_key is not null").union(nodes.where("qnode_key is null").join(ends, "id", "left_semi").select(*nodes.columns))


def pinned_guard(kg_nodes: DataFrame, pinned: DataFrame) -> DataFrame:
    """A pinned id ``(node_id, qnode_key)`` fulfils only the qnodes that pin it."""
    only = pinned.select("node_id").distinct()
    allowed = kg_nodes.join(pinned, ["node_id", "qnode_key"], "left_semi")
    return kg_nodes.join(only, "node_id", "left_anti").unionByName(allowed)


def fulfilled_edges(kg_edges: DataFrame, kg_nodes: DataFrame, qedges: DataFrame) -> DataFrame:
    """Edges whose ends fulfil the qnodes of their ``qedges(qedge_key, from_key, to_key)``, in either direction."""
    e = kg_edges.join(F.broadcast(qedges), "qedge_key")  # one row per edge of the pattern
    for end, key in (("subject", "from_key"), ("object", "to_key"), ("object", "from_key"), ("subject", "to_key")):
        ok = kg_nodes.select(F.col("node_id").alias(end), F.col("qnode_key").alias(key), F.lit(True).alias(f"{end}_{key}")).distinct()
        e = e.join(ok, [end, key], "left")
    straight = F.col("subject_from_key") & F.col("object_to_key")
    turned = F.col("object_from_key") & F.col("subject_to_key")
    return e.where(F.coalesce(straight, F.lit(False)) | F.coalesce(turned, F.lit(False))).select(*kg_edges.columns)


def remove_self_edges(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges from a node to itself go, then nodes left without any edge."""
    kept = edges.where("subject <> object")
    touched = kept.select(F.explode(F.array("subject", "object")).alias("id")).distinct()
    return nodes.join(touched, "id", "left_semi"), kept


def kryptonite(kg_edges: DataFrame, answer: DataFrame, shared: Sequence[str]) -> DataFrame:
    """Edges all of whose ends at the shared qnodes were met in the excluded edge's answer.

    ``kg_edges`` has one column per shared qnode; the test is membership per qnode, not of pairs.
    """
    out = kg_edges
    for key in shared:
        met = answer.select(key, F.lit(True).alias(f"__{key}")).distinct()
        out = out.join(met, key, "left")
    hit = reduce(lambda a, b: a & b, [F.coalesce(F.col(f"__{k}"), F.lit(False)) for k in shared])
    return out.where(~hit).select(*kg_edges.columns)


def remove_dead_ends(hops: Sequence[DataFrame], keys: Sequence[str]) -> list[DataFrame]:
    """Full semi-join reduction of a chain: hop i has columns ``keys[i], keys[i+1]``; one pass each way."""
    hops = list(hops)
    for i in range(1, len(hops)):
        hops[i] = hops[i].join(hops[i - 1].select(keys[i]).distinct(), keys[i], "left_semi")
    for i in range(len(hops) - 2, -1, -1):
        hops[i] = hops[i].join(hops[i + 1].select(keys[i + 1]).distinct(), keys[i + 1], "left_semi")
    return hops


def prune_to_top(bound: DataFrame, scored: DataFrame, threshold: int) -> DataFrame:
    """The nodes of the best results, until ``threshold`` nodes are kept.

    ``bound(result_id, node_id)``, ``scored(result_id, score)``.  A node counts at its best result; the
    top ``threshold`` are a TakeOrdered, not a full sort.
    """
    best = bound.join(scored, "result_id").groupBy("node_id").agg(F.max("score").alias("score"))
    return best.orderBy(F.desc("score"), "node_id").limit(threshold)


def prune_threshold(pinned_ends: int, large_category: bool, generic_predicate: bool) -> int:
    """How many nodes an expansion keeps."""
    if pinned_ends == 2:
        return 5000
    return (100 if generic_predicate else 200) if large_category else 500


def source_constraint(edges: DataFrame, allow: Sequence[str] = (), deny: Sequence[str] = (), own: str = "plexus") -> DataFrame:
    """Edges with a source among ``allow`` (if given) and not only denied ones; own edges are exempt.

    ``sources`` is an array column.  All edges that break the constraint go.
    """
    foreign = F.array_except("sources", F.array(F.lit(own)))
    ok = F.size(foreign) == 0
    left = F.array_except(foreign, F.array(*[F.lit(x) for x in deny])) if deny else foreign
    good = F.size(left) > 0
    if allow:
        good = good & F.arrays_overlap(left, F.array(*[F.lit(x) for x in allow]))
    return edges.where(ok | good)


def node_constraint(nodes: DataFrame, approved: DataFrame, negate: bool = False) -> DataFrame:
    """Nodes inside (or, negated, outside) the approved set ``(id)``."""
    return nodes.join(approved.select("id").distinct(), "id", "left_anti" if negate else "left_semi")


#: Which edges may stand for "treats": predicate (None: any), sources, attribute (None: none is
#: needed), least value, and whether the value must be above it.  The first rule that fits an edge decides.
TREATS_RULES = (
    ("in_clinical_trials_for", ("multiomics-clinicaltrials",), "elevate_to_prediction", 1.0, False),
    ("applied_to_treat", ("multiomics-drugapprovals", "faers"), "number_of_cases", 24.0, True),
    ("treats_or_applied_or_studied_to_treat", ("text-mining-provider-cooccurrence",), "evidence_count", 5.0, True),
    (None, ("ctd",), None, 0.0, False),
    (None, ("semmeddb",), "publications", 10.0, False),
)


def elevated(edges: DataFrame, attrs: DataFrame, rules: Sequence[tuple] = TREATS_RULES) -> DataFrame:
    """The edges ``(id, predicate, sources, ...)`` that a rule raises.

    ``attrs(id, name, value)``.  A rule fits an edge of its predicate and one of its sources that has its
    attribute; edges that no rule fits are not raised, nor are those whose value does not reach the rule's.
    """
    names = sorted({r[2] for r in rules if r[2]})
    wide = attrs.where(F.col("name").isin(names)).groupBy(F.col("id").alias("__id")).agg(
        *[F.max(F.when(F.col("name") == n, F.col("value"))).alias(f"__a{i}") for i, n in enumerate(names)])
    verdict = F.lit(False)
    for predicate, sources, attribute, least, above in reversed(rules):
        fits = F.arrays_overlap("sources", F.array(*[F.lit(x) for x in sources]))
        fits = fits & (F.col("predicate") == predicate) if predicate else fits
        enough = F.lit(True)
        if attribute:
            value = F.col(f"__a{names.index(attribute)}")
            fits, enough = fits & value.isNotNull(), value > least if above else value >= least
        verdict = F.when(F.coalesce(fits, F.lit(False)), enough).otherwise(verdict)
    return edges.join(wide, F.col("id") == F.col("__id"), "left").where(verdict).select(*edges.columns)


def lump(edges: DataFrame, attrs: DataFrame, qedge_key: str, rules: Sequence[tuple] = TREATS_RULES, predicate: str = "treats") -> tuple[DataFrame, DataFrame]:
    """``(lumped, support)``: one edge per ends for the query edge, and the raised edges under a query edge of their own.

    The edges that are not raised keep the query edge; ``edges`` without ``support`` are those.
    """
    support = elevated(edges, attrs, rules)
    lumped = support.groupBy("subject", "object").agg(F.count(F.lit(1)).alias("n_edges"), F.array_sort(F.collect_set("id")).alias("support"))
    lumped = lumped.select(
        F.concat_ws("--", F.lit("creative"), "subject", F.lit(predicate), "object").alias("id"), "subject", F.lit(predicate).alias("predicate"), "object",
        F.lit(qedge_key).alias("qedge_key"), "n_edges", "support")
    return lumped, support.withColumn("qedge_key", F.lit(f"creative_{qedge_key}"))


def subclass_edges(answers: DataFrame) -> DataFrame:
    """``answers(node_id, query_id)``: a child-to-parent edge wherever an answer is not the queried id."""
    sub = answers.where("query_id is not null and query_id <> node_id").select("node_id", "query_id").distinct()
    return sub.select(
        F.concat_ws("--", "node_id", F.lit("subclass_of"), "query_id").alias("id"), F.col("node_id").alias("subject"),
        F.lit("subclass_of").alias("predicate"), F.col("query_id").alias("object"),
    )


def map_back(edges: DataFrame, canonical: DataFrame) -> DataFrame:
    """Ends named by canonical ids get the user's ids back; ``canonical(canonical_id, input_id)``, least id on ties."""
    one = canonical.groupBy("canonical_id").agg(F.min("input_id").alias("input_id"))
    for end in ("subject", "object"):
        m = one.select(F.col("canonical_id").alias(end), F.col("input_id").alias("__in"))
        edges = edges.join(m, end, "left").withColumn(end, F.coalesce("__in", end)).drop("__in")
    return edges


def low_evidence(nodes: DataFrame, edges: DataFrame, source: str, least: int) -> tuple[DataFrame, DataFrame]:
    """Edges of ``source`` with less evidence go, then nodes without edges."""
    kept = edges.where((F.col("source") != source) | (F.col("evidence") >= least))
    touched = kept.select(F.explode(F.array("subject", "object")).alias("id")).distinct()
    return nodes.join(touched, "id", "left_semi"), kept


def domain_range(edges: DataFrame, flag: str = "domain_range_exclusion") -> DataFrame:
    """Flagged edges go."""
    return edges.where(F.coalesce(F.col(flag).cast("string"), F.lit("")) != "True")


def scrub(nodes: DataFrame, column: str, invalid: Sequence) -> DataFrame:
    """Attribute values that sources use for "nothing" are removed from an array column."""
    bad = F.array(*[F.lit(x) for x in invalid])
    return nodes.withColumn(column, F.filter(column, lambda x: x.isNotNull() & ~F.array_contains(bad, x)))


def decorate_nodes(nodes: DataFrame, metadata: DataFrame) -> DataFrame:
    """Metadata columns by id; existing values win."""
    fresh = [c for c in metadata.columns if c != "id"]
    out = nodes.join(metadata.select("id", *[F.col(c).alias(f"__{c}") for c in fresh]), "id", "left")
    for c in fresh:
        out = out.withColumn(c, F.coalesce(F.col(c), F.col(f"__{c}")) if c in nodes.columns else F.col(f"__{c}"))
    return out.select(*nodes.columns, *[c for c in fresh if c not in nodes.columns])


def decorate_attributes(attributes: DataFrame, metadata: DataFrame, nodes: DataFrame, bare_only: bool = False, bare: str = "description") -> DataFrame:
    """Node attributes ``(id, type, value, source)`` with those of ``metadata``, of the same columns, that are new.

    An attribute is known by its type, value and source: nodes of ``nodes(id)`` get the metadata attributes they lack, without empty
    values.  With ``bare_only`` nodes that have an attribute of type ``bare`` stay as they are.
    """
    asked = nodes.select("id").distinct()
    if bare_only:
        asked = asked.join(attributes.where(F.col("type") == bare).select("id"), "id", "left_anti")
    fresh = metadata.select("id", "type", "value", "source").where(F.coalesce(F.col("value"), F.lit("")) != "").distinct().join(asked, "id", "left_semi")
    same = fresh["id"].eqNullSafe(attributes["id"])
    for c in ("type", "value", "source"):
        same = same & fresh[c].eqNullSafe(attributes[c])
    return attributes.select("id", "type", "value", "source").union(fresh.join(attributes, same, "left_anti"))


def decorate_edges(edges: DataFrame, evidence: DataFrame, on: Sequence[str]) -> DataFrame:
    """Evidence texts ``(*on, text)`` by edge key or by node pair, merged to a sorted set per edge."""
    merged = evidence.groupBy(*on).agg(F.array_sort(F.collect_set("text")).alias("supporting_text"))
    return edges.join(merged, list(on), "left")


def fulfilled(kg_nodes: DataFrame, kg_edges: DataFrame, qnodes: Sequence[str], qedges: Sequence[str]) -> DataFrame:
    """``(key, n)``: bindings of every required key of the pattern, 0 where there is none."""
    spark = kg_nodes.sparkSession
    keys = spark.createDataFrame([(k,) for k in [*qnodes, *qedges]], "key string")
    n = kg_nodes.groupBy(F.col("qnode_key").alias("key")).count().union(kg_edges.groupBy(F.col("qedge_key").alias("key")).count())
    return keys.join(n, "key", "left").select("key", F.coalesce("count", F.lit(0)).alias("n"))


def score_edges(scores: DataFrame, ids: DataFrame, threshold: float, predicate: str) -> DataFrame:
    """Predicted edges from a score table ``(subject, object, score)`` for the given subjects."""
    hit = scores.where(F.col("score") >= threshold).join(ids.select(F.col("id").alias("subject")), "subject", "left_semi")
    return hit.select(edge_key("subject", F.lit(predicate), "object").alias("id"), "subject", F.lit(predicate).alias("predicate"), "object", "score")


def canonical_direction(edges: DataFrame, inverse: DataFrame) -> DataFrame:
    """Edges with an inverse predicate ``(predicate, canonical)`` are turned round and renamed."""
    e = edges.join(inverse, "predicate", "left")
    turn = F.col("canonical").isNotNull()
    return e.select(
        *[c for c in edges.columns if c not in ("subject", "predicate", "object")],
        F.when(turn, F.col("object")).otherwise(F.col("subject")).alias("subject"),
        F.coalesce("canonical", "predicate").alias("predicate"),
        F.when(turn, F.col("subject")).otherwise(F.col("object")).alias("object"),
    )
