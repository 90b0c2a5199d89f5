"""Subgraph matching (R1-R15): pattern bindings from bound nodes and edges.

``kg_nodes(qnode_key, node_id)``, ``kg_edges(qedge_key, id, subject, object)``.  A match is a join over
pair tables, one per linked pair of query nodes; Catalyst and AQE choose the strategies.  Set-valued
nodes fold to sorted arrays: leaves before they are joined, others after, so independent sets never
multiply.  Cyclic patterns take other ways: without sets the neighbour lists of each row (``multiway``), with
sets the largest ones without dead ends (``fixpoint``).
Inputs are read once for every query edge: hand in written tables (``sources.scratch.saved``), not long plans.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexus.operators import fixpoint, multiway
from plexus.plans.pattern import Pattern
from plexus.sources.scratch import saved


def pair_table(pattern: Pattern, kg_nodes: DataFrame | None, kg_edges: DataFrame, a: str, b: str, ignore_direction: bool = True) -> DataFrame:
    """Node pairs ``(a, b)`` adjacent by every query edge between two query nodes.

    Without ``kg_nodes`` the ends of a query edge's edges are its nodes, in the direction of the edges."""
    tables = []
    for e in pattern.edges:
        if {e.subject, e.object} != {a, b}:
            continue
        mine = kg_edges.where(F.col("qedge_key") == e.key)
        left, right = ("subject", "object") if e.subject == a else ("object", "subject")
        pairs = mine.select(F.col(left).alias(a), F.col(right).alias(b))
        if ignore_direction and kg_nodes is not None:
            pairs = pairs.union(mine.select(F.col(right).alias(a), F.col(left).alias(b)))
        tables.append(pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).distinct())
    out = reduce(lambda x, y: x.intersect(y), tables)
    for key in (a, b) if kg_nodes is not None else ():
        ids = kg_nodes.where(F.col("qnode_key") == key).select(F.col("node_id").alias(key)).distinct()
        out = out.join(ids, key, "left_semi")
    return out


def match(pattern: Pattern, kg_nodes: DataFrame, kg_edges: DataFrame, ignore_direction: bool = True) -> DataFrame:
    """One row per result: a column per query node, a string or (set-valued) a sorted array."""
    pattern.check()
    sets = [n.key for n in pattern.nodes if n.is_set]
    single = [n.key for n in pattern.nodes if not n.is_set]
    if not pattern.edges:  # R10
        rows = kg_nodes.groupBy("qnode_key").agg(F.array_sort(F.collect_set("node_id")).alias("ids"))
        return rows.agg(F.map_from_entries(F.collect_list(F.struct("qnode_key", "ids"))).alias("m")).select(
            *[F.col("m")[n.key].alias(n.key) for n in pattern.nodes])
    links = {}
    for e in pattern.edges:
        links.setdefault(frozenset((e.subject, e.object)), (e.subject, e.object))
    degree = {n.key: sum(n.key in pair for pair in links) for n in pattern.nodes}
    loops = [p for p in links if len(p) == 1]
    if len(links) - len(loops) >= len(pattern.nodes):
        nodes, tables = _tables(pattern, kg_nodes, kg_edges, ignore_direction)
        if sets:
            return fixpoint.match_sets(pattern, nodes, tables)
        return multiway.bind(_connected(pattern), tables).select(*[n.key for n in pattern.nodes])
    folded = {}
    for pair, (a, b) in links.items():
        if len(pair) == 2:
            for leaf, other in ((a, b), (b, a)):
                if leaf in sets and degree[leaf] == 1 and other in single and len(links) > 1:
                    folded[pair] = (leaf, other)
                    break
    out, todo = None, {p: ab for p, ab in links.items() if p not in folded and p not in loops}
    while todo:
        pair = next((p for p in todo if out is None or p & set(out.columns)), None)
        table = pair_table(pattern, kg_nodes, kg_edges, *todo.pop(pair), ignore_direction)
        out = table if out is None else out.join(table, sorted(pair & set(out.columns)))
    for pair in loops:
        (key,) = pair
        e = next(e for e in pattern.edges if e.subject == e.object == key)
        same = kg_edges.where((F.col("qedge_key") == e.key) & (F.col("subject") == F.col("object"))).select(F.col("subject").alias(key)).distinct()
        out = same if out is None else out.join(same, key, "left_semi")
    for pair, (leaf, other) in folded.items():
        table = pair_table(pattern, kg_nodes, kg_edges, *links[pair], ignore_direction)
        table = table.groupBy(other).agg(F.array_sort(F.collect_set(leaf)).alias(leaf))
        out = table if out is None else out.join(table, other)
    deep = [k for k in sets if k not in {leaf for leaf, _ in folded.values()}]
    if deep:
        shallow = [leaf for leaf, _ in folded.values()]
        merged = [F.array_sort(F.collect_set(k)).alias(k) for k in deep]
        merged += [F.array_sort(F.array_distinct(F.flatten(F.collect_list(k)))).alias(k) for k in shallow]
        out = out.groupBy(*single).agg(*merged)
    return out.select(*[n.key for n in pattern.nodes])


def _connected(pattern: Pattern) -> list[str]:
    """The query nodes in an order in which each has a link to one before; those closing most cycles come early."""
    near = {n.key: {k for e in pattern.edges if n.key in (e.subject, e.object) for k in (e.subject, e.object)} - {n.key} for n in pattern.nodes}
    order = [pattern.nodes[0].key]
    while len(order) < len(near):
        order.append(max((k for k in near if k not in order), key=lambda k: len(near[k] & set(order))))
    return order


def _tables(pattern: Pattern, kg_nodes: DataFrame, kg_edges: DataFrame, ignore_direction: bool) -> tuple[dict[str, DataFrame], fixpoint.Links]:
    """Written node and pair tables of a pattern, without nodes that lack an edge to themselves where the pattern has one."""
    loops = {e.key: e.subject for e in pattern.edges if e.subject == e.object}
    nodes = {}
    for n in pattern.nodes:
        if kg_nodes is None:
            ends = [kg_edges.where(F.col("qedge_key") == e.key).select(F.col(end).alias(n.key)) for e in pattern.edges for k, end in ((e.subject, "subject"), (e.object, "object")) if k == n.key]
            own = reduce(lambda x, y: x.union(y), ends).where(F.col(n.key).isNotNull()).distinct()
        else:
            own = kg_nodes.where(F.col("qnode_key") == n.key).select(F.col("node_id").alias(n.key)).distinct()
        for key in [k for k, at in loops.items() if at == n.key]:
            own = own.join(kg_edges.where((F.col("qedge_key") == key) & (F.col("subject") == F.col("object"))).select(F.col("subject").alias(n.key)), n.key, "left_semi")
        nodes[n.key] = own
    links: fixpoint.Links = {}
    for e in pattern.edges:
        if e.subject != e.object and (e.subject, e.object) not in links and (e.object, e.subject) not in links:
            table = pair_table(pattern, kg_nodes, kg_edges, e.subject, e.object, ignore_direction)
            for end in (e.subject, e.object):
                table = table.join(nodes[end], end, "left_semi") if end in loops.values() else table
            links[e.subject, e.object] = saved(table.select(e.subject, e.object))
    return nodes, links


def without_dead_ends(pattern: Pattern, kg_nodes: DataFrame, kg_edges: DataFrame, ignore_direction: bool = True) -> tuple[DataFrame, DataFrame]:
    """``(kg_nodes, kg_edges)`` of a pattern of any form without dead ends."""
    nodes, links = _tables(pattern, kg_nodes, kg_edges, ignore_direction)
    alive = None
    for q, rows in nodes.items():
        part = rows.select(F.lit(q).alias("qnode_key"), F.col(q).alias("node_id"))
        alive = part if alive is None else alive.union(part)
    return fixpoint.without_dead_ends(pattern, alive, kg_edges, links)


def with_options(pattern: Pattern, kg_nodes: DataFrame, kg_edges: DataFrame, ignore_direction: bool = True) -> DataFrame:
    """Required results, with the union of each option group's matches of the same non-set nodes, or null."""
    pattern.check()
    base = pattern.required()
    out = match(base, kg_nodes, kg_edges, ignore_direction)
    key = [n.key for n in base.nodes if not n.is_set]
    for group in sorted({e.option_group for e in pattern.edges if e.option_group}):
        part = pattern.with_group(group)
        extra = [n.key for n in part.nodes if n.key not in {m.key for m in base.nodes}]
        found = match(part, kg_nodes, kg_edges, ignore_direction)
        as_array = {n.key: F.col(n.key) if n.is_set else F.array(n.key) for n in part.nodes}
        found = found.groupBy(*key).agg(*[F.array_sort(F.array_distinct(F.flatten(F.collect_list(as_array[k])))).alias(k) for k in extra])
        out = out.join(found, key, "left")
    return out


def result_id(results: DataFrame, pattern: Pattern) -> DataFrame:
    """``results`` with ``result_id``: the values of the non-set nodes."""
    keys = [n.key for n in pattern.nodes if not n.is_set and n.key in results.columns] or [n.key for n in pattern.nodes]
    return results.withColumn("result_id", F.concat_ws("|", *[F.col(k).cast("string") for k in keys]))


def bound_nodes(results: DataFrame, pattern: Pattern) -> DataFrame:
    """Long form ``(result_id, qnode_key, node_id)``."""
    kinds = {f.name: f.dataType.typeName() for f in results.schema.fields}
    keys = [n.key for n in pattern.nodes if n.key in kinds]
    arrays = [F.struct(F.lit(k).alias("qnode_key"), (F.col(k) if kinds[k] == "array" else F.array(k)).alias("ids")) for k in keys]
    long = results.select("result_id", F.explode(F.array(*arrays)).alias("x"))
    return long.select("result_id", "x.qnode_key", F.explode("x.ids").alias("node_id")).where("node_id is not null")


def bound_edges(bound: DataFrame, pattern: Pattern, kg_edges: DataFrame, ignore_direction: bool = True) -> DataFrame:
    """``(result_id, qedge_key, edge_id)``: all edges of a query edge between the bound nodes of its ends."""
    out = []
    for e in pattern.edges:
        mine = kg_edges.where(F.col("qedge_key") == e.key).select("id", "subject", "object")
        ways = [("subject", "object"), ("object", "subject")] if ignore_direction else [("subject", "object")]
        for s, o in ways:
            left = bound.where(F.col("qnode_key") == e.subject).select("result_id", F.col("node_id").alias(s))
            right = bound.where(F.col("qnode_key") == e.object).select("result_id", F.col("node_id").alias(o))
            out.append(mine.join(left, s).join(right, ["result_id", o]).select("result_id", F.lit(e.key).alias("qedge_key"), F.col("id").alias("edge_id")))
    return reduce(lambda a, b: a.union(b), out).distinct()


def collapse_subclasses(kg_edges: DataFrame, subclass: DataFrame) -> DataFrame:
    """Edge ends replaced by their parent ``(child, parent)``, the least of several; real ends are kept beside."""
    parent = subclass.groupBy("child").agg(F.min("parent").alias("parent"))
    out = kg_edges
    for end in ("subject", "object"):
        p = parent.select(F.col("child").alias(end), F.col("parent").alias("__p"))
        out = out.join(p, end, "left").withColumn(f"real_{end}", F.col(end)).withColumn(end, F.coalesce("__p", end)).drop("__p")
    return out


def match_collapsed(pattern: Pattern, kg_nodes: DataFrame, kg_edges: DataFrame, subclass: DataFrame, ignore_direction: bool = True) -> tuple[DataFrame, DataFrame]:
    """Matching on parents ``subclass(child, parent)``, bound back to the real ends: ``(results, bound)``.

    ``results`` has a ``result_id`` and the parents; ``bound(result_id, qnode_key, node_id)`` the parents and those of
    their children that an edge of the result really ends at.
    """
    edges = saved(collapse_subclasses(kg_edges, subclass))
    parent = subclass.groupBy(F.col("child").alias("node_id")).agg(F.min("parent").alias("__p"))
    nodes = kg_nodes.join(parent, "node_id", "left").select("qnode_key", F.coalesce("__p", "node_id").alias("node_id")).distinct()
    results = saved(result_id(match(pattern, nodes, edges, ignore_direction), pattern))
    bound = saved(bound_nodes(results, pattern))
    hits = bound_edges(bound, pattern, edges, ignore_direction).withColumnRenamed("edge_id", "id").join(edges.drop("qedge_key"), "id")
    ends = hits.select("result_id", F.explode(F.array(
        F.struct(F.col("subject").alias("at"), F.col("real_subject").alias("real")), F.struct(F.col("object").alias("at"), F.col("real_object").alias("real")))).alias("x"))
    real = ends.select("result_id", F.col("x.at").alias("node_id"), F.col("x.real").alias("real")).where("real <> node_id")
    more = bound.join(real, ["result_id", "node_id"]).select("result_id", "qnode_key", F.col("real").alias("node_id"))
    asked = kg_nodes.select("qnode_key", "node_id").distinct()
    return results, bound.union(more.join(asked, ["qnode_key", "node_id"], "left_semi").select(*bound.columns)).distinct()


def mismatched(pattern: Pattern, kg_nodes: DataFrame, kg_edges: DataFrame, ignore_direction: bool = True) -> DataFrame:
    """R2: ``(id)`` of edges whose ends do not fulfil the ends of their query edge, in its direction or, if ignored, in either."""
    out = None
    for e in pattern.edges:
        if e.subject == e.object:
            continue
        mine = kg_edges.where((F.col("qedge_key") == e.key) & F.col("subject").isNotNull() & F.col("object").isNotNull()).select("id", "subject", "object").distinct()
        for s, o in [(e.subject, e.object), (e.object, e.subject)][: 1 + ignore_direction]:
            role = lambda q, end: kg_nodes.where(F.col("qnode_key") == q).select(F.col("node_id").alias(end)).distinct()
            fits = mine.join(role(s, "subject"), "subject", "left_semi").join(role(o, "object"), "object", "left_semi")
            mine = mine.join(fits.select("subject", "object").distinct(), ["subject", "object"], "left_anti")
        out = mine.select("id") if out is None else out.union(mine.select("id"))
    return (kg_edges.select("id").limit(0) if out is None else out).distinct()


def integrity(pattern: Pattern, kg_nodes: DataFrame, kg_edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """R2: counts of what is wrong: ``(error, n)``; ``nodes(id)``: the nodes of the graph, else those bound."""
    qn, qe = [n.key for n in pattern.nodes], [e.key for e in pattern.edges]
    checks = [
        ("MissingQNodeKeys", kg_nodes.where("qnode_key is null")), ("MissingQEdgeKeys", kg_edges.where("qedge_key is null")),
        ("UnknownQNodeKey", kg_nodes.where(~F.col("qnode_key").isin(qn))), ("UnknownQEdgeKey", kg_edges.where(~F.col("qedge_key").isin(qe))),
        ("MissingIds", kg_edges.where("id is null")), ("MissingEnds", kg_edges.where("subject is null or object is null")),
    ]
    ids = kg_nodes.select("node_id").distinct() if nodes is None else nodes.select(F.col("id").alias("node_id")).distinct()
    ends = kg_edges.select("id", F.explode(F.array("subject", "object")).alias("node_id")).where("node_id is not null")
    checks.append(("OrphanEdges", ends.join(ids, "node_id", "left_anti").select("id").distinct()))
    checks.append(("RepeatedEdgeIds", kg_edges.groupBy("id", "qedge_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1 and id is not null")))
    checks.append(("MismatchedNodes", mismatched(pattern, kg_nodes, kg_edges)))
    checks.append(("BoundNodesNotInGraph", kg_nodes.select("node_id").distinct().join(ids, "node_id", "left_anti")))
    rows = [df.agg(F.lit(name).alias("error"), F.count(F.lit(1)).alias("n")) for name, df in checks]
    return reduce(lambda a, b: a.union(b), rows)


def prune_graph(
    nodes: DataFrame, edges: DataFrame, bound: DataFrame, result_edges: DataFrame,
    aux: DataFrame | None = None, supports: DataFrame | None = None, seeds: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``(nodes, edges)`` that the results ``bound(node_id)``, ``result_edges(edge_id)`` refer to; see ``referenced``."""
    ids, kept, _ = referenced(edges, bound, result_edges, aux, supports, seeds, nodes)
    return nodes.join(ids, "id", "left_semi"), edges.join(kept, "id", "left_semi")


def referenced(
    edges: DataFrame, bound: DataFrame, result_edges: DataFrame, aux: DataFrame | None = None,
    supports: DataFrame | None = None, seeds: DataFrame | None = None, nodes: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Ids of the nodes, edges and aux graphs that results refer to: the least sets closed under four rules.

    The ends of a referenced edge are referenced; so is an edge whose ends both are; so are the aux graphs that a
referenced edge names, and all edges of a referenced aux graph.  ``aux(aux_id, edge_id)``; ``supports(edge_id, aux_id)``:
    the aux graphs an edge names, or None and a column ``aux_id`` of ``edges``; ``seeds(aux_id)``: those that results name
    themselves.  An aux graph with an edge that ``edges`` lacks, or whose end ``nodes`` lacks, is left out, and so is an edge
    without an end.  Every round adds what the round before made reachable, so there are as many rounds as aux graphs lie inside
    each other.

    A referenced edge has both ends referenced, so nodes are all that rounds carry.  An edge moves twice in all: to its
    subject, and to its object once the subject is referenced.
    """
    ends = edges.select("id", "subject", "object").where("subject is not null and object is not null")
    of = lambda e: e.select(F.explode(F.array("subject", "object")).alias("id"))
    if aux is None:
        new_edges = ends.join(result_edges.select(F.col("edge_id").alias("id")).distinct(), "id", "left_semi")
        ids = saved(bound.select(F.col("node_id").alias("id")).union(of(new_edges)).distinct())
        kept = ends
        for end in ("subject", "object"):
            kept = kept.join(ids.select(F.col("id").alias(end)), end, "left_semi")
        return ids, kept.select("id"), None
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = []

    def by(df: DataFrame, key: str) -> DataFrame:
        held.append(df.repartition(n, key).persist())  # joins on the key move only the other side
        return held[-1]

    # one look at the edges by id, for aux graphs and results
    asked = aux.select(F.lit(True).alias("of_aux"), "aux_id", F.col("edge_id").alias("id"))
    asked = asked.union(result_edges.select(F.lit(False), F.lit(None).cast("string"), "edge_id"))
    asked = saved(asked.join(ends, "id", "left").select("of_aux", "aux_id", "subject", "object"))
    content = asked.where("of_aux").select("aux_id", "subject", "object")
    broken = content.where("subject is null").select("aux_id")
    if nodes is not None:
        missing = saved(of(content).where("id is not null").distinct().join(nodes.select("id"), "id", "left_anti"))
        for end in ("subject", "object"):
            broken = broken.union(content.join(missing.select(F.col("id").alias(end)), end, "left_semi").select("aux_id"))
    content = by(content.where("subject is not null"), "aux_id").join(saved(broken.distinct()), "aux_id", "left_anti")
    if supports is not None:
        rows = ends.join(supports.select(F.col("edge_id").alias("id"), "aux_id"), "id", "left")
    elif "aux_id" in edges.columns:
        rows = edges.where("subject is not null and object is not null").select("id", "subject", "object", "aux_id")
    else:
        rows = ends.withColumn("aux_id", F.lit(None).cast("string"))
    rows = by(rows, "subject")
    ids = saved(bound.select(F.col("node_id").alias("id")).union(of(asked.where("not of_aux"))).where("id is not null").distinct())
    graphs = content.select("aux_id").limit(0)
    frontier, half = ids, []
    named = seeds.select("aux_id") if seeds is not None else graphs
    while True:
        reached = frontier.select(F.col("id").alias("object"))
        fired = [h.join(reached, "object", "left_semi") for h in half]
        half.append(by(rows.join(frontier.select(F.col("id").alias("subject")), "subject", "left_semi"), "object"))
        fired.append(half[-1].join(ids.select(F.col("id").alias("object")), "object", "left_semi"))
        for f in fired:
            named = named.union(f.select("aux_id").where("aux_id is not null"))
        named = saved(named.distinct().join(graphs, "aux_id", "left_anti"))
        found = content.join(named, "aux_id", "left_semi")
        frontier = saved(of(found).distinct().join(ids, "id", "left_anti"))
        graphs, named = saved(graphs.union(named)), named.limit(0)
        if frontier.isEmpty():
            break
        ids = saved(ids.union(frontier))
    kept = reduce(lambda a, b: a.union(b), [h.join(ids.select(F.col("id").alias("object")), "object", "left_semi").select("id") for h in half])
    kept = saved(kept if supports is None else kept.distinct())  # an edge may name several aux graphs
    graphs = saved(content.select("aux_id").distinct().join(graphs, "aux_id", "left_semi"))
    for df in held:
        df.unpersist()
    return ids, kept, graphs


def recompute_keys(bound: DataFrame) -> DataFrame:
    """``(node_id, qnode_keys)`` from result bindings."""
    return bound.groupBy("node_id").agg(F.array_sort(F.collect_set("qnode_key")).alias("qnode_keys"))


def essences(results: DataFrame, pattern: Pattern, nodes: DataFrame) -> DataFrame:
    """Each result's name: that of its essence node, with its ``symbol`` in brackets where ``nodes`` has one."""
    key = pattern.essence_node()
    name = F.col("name")
    if "symbol" in nodes.columns:
        name = F.when(F.col("symbol").isNotNull() & (F.col("symbol") != F.col("name")), F.concat(name, F.lit(" ("), "symbol", F.lit(")"))).otherwise(name)
    return results.join(nodes.select(F.col("id").alias(key), name.alias("essence")), key, "left")


def query_ids(bound: DataFrame, asked: DataFrame) -> DataFrame:
    """The least queried id of each bound node where it is another one: ``asked(node_id, query_ids)``."""
    least = F.array_min("query_ids")
    q = asked.select("node_id", F.when(least != F.col("node_id"), least).alias("query_id"))
    return bound.join(q, "node_id", "left")
