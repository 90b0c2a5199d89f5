"""Scoring, sorting and limiting of results."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plexus.functions.order import ordered
from plexus.sources.scratch import saved

#: Base confidence of edges by source.
SOURCE_WEIGHT = {"semmeddb": 0.5, "text-mining": 0.85, "drugcentral": 0.93, "drugbank": 0.99, "virtual": 0.0}
OTHER_SOURCE = 0.5
MANUAL = 0.9


def attribute_ranges(attrs: DataFrame) -> DataFrame:
    """K1: ``(name, least, most, n)`` of the finite values of each attribute."""
    v = F.col("value")
    finite = attrs.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return finite.groupBy("name").agg(F.min("value").alias("least"), F.max("value").alias("most"), F.count(F.lit(1)).alias("n"))


def combined(weights: Column) -> Column:
    """K4: weights combined as independent chances, an order-free aggregate."""
    return 1 - F.product(1 - weights)


def edge_confidence(edges: DataFrame, scores: DataFrame, weights: dict[str, float] = SOURCE_WEIGHT) -> DataFrame:
    """K4: ``edges(id, source, manual)`` with confidence from the base weight and ``scores(id, weight, score)``."""
    base = F.lit(OTHER_SOURCE)
    for source, w in sorted(weights.items()):
        base = F.when(F.col("source") == source, F.lit(w)).otherwise(base)
    part = scores.groupBy("id").agg(F.product(1 - F.col("weight") * F.col("score")).alias("rest"))
    e = edges.join(part, "id", "left")
    confidence = 1 - (1 - base) * F.coalesce("rest", F.lit(1.0))
    return e.withColumn("confidence", F.when(F.col("manual"), F.lit(MANUAL)).otherwise(confidence)).drop("rest")


def qedge_weights(bound: DataFrame, confidence: DataFrame) -> DataFrame:
    """K5: per result and query edge, confidences averaged over parallel edges ``(kind)`` and combined.

    ``bound(result_id, qedge_key, edge_id)``, ``confidence(id, kind, confidence)``.
    """
    rows = bound.join(confidence.withColumnRenamed("id", "edge_id"), "edge_id")
    kinds = rows.groupBy("result_id", "qedge_key", "kind").agg(F.avg("confidence").alias("w"))
    return kinds.groupBy("result_id", "qedge_key").agg(combined(F.col("w")).alias("weight"))


def chain_scores(weights: DataFrame, hops: int) -> DataFrame:
    """K6-K8 in closed form for a head-to-tail chain of ``hops`` edges.

    Max flow is the least weight, the longest-path score the product over ``hops!``, and the Frobenius norm
    the root of the sum of squares.
    """
    factorial = 1
    for i in range(2, hops + 1):
        factorial *= i
    return weights.groupBy("result_id").agg(
        F.min("weight").alias("max_flow"), (F.product("weight") / factorial).alias("longest_path"), F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("frobenius"))


def max_flow(arcs: list[tuple[str, str, float]], source: str, sink: str) -> float:
    """The largest flow through a small directed graph, by shortest augmenting paths."""
    room: dict[str, dict[str, float]] = {}
    for a, b, w in arcs:
        room.setdefault(a, {})[b] = room.get(a, {}).get(b, 0.0) + w
        room.setdefault(b, {}).setdefault(a, 0.0)
    total = 0.0
    while True:
        parent, queue = {source: source}, [source]
        for node in queue:
            for other, w in room.get(node, {}).items():
                if w > 1e-12 and other not in parent:
                    parent[other] = node
                    queue.append(other)
        if sink not in parent:
            return total
        path, node = [], sink
        while node != source:
            path.append((parent[node], node))
            node = parent[node]
        step = min(room[a][b] for a, b in path)
        for a, b in path:
            room[a][b] -= step
            room[b][a] += step
        total += step


def cuts(arcs: dict[str, tuple[str, str]], source: str, sink: str) -> list[set[str]]:
    """The query edges of every cut between two query nodes that has all of its source side reachable from the source."""
    onward: dict[str, set[str]] = {}
    for a, b in arcs.values():
        onward.setdefault(a, set()).add(b)
    back: dict[str, set[str]] = {}
    for a, b in arcs.values():
        back.setdefault(b, set()).add(a)
    useful, todo = {sink}, [sink]  # nodes from which the sink can be reached
    while todo:
        for n in back.get(todo.pop(), set()) - useful:
            useful.add(n)
            todo.append(n)
    if source not in useful:
        return [set()]
    out, seen, todo = [], set(), [frozenset([source])]
    while todo:
        side = todo.pop()
        if side not in seen:
            seen.add(side)
            out.append({k for k, (a, b) in arcs.items() if a in side and b not in side and b in useful})
            todo += [side | {n} for at in side for n in onward.get(at, set()) - side if n in useful and n != sink]
    return out


def pattern_scores(weights: DataFrame, arcs: dict[str, tuple[str, str]]) -> DataFrame:
    """K6-K8 for any pattern: ``arcs`` gives the ends of each query edge; plain expressions over a result's weights.

    The pattern is the same for all results, so the largest flow is the least of its cuts, each a sum of weights,
    and the path score a sum over its walks, each a product.  Only pairs of nodes at the greatest shortest-path distance
    count.  A result has one row per query edge; a missing one weighs 0.
    """
    near: dict[str, set[str]] = {}
    for a, b in arcs.values():
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set())
    far: dict[tuple[str, str], int] = {}
    for start in near:
        layer, depth, seen = {start}, 0, {start}
        while layer := {o for n in layer for o in near[n]} - seen:
            depth += 1
            seen |= layer
            far.update({(start, o): depth for o in layer})
    longest = max(far.values(), default=0)
    pairs = sorted(p for p, n in far.items() if n == longest)
    wide = weights.groupBy("result_id").pivot("qedge_key", sorted(arcs)).agg(F.first("weight")).fillna(0.0, sorted(arcs))
    entry = {(i, j): _sum([F.col(k) for k in sorted(arcs) if arcs[k] == (i, j)]) for i, j in set(arcs.values())}

    def flow(s: str, t: str) -> Column:
        sums = [_sum([F.col(k) for k in sorted(keys)]) for keys in cuts(arcs, s, t)]
        return F.least(*sums) if len(sums) > 1 else sums[0]

    def walk(s: str, t: str) -> Column:
        at = {s: F.lit(1.0)}
        for _ in range(longest):
            to: dict[str, list[Column]] = {}
            for (i, j), w in sorted(entry.items()):
                if i in at:
                    to.setdefault(j, []).append(at[i] * w)
            at = {j: _sum(terms) for j, terms in to.items()}
        return at.get(t, F.lit(0.0)) / math.factorial(longest)

    def mixed(values: list[Column]) -> Column:
        out = F.lit(1.0)
        for v in values:
            out = out * (1 - F.least(v, F.lit(1.0)))
        return 1 - out if values else F.lit(1.0)

    norm = F.sqrt(_sum([w * w for _, w in sorted(entry.items())]))
    return wide.select("result_id", mixed([flow(*p) for p in pairs]).alias("max_flow"), mixed([walk(*p) for p in pairs]).alias("longest_path"), norm.alias("frobenius"))


def _sum(terms: list[Column]) -> Column:
    out = F.lit(0.0)
    for t in terms:
        out = out + t
    return out


def quantile_ranks(scores: DataFrame, names: Sequence[str] = ("max_flow", "longest_path", "frobenius")) -> DataFrame:
    """The mean of each scorer's cumulative distribution, rounded, as ``score``; ``scores(result_id, ...)``.

    All scorers are one long table: counts per distinct score get running totals from one range sort, so no window
    holds all results.
    """
    scores = saved(scores)
    values = F.array(*[F.struct(F.lit(i).alias("__s"), F.col(n).cast("double").alias("__v")) for i, n in enumerate(names)])
    long = scores.select(*[c for c in scores.columns if c not in names], F.explode(values).alias("x")).select("*", "x.*").drop("x")
    counts = ordered(long.groupBy("__s", "__v").agg(F.count(F.lit(1)).alias("__n")), ["__s", "__v"], "__n")
    total = F.broadcast(scores.agg(F.count(F.lit(1)).alias("__total")))  # one row
    share = counts.join(total).select("__s", "__v", ((F.col("__cum") + F.col("__n") - F.col("__s") * F.col("__total")) / F.col("__total")).alias("__rank"))
    ranked = long.join(share, (long["__s"] == share["__s"]) & long["__v"].eqNullSafe(share["__v"])).select("result_id", long["__s"], "__rank")
    wide = ranked.groupBy("result_id").agg(*[F.max(F.when(F.col("__s") == i, F.col("__rank"))).alias(f"{n}_rank") for i, n in enumerate(names)])
    out = scores.join(wide, "result_id")
    mean = sum((F.col(f"{n}_rank") for n in names), F.lit(0.0)) / len(names)
    return out.withColumn("score", F.round(F.when(mean < 0.001, mean + 0.001).otherwise(mean), 3))


def break_ties(scored: DataFrame, order: Sequence[Column], most: int = 1000) -> DataFrame:
    """Among the first ``most`` results each score ends below the one before by at least 0.001; the rest are 0.

    The running rule ``s[i] = min(s[i], s[i-1] - 0.001)`` is a running minimum of ``s[i] + 0.001 i``.
    """
    scored = saved(scored)
    place = F.row_number().over(Window.orderBy(*order)) - 1
    top = scored.orderBy(*order).limit(most).withColumn("place", place)
    upto = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    low = F.min(F.col("score") + F.col("place") * 0.001).over(upto) - F.col("place") * 0.001
    top = top.withColumn("score", F.round(F.greatest(low, F.lit(0.0)), 3)).select("result_id", "score", "place")
    rest = scored.join(top.select("result_id"), "result_id", "left_anti").select("result_id", F.lit(0.0).alias("score"), F.lit(None).cast("int").alias("place"))
    return top.union(rest)


def document_counts(bound: DataFrame, documents: DataFrame, category: str | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """``(result_id, key)``: distinct documents ``documents(id, doc)`` of a result's bound nodes, of one category if named.

    Results without any keep null.
    """
    mine = bound.select("result_id", F.col("node_id").alias("id")).distinct()
    if category is not None:
        mine = mine.join(nodes.where(F.array_contains("categories", category)).select("id"), "id", "left_semi")
    n = mine.join(documents.distinct(), "id").groupBy("result_id").agg(F.countDistinct("doc").alias("key"))
    return bound.select("result_id").distinct().join(n, "result_id", "left")


def top_document_counts(bound: DataFrame, documents: DataFrame, most: int) -> DataFrame:
    """``sorted_by(document_counts(bound, documents), True, most)``, counting only the results that may be among these.

    The sum of its nodes' documents bounds a result's count.  The ``most`` results of the greatest sums are counted
    first; others follow only if their sums reach the least of these counts, so the answer is exact.
    """
    mine = saved(bound.select("result_id", F.col("node_id").alias("id")).distinct())
    docs = saved(documents.select("id", "doc").distinct())
    size = docs.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    upper = saved(mine.join(size, "id").groupBy("result_id").agg(F.sum("n").alias("upper")))

    def counted(some: DataFrame) -> DataFrame:
        return mine.join(some.select("result_id"), "result_id", "left_semi").join(docs, "id").groupBy("result_id").agg(F.countDistinct("doc").alias("key"))

    first = counted(upper.orderBy(F.desc("upper"), "result_id").limit(most)).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("least")).first()
    if first["n"] < most:  # results without documents follow
        return sorted_by(document_counts(bound, documents), True, most)
    return sorted_by(counted(upper.where(F.col("upper") >= first["least"])), True, most)


def attribute_sums(bound: DataFrame, attrs: DataFrame, name: str, element: str = "edge_id", relation: str | None = None,
                   category: str | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """Per result, the sum of an attribute over its bound elements; results without any keep null.

    With a ``category`` only nodes of it count.
    """
    if category is not None:
        attrs = attrs.join(nodes.where(F.array_contains("categories", category)).select("id"), "id", "left_semi")
    mine = attrs.where(F.col("name") == name)
    if relation is not None:
        mine = mine.where(F.col("relation") == relation)
    value = mine.groupBy(F.col("id").alias(element)).agg(F.sum("value").alias("__v"))
    return bound.join(value, element, "left").groupBy("result_id").agg(F.sum("__v").alias("key"))


def binding_counts(bound: DataFrame) -> DataFrame:
    """``(result_id, key)``: how many bindings each result has."""
    return bound.groupBy("result_id").agg(F.count(F.lit(1)).alias("key"))


def limit_results(results: DataFrame, order: Sequence[Column], most: int) -> DataFrame:
    """The first ``most`` results with their ``place``: a TakeOrdered, then a window over those rows."""
    top = results.orderBy(*order).limit(most)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))


def sorted_by(keyed: DataFrame, descending: bool, most: int) -> DataFrame:
    """Results by key, missing keys last, ties by the order they came in (``result_id``)."""
    key = F.desc_nulls_last("key") if descending else F.asc_nulls_last("key")
    return limit_results(keyed, [key, F.asc("result_id")], most)
