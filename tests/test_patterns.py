"""Cyclic, branched and nested patterns against plain models."""

from __future__ import annotations

import itertools
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from plexus.operators import fixpoint, match
from plexus.plans.pattern import Pattern, QEdge, QNode


def model(pattern, pairs, nodes):
    """Results by the rule itself: try all plain nodes, shrink the sets until nothing is a dead end."""
    sets = [n.key for n in pattern.nodes if n.is_set]
    plain = [n.key for n in pattern.nodes if not n.is_set]
    near = defaultdict(set)
    for (a, b), found in pairs.items():
        for x, y in found:
            near[a, x, b].add(y)
            near[b, y, a].add(x)
    links = [*pairs, *((b, a) for a, b in pairs)]
    out = []
    for choice in itertools.product(*[sorted(nodes[q]) for q in plain]):
        held = {q: {v} for q, v in zip(plain, choice, strict=True)} | {q: set(nodes[q]) for q in sets}
        while True:
            bad = [(a, x) for a, b in links for x in held[a] if not near[a, x, b] & held[b]]
            if not bad:
                break
            for a, x in bad:
                held[a].discard(x)
        if all(held.values()):
            out.append(tuple(tuple(sorted(held[n.key])) if n.is_set else next(iter(held[n.key])) for n in pattern.nodes))
    return sorted(out)


SHAPES = {
    "triangle of sets below a node": ("c", "o* p* s*", "co op ps os"),
    "ring with sets": ("a c", "b* d*", "ab bc cd da"),
    "two plain nodes over a ring of sets": ("a e", "b* c* d*", "ab bc cd bd de"),
    "only sets on a ring": ("", "a* b* c*", "ab bc ca"),
    "branch with sets": ("a", "b* c* d*", "ab bc bd ca"),
    "triangle": ("a b c", "", "ab bc ca"),
    "four-cycle with a chord": ("a b c d", "", "ab bc cd da ac"),
    "two triangles": ("a b c d e", "", "ab bc ca cd de ec"),
}


@pytest.mark.parametrize("shape", SHAPES)
def test_patterns_with_cycles(spark, shape):
    plain, sets, links = SHAPES[shape]
    names = plain.split() + [s[0] for s in sets.split()]
    pattern = Pattern(tuple(QNode(k, is_set=k + "*" in sets) for k in names), tuple(QEdge(f"e{i}", x[0], x[1]) for i, x in enumerate(links.split())))
    rng = random.Random(shape)
    nodes = {k: {f"{k}{i}" for i in range(5)} for k in names}
    pairs, edges = {}, []
    for e in pattern.edges:
        found = {(x, y) for x in nodes[e.subject] for y in nodes[e.object] if rng.random() < 0.33}
        pairs[e.subject, e.object] = found
        edges += [(e.key, f"{e.key}{x}{y}", *((x, y) if rng.random() < 0.5 else (y, x))) for x, y in sorted(found)]
    kg_nodes = spark.createDataFrame([(k, v) for k in names for v in sorted(nodes[k])], "qnode_key string, node_id string")
    kg_edges = spark.createDataFrame(edges, "qedge_key string, id string, subject string, object string")
    out = match.match(pattern, kg_nodes, kg_edges)
    got = sorted(tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in out.collect())
    assert got == model(pattern, pairs, nodes)


def test_sets_may_be_larger_than_joint_matches(spark):
    """Six nodes on a ring twice as long as the pattern's: no triangle, yet no dead end."""
    pattern = Pattern((QNode("a", is_set=True), QNode("b", is_set=True), QNode("c", is_set=True)), (QEdge("e", "a", "b"), QEdge("f", "b", "c"), QEdge("g", "c", "a")))
    edges = [("e", "1", "a1", "b1"), ("f", "2", "b1", "c1"), ("g", "3", "c1", "a2"), ("e", "4", "a2", "b2"), ("f", "5", "b2", "c2"), ("g", "6", "c2", "a1"), ("e", "7", "a3", "b1")]
    kg_edges = spark.createDataFrame(edges, "qedge_key string, id string, subject string, object string")
    kg_nodes = spark.createDataFrame([(k[0], k) for k in ("a1", "a2", "a3", "b1", "b2", "c1", "c2")], "qnode_key string, node_id string")
    assert [tuple(map(tuple, r)) for r in match.match(pattern, kg_nodes, kg_edges).collect()] == [(("a1", "a2"), ("b1", "b2"), ("c1", "c2"))]
    nodes, kept = match.without_dead_ends(pattern, kg_nodes, kg_edges)
    assert sorted(r["node_id"] for r in nodes.collect()) == ["a1", "a2", "b1", "b2", "c1", "c2"]
    assert sorted(r["id"] for r in kept.collect()) == ["1", "2", "3", "4", "5", "6"]
    assert match.match(pattern, kg_nodes.limit(0), kg_edges.limit(0)).collect() == []


def test_long_chains_of_dead_ends_leave(spark):
    """A path that a ring of sets eats from its end, one node a step."""
    n = 12
    pairs = {("a", "b"): [(i, i) for i in range(n)], ("b", "c"): [(i, i) for i in range(n)], ("c", "a"): [(i, i + 1) for i in range(n - 1)]}
    roles = {q: spark.range(n).select(F.col("id").alias(q)) for q in "abc"}
    links = {k: spark.createDataFrame(v, f"{k[0]} long, {k[1]} long") for k, v in pairs.items()}
    assert all(r.count() == 0 for r in fixpoint.consistent(roles, links).values())
    links["c", "a"] = spark.createDataFrame([*pairs["c", "a"], (n - 1, 5)], "c long, a long")
    out = fixpoint.consistent(roles, links)
    assert [sorted(r[0] for r in out[q].collect()) for q in "abc"] == [list(range(5, n))] * 3


def test_nested_support(spark):
    edge = lambda i, s, o: (i, s, o)
    edges = spark.createDataFrame([
        edge("r", "n1", "n2"), edge("x1", "n1", "m1"), edge("x2", "m1", "n2"), edge("y1", "m1", "k1"), edge("z1", "k1", "j1"),
        edge("ends", "n2", "j1"), edge("far", "q1", "q2"), edge("w", "j1", "v1"), edge("open", "n1", None), edge("lost", "v1", "gone")],
        "id string, subject string, object string")
    nodes = spark.createDataFrame([(x,) for x in ("n1", "n2", "m1", "k1", "j1", "q1", "q2", "v1")], "id string")
    aux = spark.createDataFrame([("A", "x1"), ("A", "x2"), ("B", "y1"), ("C", "z1"), ("C", "r"), ("D", "far"), ("E", "w"), ("E", "nowhere"), ("G", "lost"), ("S", "w")], "aux_id string, edge_id string")
    supports = spark.createDataFrame([("r", "A"), ("x1", "B"), ("y1", "C"), ("z1", "A"), ("far", "D"), ("ends", "E"), ("ends", "G"), ("r", "absent")], "edge_id string, aux_id string")
    none, results = spark.createDataFrame([], "node_id string"), spark.createDataFrame([("r",)], "edge_id string")
    ids, kept, graphs = match.referenced(edges, none, results, aux, supports, None, nodes)
    assert sorted(r[0] for r in kept.collect()) == ["ends", "r", "x1", "x2", "y1", "z1"]
    assert sorted(r[0] for r in ids.collect()) == ["j1", "k1", "m1", "n1", "n2"]
    assert sorted(r[0] for r in graphs.collect()) == ["A", "B", "C"]
    seeds = spark.createDataFrame([("S",)], "aux_id string")
    _, kept, graphs = match.referenced(edges, none, results.limit(0), aux, supports, seeds, nodes)
    assert sorted(r[0] for r in kept.collect()) == ["w"] and [r[0] for r in graphs.collect()] == ["S"]
