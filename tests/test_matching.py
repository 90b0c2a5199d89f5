"""Matching on small graphs with known answers."""

from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from plexus.operators import match
from plexus.plans.pattern import Pattern, QEdge, QNode


def graph(spark, nodes: dict, edges: dict):
    n = spark.createDataFrame([(k, i) for k, ids in nodes.items() for i in ids] or [], "qnode_key string, node_id string")
    rows = [(k, f"{k}:{e}", *e.split("--")) for k, es in edges.items() for e in es]
    return n, spark.createDataFrame(rows, "qedge_key string, id string, subject string, object string")


def pattern(nodes: dict, edges: dict) -> Pattern:
    return Pattern(tuple(QNode(k, is_set=bool(v)) for k, v in nodes.items()), tuple(QEdge(k, *v.split("--")) for k, v in edges.items()))


def rows(df):
    return sorted(tuple(sorted(v) if isinstance(v, list) else v for v in r) for r in df.collect())


def test_set_leaf_gives_one_result_per_single_node(spark):
    p = pattern({"n01": "", "D": "", "n02": "is_set"}, {"e1": "n01--D", "e2": "D--n02"})
    kg = graph(spark, {"n01": ["P1", "P2"], "D": ["D"], "n02": ["H1", "H2", "H3"]},
               {"e1": ["P1--D", "D--P2"], "e2": ["D--H1", "H2--D", "D--H3"]})
    assert rows(match.match(p, *kg)) == [("P1", "D", ["H1", "H2", "H3"]), ("P2", "D", ["H1", "H2", "H3"])]


def test_set_in_the_middle(spark):
    p = pattern({"n02": "", "n01": "is_set", "D": ""}, {"e1": "n02--n01", "e2": "n01--D"})
    kg = graph(spark, {"n02": ["C1", "C2"], "n01": ["P1", "P2"], "D": ["D"]},
               {"e1": ["C1--P1", "C1--P2", "C2--P1", "C2--P2"], "e2": ["P1--D", "P2--D"]})
    assert rows(match.match(p, *kg)) == [("C1", ["P1", "P2"], "D"), ("C2", ["P1", "P2"], "D")]


def test_one_node_may_fill_two_query_nodes(spark):
    p = pattern({"n00": "", "n01": ""}, {"e00": "n00--n01"})
    kg = graph(spark, {"n00": ["S"], "n01": ["H1", "H2", "S"]}, {"e00": ["S--H1", "S--H2", "S--S"]})
    assert rows(match.match(p, *kg)) == [("S", "H1"), ("S", "H2"), ("S", "S")]


def test_direction(spark):
    p = pattern({"a": "", "b": ""}, {"e": "a--b"})
    kg = graph(spark, {"a": ["A"], "b": ["B", "C"]}, {"e": ["B--A", "A--C"]})
    assert rows(match.match(p, *kg)) == [("A", "B"), ("A", "C")]
    assert rows(match.match(p, *kg, ignore_direction=False)) == [("A", "C")]


def test_unfulfilled_node_gives_nothing(spark):
    p = pattern({"n0": "", "n1": ""}, {"e": "n0--n1"})
    assert rows(match.match(p, *graph(spark, {"n1": ["X"]}, {"e": ["Y--X"]}))) == []


def test_dead_ends_and_unconnected_nodes(spark):
    p = pattern({"n00": "", "n01": "is_set", "n02": ""}, {"e0": "n00--n01", "e1": "n01--n02"})
    kg = graph(spark, {"n00": ["D1", "DX"], "n01": ["P0", "P1", "DeadEnd"], "n02": ["C1", "CX"]},
               {"e0": ["D1--P0", "D1--P1", "D1--DeadEnd"], "e1": ["P0--C1", "P1--C1"]})
    assert rows(match.match(p, *kg)) == [("D1", ["P0", "P1"], "C1")]


def test_parallel_edges_need_every_query_edge(spark):
    p = pattern({"a": "", "b": "is_set"}, {"e0": "a--b", "e1": "a--b"})
    kg = graph(spark, {"a": ["A"], "b": ["B1", "B2"]}, {"e0": ["A--B1", "A--B2"], "e1": ["B2--A"]})
    assert rows(match.match(p, *kg)) == [("A", ["B2"])]


def test_edgeless_and_disconnected(spark):
    kg = graph(spark, {"a": ["A"], "b": ["B"]}, {})
    assert len(rows(match.match(pattern({"a": "", "b": ""}, {}), *kg))) == 1
    with pytest.raises(ValueError, match="DisconnectedQG"):
        match.match(pattern({"a": "", "b": "", "c": ""}, {"e": "a--b"}), *kg)


def test_option_group_keeps_required_result(spark):
    p = Pattern((QNode("a"), QNode("b"), QNode("x", is_set=True, option_group="g")),
                (QEdge("e0", "a", "b"), QEdge("e1", "b", "x", option_group="g")))
    kg = graph(spark, {"a": ["A"], "b": ["B1", "B2"], "x": ["X1", "X2"]}, {"e0": ["A--B1", "A--B2"], "e1": ["B1--X1", "B1--X2"]})
    out = {r["b"]: r["x"] for r in match.with_options(p, *kg).collect()}
    assert out == {"B1": ["X1", "X2"], "B2": None}


def test_distances_and_essence():
    p = pattern({"n01": "", "D": "", "n02": ""}, {"e1": "n01--D", "e2": "D--n02"})
    assert p.distances("n01") == {"n01": 0, "D": 1, "n02": 2}
    assert p.distances("D") == {"n01": 1, "D": 0, "n02": 1}
    q = Pattern((QNode("a", ids=("X",)), QNode("b"), QNode("c")), p.edges and (QEdge("e", "a", "b"), QEdge("f", "b", "c")))
    assert q.essence_node() == "c"


def test_recomputed_keys_and_bindings(spark):
    p = pattern({"n00": "", "n01": ""}, {"e00": "n00--n01"})
    kg = graph(spark, {"n00": ["A"], "n01": ["B"]}, {"e00": ["A--B"]})
    results = match.result_id(match.match(p, *kg), p)
    bound = match.bound_nodes(results, p)
    assert {r["node_id"]: r["qnode_keys"] for r in match.recompute_keys(bound).collect()} == {"A": ["n00"], "B": ["n01"]}
    assert [r["edge_id"] for r in match.bound_edges(bound, p, kg[1]).collect()] == ["e00:A--B"]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.sets(st.tuples(st.integers(0, 3), st.integers(0, 3)), max_size=8), st.sets(st.tuples(st.integers(0, 3), st.integers(0, 3)), max_size=8))
def test_chain_equals_brute_force(spark, first, second):
    p = pattern({"a": "", "b": "is_set", "c": ""}, {"e0": "a--b", "e1": "b--c"})
    kg = graph(spark, {k: [f"{k}{i}" for i in range(4)] for k in "abc"},
               {"e0": [f"a{i}--b{j}" for i, j in first], "e1": [f"b{i}--c{j}" for i, j in second]})
    want = {}
    for i, j in first:
        for k, m in second:
            if j == k:
                want.setdefault((f"a{i}", f"c{m}"), set()).add(f"b{j}")
    assert rows(match.match(p, *kg)) == sorted((a, sorted(b), c) for (a, c), b in want.items())


def test_edges_at_optional_nodes_must_be_optional(spark):
    nodes = (QNode("a"), QNode("b", option_group="g"))
    with pytest.raises(ValueError, match="MissingOptionalLabel"):
        Pattern(nodes, (QEdge("e", "a", "b"),)).check()
    Pattern(nodes, (QEdge("e", "a", "b", option_group="g"),)).check()


def test_mismatched_nodes(spark):
    pattern = Pattern((QNode("a"), QNode("b")), (QEdge("e", "a", "b"), QEdge("loop", "a", "a")))
    kg_nodes = spark.createDataFrame([("a", "x"), ("b", "y"), ("b", "z")], "qnode_key string, node_id string")
    rows = [("e", "1", "x", "y"), ("e", "2", "y", "x"), ("e", "3", "y", "z"), ("e", "4", "x", "q"), ("e", "5", None, "y"), ("loop", "6", "x", "x")]
    kg_edges = spark.createDataFrame(rows, "qedge_key string, id string, subject string, object string")
    assert sorted(r["id"] for r in match.mismatched(pattern, kg_nodes, kg_edges).collect()) == ["3", "4"]
    assert sorted(r["id"] for r in match.mismatched(pattern, kg_nodes, kg_edges, ignore_direction=False).collect()) == ["2", "3", "4"]
