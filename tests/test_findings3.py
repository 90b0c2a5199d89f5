"""Findings of round 3: less is moved, with the same results."""

from __future__ import annotations

from plexus.operators import expand, fixpoint, match, multiway, overlay
from plexus.plans.pattern import Pattern, QEdge, QNode


def test_edges_name_their_aux_graph(spark):
    edges = spark.createDataFrame([("r", "a", "b", "A"), ("x", "b", "c", "B"), ("y", "c", "d", None), ("far", "p", "q", "A"), ("back", "d", "a", None)],
                                  "id string, subject string, object string, aux_id string")
    aux = spark.createDataFrame([("A", "x"), ("B", "y")], "aux_id string, edge_id string")
    none, results = spark.createDataFrame([], "node_id string"), spark.createDataFrame([("r",)], "edge_id string")
    ids, kept, graphs = match.referenced(edges, none, results, aux)
    assert sorted(r[0] for r in kept.collect()) == ["back", "r", "x", "y"]
    assert sorted(r[0] for r in ids.collect()) == ["a", "b", "c", "d"]
    assert sorted(r[0] for r in graphs.collect()) == ["A", "B"]


def test_light_neighbours_are_not_counted(spark, monkeypatch):
    """Rows around a cycle are the same by either way, and no row is counted where one end is light."""
    edges = {("a", "b"): [(i, j) for i in range(6) for j in range(5)], ("b", "c"): [(j, k) for j in range(5) for k in range(7) if (j + k) % 3], ("a", "c"): [(i, k) for i in range(6) for k in (i, i + 1)]}
    links = {k: spark.createDataFrame(v, f"{k[0]} long, {k[1]} long") for k, v in edges.items()}
    light = multiway.bind(["a", "b", "c"], links)
    assert "__by" not in light._jdf.queryExecution().logical().toString()
    rows = sorted(tuple(r) for r in light.collect())
    monkeypatch.setattr(multiway, "FEW", 0)
    assert rows == sorted(tuple(r) for r in multiway.bind(["a", "b", "c"], links).collect())
    assert rows == sorted((a, b, c) for a, b in edges["a", "b"] for x, c in edges["a", "c"] if x == a and (b, c) in edges["b", "c"])


def test_cycle_of_bound_edges_alone(spark):
    """Without nodes the ends of a query edge's edges are its nodes, in the direction of the edges."""
    rows = [("e0", "o1", "p1"), ("e0", "o2", "p1"), ("e1", "s1", "p1"), ("e2", "o1", "s1"), ("e2", "s1", "o2")]
    kg_edges = spark.createDataFrame(rows, "qedge_key string, subject string, object string")
    triangle = Pattern((QNode("o"), QNode("p"), QNode("s")), (QEdge("e0", "o", "p"), QEdge("e1", "s", "p"), QEdge("e2", "o", "s")))
    assert [tuple(r) for r in match.match(triangle, None, kg_edges).collect()] == [("o1", "p1", "s1")]


def test_sets_of_each_result_take_their_own_links(spark):
    """Dead ends leave result by result; a result without any link loses all."""
    roles = {q: spark.createDataFrame(v, f"c long, {q} string") for q, v in {
        "o": [(1, "o1"), (1, "o2"), (2, "o1")], "p": [(1, "p1"), (1, "p2"), (2, "p1")], "s": [(1, "s1"), (2, "s2")]}.items()}
    pairs = {("o", "p"): [("o1", "p1"), ("o2", "p2")], ("p", "s"): [("p1", "s1"), ("p2", "s9")], ("o", "s"): [("o1", "s1"), ("o1", "s2"), ("o2", "s1")]}
    links = {k: spark.createDataFrame(v, f"{k[0]} string, {k[1]} string") for k, v in pairs.items()}
    out = fixpoint.consistent(roles, links, ["c"])
    assert {q: sorted(tuple(r) for r in rows.collect()) for q, rows in out.items()} == {"o": [(1, "o1")], "p": [(1, "p1")], "s": [(1, "s1")]}
    gone = fixpoint.consistent({q: rows.where("c = 2") for q, rows in roles.items()}, links, ["c"])
    assert all(rows.count() == 0 for rows in gone.values())


def test_jaccard_joins_ends_before_it_compares_edges(spark):
    """Edges that lead to no start and no end are in no shuffle of the distinct ones; repeats count once."""
    edges = spark.createDataFrame([("s", "m"), ("m", "s"), ("s", "n"), ("m", "e"), ("m", "e"), ("x", "m")], "a string, b string")
    of = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id string")
    out = overlay.jaccard(edges, of("s", "e"), of("m", "n"), of("e"))
    assert [tuple(r) for r in out.collect()] == [("s", "e", 0.5)]
    plan = out._jdf.queryExecution().analyzed().toString().splitlines()
    distinct, unions = [i for i, x in enumerate(plan) if "Deduplicate" in x or "Distinct" in x], [i for i, x in enumerate(plan) if "Union" in x]
    assert all(any("LeftSemi" in x for x in plan[i:min(u for u in unions if u > i)]) for i in distinct)


def test_id_conversion_reads_equivalents_once_and_joins_after(spark):
    """The least of many equivalents comes by its order and its name; only ids of another prefix need one."""
    ids = spark.createDataFrame([("P:1",), ("P:2",), ("S:9",), ("P:3",)], "id string")
    equivalents = spark.createDataFrame([("P:1", "O:1"), ("P:1", "S:3"), ("P:1", "S:20"), ("P:2", "X:1"), ("S:9", "S:1"), ("P:3", "O:5"), ("P:3", None)], "id string, other string")
    out = expand.convert_ids(ids, equivalents, ["S", "O"])
    assert sorted(tuple(r) for r in out.collect()) == [("P:1", "S:20"), ("P:2", None), ("P:3", "O:5"), ("S:9", "S:9")]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_similar_subjects_are_counted_by_number(spark):
    """No names of subjects are in the count of pairs; names decide which of a pair comes first."""
    sets = {"z": {1, 2, 3}, "b": {2, 3, 4}, "m": {3, 9}, "q": {7}}
    edges = spark.createDataFrame([(s, f"o{o}") for s, v in sets.items() for o in v] * 2, "subject string, object string")
    out = overlay.similar_neighbours(edges, 0.3)
    assert sorted(tuple(r) for r in out.collect()) == [("b", "z", 0.5)]
    counts = [x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate" in x and "count" in x]
    assert counts and all("ka#" in x and "subject#" not in x for x in counts)
