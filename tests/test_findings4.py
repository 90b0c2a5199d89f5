"""Findings of round 4: whole jobs, and less is moved with the same results."""

from __future__ import annotations

import random

import pytest

from plexus.etl import synonyms
from plexus.operators import fixpoint, infer, multiway, overlay, paths
from tests.test_operators import propagated


def test_names_of_many_bearers_keep_their_pairs(spark):
    """no name is left out for its number of bearers, in pairs or in the groups that stand for them."""
    df = spark.createDataFrame([(f"n{i:03d}", "same name") for i in range(300)], "id string, name string")
    assert synonyms.name_edges(df).count() == 300 * 299 // 2
    groups = synonyms.name_groups(df).selectExpr("key as group", "id", "0.1D as weight", "true as hears", "true as speaks")
    out = synonyms.label_propagation(df.select("id"), None, groups=groups)
    ids = [f"n{i:03d}" for i in range(300)]
    want = propagated(ids, [(a, b, 0.1) for a in ids for b in ids if a < b], {})
    assert {r["id"]: r["label"] for r in out.collect()} == want and len(set(want.values())) < 300
    one = synonyms.clusters(df, df.selectExpr("id", "'n000' as label"), None, synonyms.name_groups(df)).first()
    assert (one["size"], one["n_edges"]) == (300, 300 * 299 // 2)


@pytest.mark.parametrize("local", [None, 1])
def test_groups_spread_labels_as_their_pairs_do(spark, monkeypatch, local):
    """groups, some with members that only hear or only speak, beside pairs; in tasks and by rounds over tables."""
    if local is not None:
        monkeypatch.setattr(synonyms, "LOCAL", local)
    rnd = random.Random(7)
    ids = [f"n{i:02d}" for i in range(40)]
    weight, pairs, members = {}, [], []

    def link(a, b, w):
        weight[min(a, b), max(a, b)] = weight.get((min(a, b), max(a, b)), 0.0) + w

    for g, (low, high) in enumerate([(0, 12), (8, 20), (20, 26), (24, 38)]):
        for a in ids[low:high]:
            members.append((f"g{g}", a, 0.1 * (g + 1), True, True))
            for b in ids[low:high]:
                if a < b:
                    link(a, b, 0.1 * (g + 1))
    for a in ids[3:9]:  # two sides: each hears the other alone
        members += [("left", a, 1.0, False, True), ("right", a, 1.0, True, False)]
        for b in ids[21:25]:
            link(a, b, 1.0)
    for b in ids[21:25]:
        members += [("right", b, 1.0, False, True), ("left", b, 1.0, True, False)]
    for _ in range(25):
        a, b = rnd.sample(ids, 2)
        pairs.append((min(a, b), max(a, b), rnd.choice([0.1, 0.3, 0.7])))
    pairs = list({p[:2]: p for p in pairs}.values())
    for a, b, w in pairs:
        link(a, b, w)
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    groups = frame(members, "group string, id string, weight double, hears boolean, speaks boolean")
    for fixed in ({}, {"n00": "A", "n15": "B", "n30": "B"}):
        given = frame(list(fixed.items()), "id string, label string") if fixed else None
        out = synonyms.label_propagation(frame([(i,) for i in ids], "id string"), frame(pairs, "a string, b string, weight double"), given, groups=groups)
        assert {r["id"]: r["label"] for r in out.collect()} == propagated(ids, [(a, b, w) for (a, b), w in weight.items()], fixed)


def test_pairs_between_neighbours_close_a_cycle(spark):
    """rows of a four-cycle meet the pairs that its last node closes; no row grows by all links of one neighbour."""
    left = [(i, j) for i in range(9) for j in range(12) if (i * j) % 4 == 0]
    right = [(i, j) for i in range(20, 23) for j in range(12) if (i + j) % 5 == 0]
    frame = lambda rows, *names: spark.createDataFrame(rows, ", ".join(f"{n} long" for n in names))
    links = {("o", "p"): frame(left, "o", "p"), ("u", "p"): frame(right, "u", "p"), ("o", "q"): frame(left, "o", "q"), ("u", "q"): frame(right, "u", "q")}
    out = multiway.bind(["o", "p", "u", "q"], links)
    want = [(o, p, u, q) for o, p in left for u, x in right if x == p for y, q in left if y == o and (u, q) in right]
    assert sorted(tuple(r) for r in out.collect()) == sorted(want)
    assert "LeftSemi" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_similar_subjects_meet_in_blocks(spark, monkeypatch):
    """pairs inside a block and between blocks, each counted where its lists meet."""
    monkeypatch.setattr(overlay, "BLOCK", 3)
    rnd = random.Random(3)
    sets = {f"s{i:02d}": set(rnd.sample(range(30), rnd.randint(1, 14))) for i in range(11)}
    edges = spark.createDataFrame([(s, f"o{o}") for s, v in sets.items() for o in v] * 2 + [("s00", None), (None, "o1")], "subject string, object string")
    out = overlay.similar_neighbours(edges, 0.25)
    score = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    assert {(r["a"], r["b"]): r["similarity"] for r in out.collect()} == {k: v for k, v in score.items() if v >= 0.25}
    counts = [x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate" in x and "count" in x]
    assert counts and all("block#" in x for x in counts)


def test_only_edges_at_ends_and_hubs_are_compared(spark):
    """of many edges the best is taken after those at no end and no hub have left; nothing is written in between."""
    edges = spark.createDataFrame([("e1", "a", "m", "p"), ("e2", "m", "a", "q"), ("e3", "m", "h", "p"), ("e4", "t", "h", "q"), ("e5", "x", "y", "q")],
                                  "id string, subject string, object string, predicate string")
    of = lambda rows, schema: spark.createDataFrame(rows, schema)
    args = of([("h",)], "id string"), of([("p", 1), ("q", 2)], "predicate string, depth int"), of([("m",)], "id string")
    out = infer.half_paths(of([("a",), ("t",)], "node string"), edges, *args)
    assert sorted((r["node"], r["hub"], r["way"], r["mid"], r["relevant"]) for r in out.collect()) == [("a", "h", ["e2", "e3"], "m", True), ("t", "h", ["e4"], None, True)]
    plan = out._jdf.queryExecution().analyzed().toString().splitlines()
    best = [i for i, x in enumerate(plan) if "Aggregate" in x and "max(" in x and "depth" in x]
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    for i in best:
        inside = next((j for j in range(i + 1, len(plan)) if depth(plan[j]) <= depth(plan[i])), len(plan))
        assert any("LeftSemi" in x for x in plan[i:inside])
    assert best


def test_creative_filter_writes_no_table(spark):
    """results, bad edges and nodes meet in one shuffle by result; nulls stay apart."""
    of = lambda rows, schema: spark.createDataFrame(rows, schema)
    bound = of([("r1", "q", "e1"), ("r1", "p", "e2"), ("r2", "q", "e3"), ("r2", "p", "e2"), ("r3", "q", "e1"), ("r4", "q", "e1"), ("r4", "p", "e3"), ("r4", "p", "e2"), ("r4", "q", "e3"),
                ("r5", "q", None), ("r5", "p", "e2"), (None, "q", "e1"), (None, "p", "e2")], "result_id string, qedge_key string, edge_id string")
    nodes = of([("r1", "a", "n1", 7), ("r1", "b", "n9", 8), ("r1", "b", None, 9), ("r2", "a", "n1", 1), ("r3", "a", "n1", 1), ("r4", "c", "n3", 2), ("r4", "c", "n4", 3), ("r5", "c", "n3", 4), (None, "a", "n1", 5)],
               "result_id string, qnode_key string, node_id string, more long")
    edges = of([("e1", "n1", "n2"), ("e2", "n2", "n3"), ("e3", "n3", "n4")], "id string, subject string, object string")
    before = spark.sparkContext._jsc.sc().dagScheduler().nextJobId()
    kept, left = paths.creative_filter(bound, nodes, edges, of([("e1",)], "edge_id string"), ["q"], ["q", "p"])
    assert spark.sparkContext._jsc.sc().dagScheduler().nextJobId() == before
    want = [("r1", "q", "e1"), ("r1", "p", "e2"), ("r4", "q", "e1"), ("r4", "p", "e2"), ("r5", "q", None), ("r5", "p", "e2")]
    assert sorted(str(tuple(r)) for r in kept.collect()) == sorted(map(str, want))
    assert sorted(tuple(r) for r in left.collect()) == [("r1", "a", "n1", 7), ("r4", "c", "n3", 2), ("r5", "c", "n3", 4)]


@pytest.mark.parametrize("most", [250_000, 14, 0])
def test_results_of_sets_settle_in_tasks_or_by_joins(spark, monkeypatch, most):
    """dead ends leave alike in small results, swept in a task each, and in large ones."""
    monkeypatch.setattr(fixpoint, "LOCAL", most or 1)
    rnd = random.Random(5)
    pick = lambda one, two, n: {(rnd.randrange(one), rnd.randrange(two)) for _ in range(n)}
    pairs = {("o", "p"): pick(12, 12, 40), ("p", "s"): pick(12, 12, 30), ("o", "s"): pick(12, 12, 30)}
    roles = {q: pick(6, 12, 34) for q in "ops"}
    live = {(c, q, x) for q, rows in roles.items() for c, x in rows}
    while True:
        ok = {(c, q, x) for c, q, x in live if all(
            any((y, x)[::1 if q == b else -1] in pairs[a, b] and (c, a if q == b else b, y) in live for y in range(12)) for a, b in pairs if q in (a, b))}
        if ok == live:
            break
        live = ok
    frame = lambda rows, *names: spark.createDataFrame(sorted(rows), ", ".join(f"{n} long" for n in names))
    out = fixpoint.consistent({q: frame(rows, "c", q) for q, rows in roles.items()}, {k: frame(v, *k) for k, v in pairs.items()}, ["c"])
    got = {(r["c"], q, r[q]) for q, rows in out.items() for r in rows.collect()}
    assert got == live and live
