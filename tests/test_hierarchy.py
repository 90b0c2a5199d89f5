"""Intervals of hierarchies, scores by cuts and walks, inherited groups."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plexus.operators import expand, overlay, rank
from plexus.plans.hierarchy import hierarchy


def below(pairs, name):
    out, todo = {name}, [name]
    while todo:
        at = todo.pop()
        for child, parent in pairs:
            if parent == at and child not in out:
                out.add(child)
                todo.append(child)
    return out


def test_ranges_are_all_descendants():
    rng = random.Random(4)
    for size in (2, 5, 30, 120):
        pairs = [(f"n{i}", f"n{rng.randrange(i)}") for i in range(1, size) for _ in range(rng.choice([1, 1, 2, 3]))]
        h = hierarchy(pairs)
        names = {x for p in pairs for x in p}
        assert sorted(h.numbers.values()) == list(range(len(names)))
        for name in names:
            inside = {x for x in names if any(lo <= h.numbers[x] <= hi for lo, hi in h.ranges[name])}
            assert inside == below(pairs, name)
    tree = hierarchy([(f"t{i}", f"t{(i - 1) // 2}") for i in range(1, 63)])
    assert all(len(r) == 1 for r in tree.ranges.values())
    for circle in ([("a", "b"), ("b", "a")], [("a", "a")], [("a", "b"), ("b", "c"), ("c", "b")]):
        with pytest.raises(ValueError):
            hierarchy(circle)


def test_parent_predicates_reach_the_scan(spark, tmp_path):
    h = hierarchy([("treats", "affects"), ("causes", "affects"), ("affects", "related"), ("near", "related")])
    rows = [(f"e{i}", f"s{i % 5}", f"o{i % 7}", p) for i, p in enumerate(["treats", "causes", "near", "affects", "other", "related"] * 20)]
    path = str(tmp_path / "edges")
    h.numbered(spark.createDataFrame(rows, "id string, subject string, object string, predicate string"), "predicate", "predicate_no").write.parquet(path)
    edges = spark.read.parquet(path)
    nodes = spark.createDataFrame([(f"{k}{i}",) for k in "so" for i in range(7)], "id string")
    out = expand.one_hop(edges, nodes, nodes, ["affects"], directed=True, hierarchy=h)
    assert {r["predicate"] for r in out.collect()} == {"treats", "causes", "affects"} and out.count() == 60
    plan = out._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(predicate_no" in plan and "LessThanOrEqual(predicate_no" in plan
    assert expand.one_hop(edges, nodes, nodes, ["unknown"], directed=True, hierarchy=h).count() == 0


@pytest.mark.parametrize("arcs", [
    {"e0": ("a", "b"), "e1": ("b", "d"), "e2": ("a", "c"), "e3": ("c", "d"), "e4": ("b", "c")},
    {"e0": ("a", "b"), "e1": ("b", "c"), "e2": ("c", "a")},
    {"e0": ("a", "b"), "e1": ("a", "b"), "e2": ("b", "c"), "e3": ("d", "c"), "e4": ("c", "e")},
    {"e0": ("a", "a")},
])
def test_scores_equal_flows_and_matrix_powers(spark, arcs):
    rng = random.Random(6)
    weights = {(r, k): round(rng.random(), 3) for r in range(6) for k in arcs if (r, k) != (5, "e0")}
    df = spark.createDataFrame([(r, k, w) for (r, k), w in weights.items()], "result_id long, qedge_key string, weight double")
    names = sorted({x for ends in arcs.values() for x in ends})
    steps = {(s, t): n for s in names for t in names if s != t and (n := next((n for n in range(1, 9) if walks(arcs, s, t, n)), 0))}
    longest = max(steps.values(), default=0)
    pairs = [p for p, n in steps.items() if n == longest]
    for r in rank.pattern_scores(df, arcs).collect():
        a = np.zeros((len(names), len(names)))
        listed = []
        for k, (s, t) in arcs.items():
            w = weights.get((r["result_id"], k), 0.0)
            a[names.index(s), names.index(t)] += w
            listed.append((s, t, w))
        power = np.linalg.matrix_power(a, longest) / math.factorial(longest)
        flows = [rank.max_flow(listed, s, t) for s, t in pairs]
        mixed = lambda xs: 1 - math.prod(1 - min(x, 1.0) for x in xs) if pairs else 1.0
        assert r["max_flow"] == pytest.approx(mixed(flows)) and r["frobenius"] == pytest.approx(np.sqrt((a * a).sum()))
        assert r["longest_path"] == pytest.approx(mixed([power[names.index(s), names.index(t)] for s, t in pairs]))


def walks(arcs, s, t, n):
    at = {s}
    for _ in range(n):
        at = {b for a, b in arcs.values() if a in at}
    return t in at


def test_cuts_of_a_long_chain_are_few():
    arcs = {f"e{i}": (f"n{i}", f"n{i + 1}") for i in range(25)}
    assert sorted(next(iter(c)) for c in rank.cuts(arcs, "n0", "n25")) == sorted(arcs)
    assert rank.cuts({"e": ("a", "b")}, "b", "a") == [set()]


def test_inherited_groups(spark):
    options = [None, "a", "b"]
    ends = list(itertools.product(options, repeat=2))
    virtual = spark.createDataFrame([(i, f"s{i}", f"o{i}") for i in range(len(ends))], "id long, subject string, object string")
    groups = spark.createDataFrame([(f"{k}{i}", x) for i, e in enumerate(ends) for k, x in zip("so", e, strict=True)], "node_id string, option_group string")
    got = {r["id"]: (r["option_group"], r["clash"]) for r in overlay.inherited_groups(virtual, groups).collect()}
    for i, e in enumerate(ends):
        try:
            assert got[i] == (overlay.inherited_group(set(e)), False)
        except ValueError:
            assert got[i] == (None, True)
    assert overlay.inherited_groups(virtual, groups.limit(0)).where(F.col("option_group").isNotNull()).count() == 0
