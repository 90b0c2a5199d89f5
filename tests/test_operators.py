"""Operators whose results no SQL states, and rules that only small cases show."""

from __future__ import annotations

import math
import random
from decimal import Decimal, getcontext

import pytest
from pyspark.sql import functions as F

from plexus.etl import synonyms
from plexus.functions.components import components
from plexus.functions.hypergeometric import fisher_p, log_probability, two_sided
from plexus.operators import expand, filters, overlay, paths, rank
from plexus.sources.lens import PropertyGraph


def test_fisher_known_values(spark):
    t = spark.createDataFrame([(8, 2, 1, 5), (3, 1, 1, 3)], "a long, b long, c long, d long")
    got = {r["a"]: r["p"] for r in fisher_p(t).collect()}
    assert got[8] == pytest.approx(0.034965, abs=1e-6)
    assert got[3] == pytest.approx(0.485714, abs=1e-6)


def exact_log(k, rows, cols, n):
    """The logarithm of a table's probability by factorials of sixty digits."""
    getcontext().prec = 60
    two_pi = 2 * Decimal("3.14159265358979323846264338327950288419716939937510582097494")

    def log_factorial(m):
        if m < 60:
            return Decimal(math.factorial(m)).ln() if m > 1 else Decimal(0)
        x = Decimal(m + 1)
        series = sum(Decimal(b) / c / (2 * i * (2 * i - 1) * x ** (2 * i - 1)) for i, (b, c) in enumerate([(1, 6), (-1, 30), (1, 42), (-1, 30), (5, 66), (-691, 2730)], 1))
        return (x - Decimal("0.5")) * x.ln() - x + two_pi.ln() / 2 + series

    f = log_factorial
    return float(f(rows) + f(n - rows) + f(cols) + f(n - cols) - f(n) - f(k) - f(rows - k) - f(cols - k) - f(n - rows - cols + k))


def test_table_probabilities_keep_their_digits():
    rng = random.Random(1)
    for _ in range(200):
        most = 10 ** rng.randrange(1, 10)
        a, b, c, d = (rng.randrange(most) for _ in range(4))
        if a + b + c + d:
            assert log_probability(a, a + b, a + c, a + b + c + d) == pytest.approx(exact_log(a, a + b, a + c, a + b + c + d), rel=1e-12, abs=1e-11)


def test_exact_test_of_all_small_and_of_huge_tables():
    rng = random.Random(2)
    for _ in range(300):
        a, b, c, d = (rng.randrange(rng.choice([3, 10, 60])) for _ in range(4))
        rows, cols, n = a + b, a + c, a + b + c + d
        logs = [exact_log(k, rows, cols, n) for k in range(max(0, rows + cols - n), min(rows, cols) + 1)]
        seen = exact_log(a, rows, cols, n)
        assert two_sided(a, b, c, d) == pytest.approx(min(1.0, sum(math.exp(x) for x in logs if x <= seen + 1e-7)), abs=1e-12)
    big = 10**9
    for t in ((big, big, big, big + 50_000), (big + 40_000, big, big, big + 40_000)):
        rows, cols, n = t[0] + t[1], t[0] + t[2], sum(t)
        spread = math.sqrt(rows * (n - rows) / n * cols * (n - cols) / n / n)
        away = abs(t[0] - rows * cols / n) / spread  # so many steps, all nearly normal
        assert two_sided(*t) == pytest.approx(math.erfc((away - 0.5 / spread) / math.sqrt(2)), rel=1e-4)
    assert two_sided(big, big, big, big) == 1.0


def test_confidence_combines_any_order(spark):
    df = spark.createDataFrame([(0.9,), (0.99,), (0.98,), (0.5,)], "w double")
    assert df.agg(rank.combined(df["w"]).alias("c")).first()["c"] == pytest.approx(1 - 0.1 * 0.01 * 0.02 * 0.5)


def test_max_flow_by_cuts():
    arcs = [("s", "a", 0.5), ("s", "b", 0.4), ("a", "t", 0.3), ("b", "t", 0.6), ("a", "b", 0.5)]
    assert rank.max_flow(arcs, "s", "t") == pytest.approx(0.9)
    assert rank.max_flow([("a", "b", 1.0)], "b", "a") == 0.0


def test_ties_are_broken_downwards(spark):
    df = spark.createDataFrame([(f"r{i}", s) for i, s in enumerate([1.0, 1.0, 1.0, 0.5, 0.5])], "result_id string, score double")
    got = {r["result_id"]: r["score"] for r in rank.break_ties(df, [F.desc("score"), F.asc("result_id")]).collect()}
    assert got == {"r0": 1.0, "r1": 0.999, "r2": 0.998, "r3": 0.5, "r4": 0.499}


def test_label_propagation_keeps_islands_apart(spark):
    ids = [f"{k}{i}" for k in "ab" for i in range(4)]
    nodes = spark.createDataFrame([(i,) for i in ids], "id string")
    pairs = [(f"{k}{i}", f"{k}{j}", 1.0) for k in "ab" for i in range(4) for j in range(i + 1, 4)]
    out = {r["id"]: r["label"] for r in synonyms.label_propagation(nodes, spark.createDataFrame(pairs, "a string, b string, weight double")).collect()}
    assert set(out) == set(ids)
    assert all(out[i][0] == i[0] for i in ids)
    assert len({out[i] for i in ids}) == 2
    fixed = spark.createDataFrame([("a0", "X"), ("a1", "X"), ("a2", "X")], "id string, label string")
    out = {r["id"]: r["label"] for r in synonyms.label_propagation(nodes, spark.createDataFrame(pairs, "a string, b string, weight double"), fixed).collect()}
    assert out["a3"] == "X"


def propagated(nodes, pairs, fixed):
    """The rule of label_propagation in plain Python."""
    from collections import defaultdict
    from hashlib import md5

    near = defaultdict(dict)
    for a, b, w in pairs:
        near[a][b] = near[b][a] = w
    label, rounds = {n: fixed.get(n) for n in nodes}, 0
    for start in ("fixed", "own"):
        if start == "fixed" and not fixed:
            continue
        if start == "own":
            label = {n: x or n for n, x in label.items()}
        while True:
            want = {}
            for n in nodes:
                votes = defaultdict(float)
                for other, w in near[n].items():
                    if label[other] is not None:
                        votes[label[other]] += w
                votes = {x: round(w, 9) for x, w in votes.items()}
                if votes and n not in fixed and max(votes.values()) > votes.get(label[n], 0.0):
                    want[n] = min(x for x, w in votes.items() if w == max(votes.values()))
            move = {n: x for n, x in want.items() if md5(f"{rounds}:{n}".encode()).hexdigest() < "8"}
            label, rounds = label | move, rounds + 1
            if not want:
                break
    return label


def test_label_propagation_runs_until_it_is_stable(spark):
    ids = [f"n{i:02d}" for i in range(45)]  # a chain takes many rounds
    pairs = [(ids[i], ids[i + 1], 1.0 + (i * 7 % 5) / 10) for i in range(44)] + [("n03", "n30", 0.1)]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    for fixed in ({}, {"n00": "A", "n20": "B", "n21": "B"}):
        given = frame(list(fixed.items()), "id string, label string") if fixed else None
        out = synonyms.label_propagation(frame([(i,) for i in ids], "id string"), frame(pairs, "a string, b string, weight double"), given)
        assert {r["id"]: r["label"] for r in out.collect()} == propagated(ids, pairs, fixed)
    with pytest.raises(RuntimeError):
        synonyms.label_propagation(frame([(i,) for i in ids], "id string"), frame(pairs, "a string, b string, weight double"), None, most_rounds=1)


def test_large_name_groups_give_no_pairs(spark):
    df = spark.createDataFrame([(f"n{i:03d}", "same name") for i in range(300)] + [("x", "Other-Name"), ("y", "other name")], "id string, name string")
    assert [tuple(r) for r in synonyms.name_edges(df, most=250).collect()] == [("x", "y")]
    assert synonyms.name_edges(df.where("id < 'n010'"), most=250).count() == 45


def test_components_of_hubs_chains_and_nulls(spark):
    edges = [("hub", f"leaf{i}") for i in range(900)] + [(f"c{i:02d}", f"c{i + 1:02d}") for i in range(40)] + [("leaf5", "c40"), (None, "hub"), ("solo", "solo"), ("p", "q")]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    want = dict.fromkeys([f"leaf{i}" for i in range(900)] + [f"c{i:02d}" for i in range(41)] + ["hub"], "c00") | {"p": "p", "q": "p"}
    assert got == want


def test_paths_are_simple_and_bounded(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("b", "d")], "subject string, object string")
    got = {tuple(r["path"]) for r in paths.connect(e, "a", "d", 3).collect()}
    assert got == {("a", "b", "d"), ("a", "c", "d"), ("a", "b", "c", "d"), ("a", "c", "b", "d")}
    assert {tuple(r["path"]) for r in paths.connect(e, "a", "d", 2).collect()} == {("a", "b", "d"), ("a", "c", "d")}
    blocked = spark.createDataFrame([("b",)], "id string")
    assert {tuple(r["path"]) for r in paths.connect(e, "a", "d", 3, blocked).collect()} == {("a", "c", "d")}
    with pytest.raises(ValueError):
        paths.connect(e, "a", "d", 6)


def test_support_graphs_need_finite_connection(spark):
    chain = [("g3", f"x{i}", f"x{i + 1}", 0.1) for i in range(9)]
    rows = [("e1", "g1", "x", "y"), ("e2", "g2", "x", "y"), ("e3", "g3", "x0", "x9"), ("e4", None, "x", "y"), ("e5", "gone", "x", "y"), ("e6", "g1", "x", "y"), ("e6", "g2", "x", "y"), ("e7", "g2", "x", "x")]
    support = spark.createDataFrame(rows, "edge_id string, aux_id string, from_id string, to_id string")
    aux = spark.createDataFrame([("g1", "y", "x", None), ("g2", "x", "y", math.inf), ("g2", "x", "z", 1.0), *chain], "aux_id string, subject string, object string, ngd double")
    ok = paths.supported(support, aux)
    assert sorted(r["edge_id"] for r in ok.collect()) == ["e1", "e3", "e5", "e7"]
    results = spark.createDataFrame([("r1", "q", "e1"), ("r1", "q", "e2"), ("r1", "p", "k1"), ("r2", "q", "e2"), ("r2", "p", "k1"), ("r3", "q", "e3")], "result_id string, qedge_key string, edge_id string")
    nodes = spark.createDataFrame([("r1", "n0", "x"), ("r1", "n1", "y"), ("r1", "n1", "lost"), ("r2", "n0", "x"), ("r3", "n0", "x0")], "result_id string, qnode_key string, node_id string")
    edges = spark.createDataFrame([("e1", "x", "y"), ("e2", "x", "lost"), ("k1", "y", "x"), ("e3", "x0", "x9")], "id string, subject string, object string")
    kept, bound = paths.creative_filter(results, nodes, edges, ok, ["q"], ["q", "p"])
    assert sorted(map(tuple, kept.collect())) == [("r1", "p", "k1"), ("r1", "q", "e1")]
    assert sorted(map(tuple, bound.collect())) == [("r1", "n0", "x"), ("r1", "n1", "y")]


def test_support_graph_names(spark):
    rows = [("r1", None, e) for e in "ab"] + [("r2", None, e) for e in "abcde"] + [("r2", "g", "a")] + [("r3", None, e) for e in "ba"] + [("r4", None, e) for e in "abcde"]
    got = {(r["result_id"], r["option_group"]): r["aux_id"] for r in paths.support_graphs(spark.createDataFrame(rows, "result_id string, option_group string, edge_id string")).collect()}
    assert got == {("r1", None): "aux_a;b", ("r2", None): "aux_1", ("r2", "g"): "aux_a_g", ("r3", None): "aux_a;b", ("r4", None): "aux_3"}


def test_general_concepts_by_synonyms_and_equivalents(spark):
    rows = [("1", "Disease", [], None), ("2", "x", ["MESH:1"], []), ("3", "x", [], ["General THING"]), ("4", "Disease", None, None), ("5", "fine", [], []), ("6", "y", [], ["z9 pattern"]), ("7", None, [], [])]
    nodes = spark.createDataFrame(rows, "id string, name string, equivalent_ids array<string>, synonyms array<string>")
    edges = spark.createDataFrame([("a", "1", "p", "5"), ("b", "2", "p", "7"), ("c", "4", "p", "5"), ("d", "3", "p", "6")], "id string, subject string, predicate string, object string")
    out = filters.remove_general_concepts(PropertyGraph(nodes, edges), ["mesh:1"], ["disease", "general thing"], ["Z[0-9]"])
    assert sorted(r["id"] for r in out.nodes.collect()) == ["4", "5"] and [r["id"] for r in out.edges.collect()] == ["c"]


def test_treats_rules(spark):
    rows = [("1", "applied_to_treat", ["faers"]), ("2", "applied_to_treat", ["faers"]), ("3", "applied_to_treat", ["unlisted"]), ("4", "studied", ["ctd"]), ("5", "studied", ["semmeddb"]), ("6", "studied", ["semmeddb", "ctd"]), ("7", "applied_to_treat", None)]
    edges = spark.createDataFrame(rows, "id string, predicate string, sources array<string>")
    attrs = spark.createDataFrame([("1", "number_of_cases", 25.0), ("2", "number_of_cases", 24.0), ("3", "number_of_cases", 99.0), ("5", "publications", 10.0), ("6", "publications", 1.0)], "id string, name string, value double")
    assert sorted(r["id"] for r in expand.elevated(edges, attrs).collect()) == ["1", "4", "5", "6"]


def test_empty_and_null_inputs(spark):
    edges = spark.createDataFrame([], "id string, subject string, predicate string, object string")
    nodes = spark.createDataFrame([("n", None, None)], "id string, name string, categories array<string>")
    ids = nodes.select("id")
    assert expand.one_hop(edges, ids, ids).count() == 0
    assert filters.remove_orphans(PropertyGraph(nodes, edges)).nodes.count() == 0
    index = spark.createDataFrame([], "concept string, doc string")
    pair = spark.createDataFrame([("a", "b")], "subject string, object string")
    assert overlay.ngd(index, pair, 7.0).first()["ngd"] == 7.0
    with pytest.raises(ValueError):
        expand.single_node(nodes, [])


def test_parallel_kryptonite_is_membership_per_node(spark):
    kept = spark.createDataFrame([("1", "a", "x"), ("2", "b", "y"), ("3", "a", "y"), ("4", "c", "y")], "id string, s string, o string")
    answer = spark.createDataFrame([("a", "x"), ("b", "y")], "s string, o string")
    assert [r["id"] for r in expand.kryptonite(kept, answer, ["s", "o"]).collect()] == ["4"]


def test_label_propagation_settles_components_in_tasks(spark, monkeypatch):
    rng = random.Random(5)
    ids = [f"{k}{i}" for k in "abcdef" for i in range(12)] + ["alone"]
    pairs = sorted({(f"{k}{i}", f"{k}{j}"): rng.choice([0.1, 1.0, 1.1]) for k in "abcdef" for i in range(12) for j in range(i) if rng.random() < 0.5}.items())
    pairs = [(a, b, w) for (a, b), w in pairs]
    nodes, table = spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame(pairs, "a string, b string, weight double")
    rounds = []
    monkeypatch.setattr(synonyms, "_propagate", lambda *a, old=synonyms._propagate: rounds.append(1) or old(*a))
    for fixed in ({}, {"a0": "X", "b3": "Y", "b4": "X"}):
        given = spark.createDataFrame(list(fixed.items()), "id string, label string") if fixed else None
        for local in (250_000, 60):  # below: some components by rounds over tables
            monkeypatch.setattr(synonyms, "LOCAL", local)
            out = synonyms.label_propagation(nodes, table, given)
            assert {r["id"]: r["label"] for r in out.collect()} == propagated(ids, pairs, fixed)
            assert bool(rounds) == (local == 60)
        rounds.clear()


def test_equivalents_are_listed_once_per_cluster(spark):
    from plexus.services import lookups

    rows = [("x", "1"), ("x", "2"), ("x", "2"), ("y", "2"), ("y", "3"), ("z", "4")]
    clusters, ids = spark.createDataFrame(rows, "cluster_id string, member_id string"), spark.createDataFrame([("1",), ("2",), ("4",), ("9",)], "id string")
    out = lookups.equivalents(ids, clusters)
    assert {r["id"]: r["equivalents"] for r in out.collect()} == {"1": ["1", "2"], "2": ["1", "2", "3"], "4": ["4"]}
    assert {r["id"]: r["equivalents"] for r in lookups.equivalents(ids, clusters, ",").collect()} == {"1": "1,2", "2": "1,2,3", "4": "4"}


def test_top_document_counts_count_only_what_may_lead(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(f"r{i:02d}", f"n{rng.randrange(25)}") for i in range(60) for _ in range(rng.randrange(1, 6))] + [("none", "x")]
    docs = [(f"n{i}", rng.randrange(40)) for i in range(25) for _ in range(rng.randrange(1, 12))]
    bound, documents = spark.createDataFrame(rows, "result_id string, node_id string"), spark.createDataFrame(docs, "id string, doc long")
    read = lambda df: [tuple(r) for r in df.orderBy("place").collect()]
    want = {most: read(rank.sorted_by(rank.document_counts(bound, documents), True, most)) for most in (1, 10, 60, 61, 100)}
    assert {most: read(rank.top_document_counts(bound, documents, most)) for most in want} == want
    monkeypatch.setattr(rank, "document_counts", None)  # the full count is not needed
    assert read(rank.top_document_counts(bound, documents, 10)) == want[10]


def test_predictions_score_pairs_once_and_make_no_pairs_of_suppliers(spark, sf_dir, monkeypatch):
    from plexus.catalog import lookup

    calls = []
    monkeypatch.setattr(lookup, "scores", lambda *a, old=lookup.scores: calls.append(1) or old(*a))
    lookup.i1e(spark, sf_dir)
    assert len(calls) == 1


def test_a_supplier_alone_in_its_nation_does_not_reach_it(spark, tmp_path):
    from plexus.catalog import lookup

    put = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    put([(1, 1, 1.0), (2, 1, 1.0), (3, 2, 1.0)], "s_suppkey long, s_nationkey int, s_acctbal double", "supplier")
    put([], "c_custkey long, c_nationkey int, c_acctbal double", "customer")
    put([(1, 7, s, 50.0 + s) for s in (1, 3)] + [(2, 8, s, 60.0) for s in (1, 2)] + [(3, 9, 3, 90.0)],
        "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double", "lineitem")
    out = lookup.scores(spark, str(tmp_path), lookup.supplies(spark, str(tmp_path)))
    assert sorted(map(tuple, out.collect())) == [("S:1", "N:1", 0.3), ("S:1", "N:2", 0.255), ("S:2", "N:1", 0.3), ("S:3", "N:1", 0.265)]


def test_supported_edges_look_through_small_graphs_in_one_task(spark, monkeypatch):
    rng = random.Random(11)
    links = [(f"x{g}", f"n{rng.randrange(9)}", f"n{rng.randrange(9)}", rng.choice([None, 0.5, float("inf")])) for g in range(30) for _ in range(rng.randrange(1, 14))]
    asked = [(f"e{i}", f"x{rng.randrange(34)}", f"n{rng.randrange(9)}", f"n{rng.randrange(9)}") for i in range(80)] + [("lone", None, "n1", "n2")]
    aux, support = spark.createDataFrame(links, "aux_id string, subject string, object string, ngd double"), spark.createDataFrame(asked, "edge_id string, aux_id string, from_id string, to_id string")
    near = {}
    for g, a, b, w in links:
        group = near.setdefault(g, {})
        if w != float("inf"):
            one = group.get(a, {a}) | group.get(b, {b})
            for x in one:
                group[x] = one
    want = {e for e, g, a, b in asked if g and (g not in near or a == b or b in near[g].get(a, {a}))}
    assert 0 < len(want) < 80
    monkeypatch.setattr(paths, "LOCAL", 6)  # some graphs by joins
    assert {r["edge_id"] for r in paths.supported(support, aux).collect()} == want
    monkeypatch.setattr(paths, "LOCAL", 250_000)
    monkeypatch.setattr(paths, "components", None)  # no search over tables
    assert {r["edge_id"] for r in paths.supported(support, aux).collect()} == want


def test_labels_and_orphans_hold_bounded_rows(spark, monkeypatch):
    from plexus.etl import canonical

    nodes = spark.createDataFrame([(f"n{i % 90}", [("a", "b")[i % 2], "c"]) for i in range(100)], "id string, categories array<string>")
    tree = spark.createDataFrame([("a", "top"), ("b", "top"), ("a", "a"), ("c", "c")], "child string, ancestor string")
    monkeypatch.setattr(canonical, "HELD", 10, raising=False)
    out = canonical.labels(nodes, tree)
    assert out.rdd.getNumPartitions() == 11
    assert {(r["label"], r["n"]) for r in canonical.category_counts(nodes, tree).collect()} == {("top", 90), ("c", 90), ("a", 45)}
    edges = spark.createDataFrame([("n1", "n2"), ("n1", "n3")], "subject string, object string")
    kept = filters.remove_orphans(PropertyGraph(nodes, edges), keep=nodes.where("id = 'n89'")).nodes
    assert sorted(r["id"] for r in kept.collect()) == ["n1", "n1", "n2", "n2", "n3", "n3", "n89"]
    assert "Aggregate" not in kept._jdf.queryExecution().optimizedPlan().toString()


def test_neighbour_counts_hold_bounded_rows(spark, monkeypatch):
    from plexus.etl import canonical

    monkeypatch.setattr(canonical, "HELD", 10, raising=False)
    nodes = spark.createDataFrame([(f"n{i}", ["a"]) for i in range(40)], "id string, categories array<string>")
    tree = spark.createDataFrame([("a", "top"), ("a", "a")], "child string, ancestor string")
    edges = spark.createDataFrame([("n0", f"n{i}") for i in range(1, 40)] + [("n1", "n0")], "subject string, object string")
    out = canonical.neighbour_counts(nodes, edges, tree)
    assert {tuple(r) for r in out.collect()} == {("n0", k, 39) for k in ("a", "top")} | {(f"n{i}", k, 1) for i in range(1, 40) for k in ("a", "top")}
    assert out.rdd.getNumPartitions() == 9
