"""Chunked bitmaps against sets."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest

from plexus.functions import bitmaps as B
from plexus.operators import overlay


def test_containers_of_all_kinds():
    rng = np.random.default_rng(1)
    sets = [np.sort(rng.choice(1 << 16, n, replace=False)) for n in (0, 1, 50, 4095, 4096, 20_000, 1 << 16)]
    for low in sets:
        assert B.unpacked(B.packed(low)).tolist() == low.tolist() and B.size(B.packed(low)) == len(low)
        assert len(B.packed(low)) <= B.BYTES
    for a, b in itertools.product(sets, repeat=2):
        assert B.unpacked(B.both(B.packed(a), B.packed(b))).tolist() == np.intersect1d(a, b).tolist()


def test_shared_documents_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(B, "BITS", 6)  # many chunks
    rng = random.Random(2)
    docs = {c: {f"d{rng.randrange(600):03}" for _ in range(n)} for c, n in {"a": 500, "b": 300, "c": 40, "d": 5, "e": 1}.items()}
    rows = [(c, x) for c in docs for x in docs[c]] * 2 + [(None, "d001"), ("a", None)]
    index = spark.createDataFrame(rows, "concept string, doc string")
    pairs = spark.createDataFrame([*itertools.combinations("abcdef", 2), ("a", "b"), ("a", "a")], "subject string, object string")
    maps, names = B.bitmaps(index)
    number = {r["doc"]: r["number"] for r in names.collect()}
    assert sorted(number, key=number.get) == sorted(set.union(*docs.values()))
    got = {(r["subject"], r["object"]): (r["n"], r["firsts"]) for r in B.shared(maps, pairs.distinct(), 7).collect()}
    docs["f"] = set()
    want = {(x, y): docs[x] & docs[y] for x, y in [*itertools.combinations("abcdef", 2), ("a", "a")]}
    assert got == {k: (len(v), sorted(number[x] for x in v)[:7]) for k, v in want.items() if v}
    out = {(r["subject"], r["object"]): r for r in overlay.ngd(index, pairs, n=1e6, keep_docs=5).collect()}
    for (x, y), v in want.items():
        fx, fy = len(docs[x]), len(docs[y])
        value = (max(math.log(fx), math.log(fy)) - math.log(len(v))) / (math.log(1e6) - min(math.log(fx), math.log(fy))) if v else math.inf
        assert out[x, y]["ngd"] == pytest.approx(value) and (out[x, y]["docs"] or []) == sorted(v)[:5]


def test_distance_of_many_concepts(spark):
    rng = random.Random(3)
    docs = {c: set(rng.sample(range(400), n)) for c, n in {"a": 350, "b": 300, "c": 250, "d": 200}.items()}
    index = spark.createDataFrame([(c, x) for c in docs for x in docs[c]], "concept string, doc long")
    groups = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "a"), (2, "b"), (2, "c"), (2, "d"), (3, "a"), (3, "unknown"), (4, "d")], "group_id long, concept string")
    out = {r["group_id"]: r["ngd"] for r in overlay.multi_ngd(index, groups, n=1e6).collect()}
    for g, members in ((1, "ab"), (2, "abcd"), (4, "d")):
        f = [len(docs[c]) for c in members]
        shared = len(set.intersection(*[docs[c] for c in members]))
        assert out[g] == pytest.approx((math.log(max(f)) - math.log(shared)) / (math.log(1e6) - math.log(min(f))))
    assert out[3] is None and set(out) == {1, 2, 3, 4}
    assert overlay.multi_ngd(index.limit(0), groups).where("ngd is not null").count() == 0


def test_first_documents_of_a_concept(spark):
    index = spark.createDataFrame([("a", x) for x in range(50)] * 2 + [("b", 3), ("c", 9)], "concept string, doc long")
    ids = spark.createDataFrame([("a",), ("b",), ("z",)], "concept string")
    assert {r["concept"]: r["docs"] for r in overlay.node_docs(index, ids, 4).collect()} == {"a": [0, 1, 2, 3], "b": [3]}
    assert len(overlay.node_docs(index, ids, None).where("concept = 'a'").first()["docs"]) == 50
