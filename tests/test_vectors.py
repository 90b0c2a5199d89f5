"""The vector index against all pairs."""

from __future__ import annotations

import numpy as np
import pytest

from plexus.functions import vectors
from plexus.operators import infer


def brute(x, ids, asked, most, least):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in asked:
        p = infer.treat_probability(unit[ids.index(q)] @ unit.T)
        best = sorted((-v, i) for v, i in zip(p.tolist(), ids, strict=True) if i != q and v >= least)[:most]
        out[q] = [(i, pytest.approx(-v, abs=2e-6)) for v, i in best]
    return out


@pytest.mark.parametrize(("clusters", "block"), [(1, 4096), (12, 4096), (12, 7)])
def test_nearest_equals_all_pairs(spark, clusters, block):
    rng = np.random.default_rng(clusters + block)
    middle = rng.normal(size=(clusters, 8)) * (0 if clusters == 1 else 4)
    x = middle[rng.integers(clusters, size=400)] + rng.normal(size=(400, 8))
    x[50] = x[51] = x[52]  # ties
    ids = list(range(400))
    rows = [(i, v.tolist()) for i, v in zip(ids, x, strict=True)]
    df = spark.createDataFrame([*rows, (1000, [0.0] * 8), (1001, None), (None, [1.0] * 8)], "id long, vector array<double>")
    asked = [*range(0, 400, 20), 51]
    queries = df.where(df["id"].isin([*asked, 1000])).toDF("query_id", "query")
    index = vectors.Index(df, sample=200, block=block)
    got = {}
    for r in index.nearest(queries, 10, 0.5, infer.treat_probability).orderBy("query_id", "place").collect():
        got.setdefault(r["query_id"], []).append((r["id"], r["score"]))
    want = brute(x, ids, asked, 10, 0.5)
    assert {q: sorted(s for _, s in v) for q, v in got.items()} == {q: sorted((s for _, s in v), key=lambda a: a.expected) for q, v in want.items() if v}
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in asked if want[q]) >= 0.99 * sum(map(len, want.values()))


def test_clusters_save_work_and_empty_tables(spark):
    rng = np.random.default_rng(5)
    middle = rng.normal(size=(30, 16)) * 6
    x = middle[np.arange(900) % 30] + rng.normal(size=(900, 16)) * 0.3
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    index = vectors.Index(df, sample=500, cells=60)
    queries = df.where("id % 20 = 0").toDF("query_id", "query")
    asked = queries.withColumn("bar", queries["query_id"] * 0 + 0.99)
    later = index._cells(asked, False, 10, 0.5, infer.treat_probability).count()
    assert later < queries.count() * len(index.centres) / 4
    empty = vectors.Index(df.limit(0))
    assert empty.nearest(queries, 10, 0.5, infer.treat_probability).count() == 0
    assert index.nearest(queries.limit(0), 10, 0.5, infer.treat_probability).count() == 0
