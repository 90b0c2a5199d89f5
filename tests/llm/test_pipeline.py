"""Each stage of the corpus pipeline against brute force over its own input."""

from __future__ import annotations

import random
from collections import Counter

import corpus_pipeline
from plexus.llm import common, mix, resample, shard
from tests.llm.test_corpus import classes, corpus, documents, sets


def folder(spark, tmp_path, docs, labels=(), items=()):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_stages_work_on_what_is_left(spark, tmp_path):
    texts = corpus()
    docs = documents(spark, texts)
    items = [(0, " ".join(texts[2].split(" ")[:9])), (1, "never seen anywhere in any of these texts at all")]
    where = folder(spark, tmp_path, docs, [(i, 1, 0) for i in range(0, 30)], items)
    stages = dict(corpus_pipeline.STAGES)
    first = stages["quality classifier"](spark, docs, where)
    rejected = {r["doc_id"] for r in resample.resample(docs, spark.read.parquet(f"{where}/labels.parquet")).where("not kept").collect()}
    assert rejected >= {i for i, t in enumerate(texts) if not t}
    assert {r["doc_id"] for r in first.collect()} == set(range(len(texts))) - rejected

    second = stages["n-gram jaccard join"](spark, docs, where)
    want = {i for i, (_, c) in classes(texts, 5, 80).items() if c == i}
    assert {r["doc_id"] for r in second.collect()} == want
    twice = stages["n-gram jaccard join"](spark, docs.union(docs.where("doc_id < 3")), where)
    assert sorted(r["doc_id"] for r in twice.collect()) == sorted(want)

    third = stages["benchmark decontamination"](spark, docs, where)
    leaked = {i for i, t in enumerate(texts) if any(sets(x, 5) and len(sets(t, 5) & sets(x, 5)) >= 0.8 * len(sets(x, 5)) for _, x in items)}
    assert leaked and {r["doc_id"] for r in third.collect()} == set(range(len(texts))) - leaked

    fourth = stages["mixing sources to target weights"](spark, docs, where)
    times = Counter(r["doc_id"] for r in fourth.collect())
    assert set(times) == {i for i, t in enumerate(texts) if (t or "").split()} and set(times.values()) <= {1, 2}

    last = stages["sharding"](spark, docs, where)
    assert last.count() == len(texts) and {r["shard"] for r in last.collect()} <= set(range(shard.SHARDS))
    for out in (first, second, third, fourth):
        assert out.columns == docs.columns


def test_run_and_empty_tables(spark, tmp_path):
    texts = corpus()
    where = folder(spark, tmp_path / "a", documents(spark, texts), [(i, 1, 0) for i in range(30)], [(0, "nothing")])
    out = corpus_pipeline.run(spark, where)
    assert 0 < out.count() and "shard" in out.columns
    none = folder(spark, tmp_path / "b", documents(spark, texts).limit(0))
    assert corpus_pipeline.run(spark, none).count() == 0


def odd_rows():
    """Repeated ids with different texts, repeated rows, null ids, sources and texts, very long texts."""
    rng = random.Random(12)
    text = lambda k: " ".join(f"{k}{rng.randrange(60)}" for _ in range(50))
    a, b, c, d = (text(k) for k in "abcd")
    leak = " ".join(c.split(" ")[5:25])
    rows = [
        (1, a, "s"), (2, a, "t"), (2, b, "s"), (2, b, "s"), (2, b, "t"), (3, None, "s"), (3, c, None), (None, d, "s"), (None, d, "s"), (None, text("e"), None), (None, leak, "t"),
        (4, f"{text('f')} {leak} {text('g')}", "s"), (4, text("h"), "s"), (5, "long " * 30_000, "t"), (6, "", None), (7, "one two", "s"),
    ]
    return rows, leak


def test_stages_judge_rows_one_by_one(spark, tmp_path):
    rows, leak = odd_rows()
    docs = spark.createDataFrame([(i, t, "en", s, len(t or ""), "x") for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, shard string")
    where = folder(spark, tmp_path, docs.drop("shard"), [(1, 1, 0), (2, 0, 0)], [(0, leak), (1, None), (None, rows[0][1])])
    stages = dict(corpus_pipeline.STAGES)
    got = lambda df: Counter((r["doc_id"], r["text"], r["source"]) for r in df.collect())
    all_rows = Counter(rows)

    verdict = {(r["__id"], r["__h"]): r["kept"] for r in resample.drawn(docs, spark.read.parquet(f"{where}/labels.parquet")).collect()}
    key = {(r["__id"], r["text"]): (r["__id"], r["__h"]) for r in common.keyed(docs).collect()}
    want = Counter({r: n for r, n in all_rows.items() if verdict[key[r[0], r[1]]]})
    assert got(stages["quality classifier"](spark, docs, where)) == want

    second = got(stages["n-gram jaccard join"](spark, docs, where))
    assert {(i, t) for i, t, _ in second} == {(i, t) for i, t, _ in rows} - {(2, rows[0][1])} and max(second.values()) == 1

    third = got(stages["benchmark decontamination"](spark, docs, where))
    assert third == Counter({r: n for r, n in all_rows.items() if not (r[1] and leak in r[1])})

    for floor in (1.0, 0.0):
        fourth = corpus_pipeline.mixture(spark, docs, where, floor)
        want = Counter()
        passes = mix.mix(common.keyed(docs), floor=floor, keys=("__id", "__h", "text"))
        for r in passes.collect():
            want[r["__id"], r["text"], r["source"]] += sum(2 * p["words"] >= r["size"] for p in r["passes"])
        times = got(fourth)
        assert times == +want and fourth.columns == docs.columns
        if floor:
            assert {r for r in rows if r[1] and r[1].split()} == set(times)

    last = stages["sharding"](spark, docs, where)
    own = {r["doc_id"]: r["shard"] for r in shard.assign_shards(docs.select("doc_id").distinct(), "doc_id", [1.0] * shard.SHARDS).collect()}
    assert all(r["shard"] == own[r["doc_id"]] for r in last.collect()) and got(last) == all_rows


def test_stages_with_empty_side_tables(spark, tmp_path):
    rows, _ = odd_rows()
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    where = folder(spark, tmp_path, docs)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, where)
        assert out.count() > 0 and stage(spark, docs.limit(0), where).count() == 0, name
    assert stages_keep_all(spark, docs, where)


def stages_keep_all(spark, docs, where):
    return dict(corpus_pipeline.STAGES)["benchmark decontamination"](spark, docs, where).count() == docs.count()
