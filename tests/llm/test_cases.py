"""Defined cases and plain models of the corpus operators."""

from __future__ import annotations

import math
import random
from collections import Counter

import pyarrow as pa
import pytest

from plexus.llm import decontaminate, kernel, licenses, mix, ngrams, quotes, resample, rules, shard, tokens, urls
from tests.llm.test_corpus import brute_rule, brute_rules, quality_corpus, sets

LONG = "word " * 60_000


def patterned():
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    return a, b


def test_url_classes_by_generated_links(spark):
    rng, rows = random.Random(11), []
    sites = ["a.net", "b.info", "c.example.com", "d.org", "e.info", "f.info"]
    page = lambda k: f"http://{sites[k % 6]}/{('de', 'fr', 'en')[k % 3]}/p{k}"
    tags = ('<link rel="canonical" href="{}">', '<meta property="og:url" content="{}">', '<meta http-equiv="refresh" content="3; url={}">')
    links = [(k, k + 1) for k in range(0, 40)] + [(k, 500) for k in range(100, 400)] + [(rng.randrange(600, 760), rng.randrange(600, 760)) for _ in range(80)]
    up = list(range(800))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    of = {}
    for a, b in links:
        of.setdefault(a, []).append(b)
        x, y = sorted((find(a), find(b)))
        up[y] = x
    for k in range(800):
        html = "".join(rng.choice(tags).format(page(b)) for b in of.get(k, [])) + f"<!-- {tags[0].format(page(0))} -->"
        rows.append((k, page(k), html if k % 5 else f"<head>{html}"))
    rows += [(None, page(3), None), (3, page(3), None), (801, "http://x.info/" + "y" * 50_000, "<p>" * 50_000)]
    own = {}
    for k in range(800):
        host, path = page(k)[7:].split("/", 1)
        own[k] = brute_rule(host, "/" + path)
    bad = {find(k) for k in range(800) if own[k][0] == "block"}
    out = urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(out) == len(rows)
    for r in out:
        if r["page_id"] is not None and r["page_id"] < 800:
            k = r["page_id"]
            assert r["verdict"] == (own[k][0] or ("block" if find(k) in bad else "allow")), k


def test_resampling_weights_by_a_plain_model(spark):
    texts, labels = quality_corpus()
    texts = [*texts[:40], *texts[60:90], "same same same word word", None, ""]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    lab = spark.createDataFrame([(i, int(i < 40), 0) for i in range(0, 70, 2)], "doc_id long, quality int, toxic int")
    clear = {r["doc_id"]: (r["y"], r["half"]) for r in resample.clear_labels(lab).collect()}
    good = {i for i, (y, half) in clear.items() if y == 1 and half == 0}
    raw, target, per = [Counter() for _ in resample.KINDS], [Counter() for _ in resample.KINDS], []
    for i, text in enumerate(texts):
        (_, _, b), = kernel.blocks(pa.array([text], pa.string()))
        mine = []
        for k, kind in enumerate(resample.KINDS):
            bucket, _ = ngrams.grams(b, kind, resample.BITS)
            bucket = bucket.tolist()
            if kind == ("w", 2):
                w = (text or "").split()
                bucket = [0 if x == y else max(g, 1) for g, x, y in zip(bucket, w, w[1:])]
            raw[k].update(bucket)
            target[k].update(bucket if i in good else [])
            mine.append(bucket)
        per.append(mine)
    size = 1 << resample.BITS

    def ratio(k, g):
        share = lambda g: (raw[k][g] + 1) / (raw[k].total() + size)
        return math.log((target[k][g] + 50 * share(g)) / (target[k].total() + 50)) - math.log(share(g))

    out = {r["doc_id"]: r for r in resample.resample(docs, lab).collect()}
    for i, mine in enumerate(per):
        n = sum(map(len, mine))
        want = resample.SIZE * sum(ratio(k, g) for k, bucket in enumerate(mine) for g in bucket) / n if n else None
        assert out[i]["n_grams"] == n and (out[i]["log_weight"] is None) == (want is None)
        assert want is None or out[i]["log_weight"] == pytest.approx(want, abs=1e-4)
    twice = resample.resample(docs.union(docs).union(docs.limit(1).selectExpr("cast(null as long)", "text")), lab.limit(0)).collect()
    assert len(twice) == 2 * len(texts) + 1
    assert all(len({r["gumbel_key"] for r in twice if r["doc_id"] == i}) == 1 for i in range(len(texts)))


def test_other_tokenizers_and_patterned_words(spark, tmp_path):
    import os

    from tokenizers import Tokenizer

    a, b = patterned()
    texts = [f"{a} {b} {a}", f"{b} x {b}", "Two  spaces, and a tab\there\n\nnew", None, "", "  lead", LONG]
    rows = [*((i, t) for i, t in enumerate(texts)), (None, "null id"), (3, "again"), (3, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", tokens.F.lit(7)).withColumn("ids", tokens.F.lit("x"))
    word = tokens.default_tokenizer()
    for path in (word, os.path.join(os.path.dirname(word), "byte_bpe_50k.json")):
        tokenizer = Tokenizer.from_file(path)
        assert tokens.splits_words(tokenizer) == (path == word)
        where = str(tmp_path / os.path.basename(path))
        tokens.write_tokens(df, where, path)
        got = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["start"], r["ids"]) for r in tokens.read_tokens(spark, where).collect()), key=lambda x: x[2])
        assert [x[:2] for x in got] == sorted(x[:2] for x in got)
        assert all(x[2] == sum(len(y[3]) for y in got[:i]) for i, x in enumerate(got))
        want = Counter((i, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [1])) for i, t in rows)
        assert Counter((x[1] if x[0] else None, tuple(x[3])) for x in got) == want


def test_quality_rules_cases(spark):
    texts, labels = quality_corpus()
    rows = [(i % 50, t) for i, t in enumerate(texts)] + [(None, texts[0]), (1, None), (1, LONG)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("probability", rules.F.lit("x")).withColumn("index", rules.F.lit(1))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = Counter((r["doc_id"], r["n_words"], r["n_repeat_words"]) for r in rules.quality(docs, lab).collect())
    assert out == Counter((i, brute_rules(t)[0], brute_rules(t)[4]) for i, t in rows)
    one = rules.quality(docs, lab.where("quality = 1")).collect()
    assert all(r["probability"] is None and r["kept"] == (not r["base_failed"]) for r in one)
    assert rules.quality(docs.limit(0), lab).count() == 0


def test_decontamination_cases(spark):
    item = " ".join(f"w{i}" for i in range(20))
    rows = [(1, item[: len(item) // 2]), (1, item[len(item) // 2 - 20 :]), (2, item), (2, item), (None, item), (3, f"{LONG} {item}"), (4, "w0 w1 w2"), (5, "x w0 w1 w2 y z")]
    items = [(7, item), (7, item), (None, item), (8, "w0 w1 w2"), (9, None), (10, LONG)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", decontaminate.F.lit("x")).withColumn("item_id", decontaminate.F.lit(0))
    frame = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", decontaminate.F.lit(0))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, frame).collect()}
    by_id = {}
    for i, t in rows:
        by_id[i] = by_id.get(i, set()) | sets(t, 5)
    by_id.pop(None)
    wanted = {7: sets(item, 5), 8: sets("w0 w1 w2", 5), 10: sets(LONG, 5)}
    assert got == {(d, i) for d, s in by_id.items() for i, x in wanted.items() if 100 * len(s & x) >= 80 * len(x)}
    kept = Counter((r["doc_id"], r["text"]) for r in decontaminate.clean(docs, frame).collect())
    assert kept == Counter((i, t) for i, t in rows if not any(100 * len(sets(t, 5) & x) >= 80 * len(x) for x in wanted.values()))


def test_mix_cases(spark):
    rows = [(1, "a b c", "s"), (1, "a b c", "s"), (1, "d e", None), (None, LONG, "s"), (2, None, "t"), (3, "", "u"), (4, "x", "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("target", mix.F.lit("x")).withColumn("place", mix.F.lit(1))
    out = mix.mix(docs).collect()
    assert Counter((r["doc_id"], r["size"], r["source"]) for r in out) == Counter((i, len((t or "").split()), s) for i, t, s in rows)
    taken = Counter()
    for r in out:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[r["source"]] - r["target"]) <= 1 for r in out)
    many = spark.range(3000).selectExpr("id as doc_id", "'a b c d' as text", "concat('host', id % 700) as source")
    assert abs(many.count() * 4 * 1.5 - sum(r["taken"] for r in mix.mix(many).select("taken").collect())) <= 700


def test_shard_quote_and_licence_cases(spark):
    docs = spark.createDataFrame([(1, LONG), (1, LONG), (1, "x"), (None, None), (2, "")], "doc_id long, text string").withColumn("slot", shard.F.lit(1)).withColumn("law", shard.F.lit(1))
    out = shard.sharded(docs).collect()
    assert len(out) == 5 and len({r["shard"] for r in out if r["doc_id"] == 1}) == 1
    rows = [(1, 0, "user", f"{LONG}\nsome words to be quoted here"), (1, 1, "bot", "> some words to be quoted here\n" + "> x\n" * 3000), (2, 0, None, None)]
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("level", quotes.F.lit(1)).withColumn("hash", quotes.F.lit(1))
    got = {(r["conv_id"], r["turn"]): r for r in quotes.conversations(chats).collect()}
    assert got[1, 1]["parent_turn"] is None or got[1, 1]["parent_turn"] == 0
    assert got[1, 1]["n_quoted"] == 3001 and got[2, 0]["content"] == ""
    grant = "Released under the MIT License."
    rows = [(1, grant), (1, f"{grant}\nother\n{grant}"), (None, grant), (None, grant), (2, f"{LONG} {grant}"), (3, None)]
    found = {(r["doc_id"], r["family"]): r["n_paragraphs"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1, "mit"] == 3 and found[None, "mit"] == 2 and (3, "mit") not in found
