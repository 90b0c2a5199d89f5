"""The corpus operators against brute force, and their defined cases."""

from __future__ import annotations

import json
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from plexus.llm import common, decontaminate, jaccard, kernel, licenses, mix, quotes, registry, resample, rules, shard, tokens, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns whose names the operators use inside or in their results.
CLASH = "size long, shard long, n_words long, kept boolean, id string, w string, component_id long, passes string, slot long"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def documents(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or ["a"] * len(texts))[i], len(t or ""), *[None] * 9) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, f"{DOCS}, {CLASH}")


def corpus(seed=5, n=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 120))) for _ in range(n)]
    for i in range(0, n - 20, 4):  # near copies of several distances
        words = texts[i].split(" ")
        for _ in range(i // 12):
            words[rng.randrange(len(words))] = "edit"
        texts[n - 20 + i // 4] = " ".join(words).upper() if i % 8 else " ".join(words)
    return [*texts, None, "", " \t\n", "one", "one", "One two", "a b c", "a b c d", texts[0], texts[0]]


def sets(text, n):
    w = WORD.findall(lower(text))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def classes(texts, n, percent):
    s = [sets(t, n) for t in texts]
    up = list(range(len(texts)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(s)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= percent * len(s[i] | s[j]):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return {i: (len(x), find(i)) for i, x in enumerate(s)}


@pytest.mark.parametrize(("n", "percent", "block"), [(4, 85, 1024), (5, 80, 4), (2, 60, 3)])
def test_jaccard_classes(spark, monkeypatch, n, percent, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    texts = corpus()
    out = jaccard.jaccard_classes(documents(spark, texts), n, percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == classes(texts, n, percent)


def test_prefix_tree_finds_every_class():
    rng = random.Random(1)
    for _ in range(40):
        base = [rng.sample(range(60), rng.randint(1, 30)) for _ in range(4)]
        some = [np.array(sorted({*rng.choice(base)} ^ {*rng.sample(range(60), rng.randint(0, 4))} or {0}), np.uint64) for _ in range(14)]
        for side in ([0] * 14, [i % 2 for i in range(14)]):
            links = jaccard.group_links(list(range(14)), side, some, 70)
            up = list(range(14))
            find = lambda i, up=up: i if up[i] == i else find(up[i])
            for a, b in links:
                up[max(find(a), find(b))] = min(find(a), find(b))
            want = list(range(14))
            root = lambda i, want=want: i if want[i] == i else root(want[i])
            for i in range(14):
                for j in range(i):
                    x, y = {*some[i].tolist()}, {*some[j].tolist()}
                    if 100 * len(x & y) >= 70 * len(x | y) and (len(set(side)) == 1 or side[i] != side[j]):
                        want[max(root(i), root(j))] = min(root(i), root(j))
            assert [find(i) for i in range(14)] == [root(i) for i in range(14)]


def row_groups(rows, n, percent):
    """Brute force over ``(doc_id, text)`` rows: the classes of rows, and of documents (rows that share an id are one)."""
    kinds = classes([t for _, t in rows], n, percent)
    row_class = [kinds[i][1] for i in range(len(rows))]
    up = {i: i for i in range(len(rows))}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    first = {}
    for i, (doc, _) in enumerate(rows):
        for j in (row_class[i], i if doc is None else first.setdefault(doc, i)):
            a, b = sorted((find(i), find(j)))
            up[b] = a
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return row_class, [(doc, kinds[i][0], least.get(find(i))) for i, (doc, _) in enumerate(rows)]


def edited(text, k, rng):
    w = text.split(" ")
    for _ in range(k):
        w[rng.randrange(len(w))] = f"e{rng.randrange(1000)}"
    return " ".join(w)


def repeated_rows():
    rng = random.Random(9)
    a, b, c = (" ".join(f"{k}{rng.randrange(90)}" for _ in range(120)) for k in "abc")
    return [
        (1, a), (3, a), (3, b), (7, b), (5, edited(b, 1, rng)), (None, edited(c, 1, rng)), (9, c), (None, None), (None, ""), (11, None), (11, c), (12, ""), (12, ""),
        (4, "the same words in every one of these rows"), (4, "the same words in every one of these rows"), (None, "alone here with words"), (None, "alone here with words"),
        (20, "x " * 30_000), (21, "x " * 29_000), (22, " ".join(map(str, range(40_000)))), (23, " ".join(map(str, range(1, 40_001)))), (24, "short one"), (24, "other text entirely"),
    ]


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_repeated_ids_and_null_ids_in_jaccard(spark, n, percent):
    rows = repeated_rows()
    names = "n long, rep long, cls long, node long, cluster long, block long, first string, sig long"  # names used inside
    df = spark.createDataFrame([(*r, *[None] * 8) for r in rows], f"doc_id long, text string, {names}")
    out = Counter(tuple(r) for r in jaccard.jaccard_classes(df, n, percent).collect())
    row_class, want = row_groups(rows, n, percent)
    assert out == Counter(want)
    assert jaccard.jaccard_classes(df.limit(0)).count() == 0
    kept = jaccard.distinct_rows(df, n, percent)
    assert kept.columns == df.columns and jaccard.distinct_rows(df.limit(0)).count() == 0
    best = {}
    for i, (doc, text) in enumerate(rows):
        if sets(text, n):
            best.setdefault(row_class[i], []).append((doc is None, doc or 0, i))
    stay = [rows[min(v)[2]] for v in best.values()] + [r for r in rows if not sets(r[1], n)]
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in kept.collect()))) == sorted(map(str, stay))


def test_patterned_words_hash_apart():
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    (_, _, block), = kernel.blocks(pa.array([f"{a} {b}"]))
    assert len(set(block.word_hashes().tolist())) == 2


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(30)] + [(None, 1), (5, 5)]
    up = list(range(200))
    find = lambda i: i if up[i] == i else find(up[i])
    for a, b in edges:
        if a is not None:
            up[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for a, b in edges if a is not None and a != b for i in (a, b)}


def test_decontamination(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    items = [" ".join(rng.choice(words) for _ in range(k)) for k in (5, 9, 14, 30, 59, 3)] + [None, ""]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 200))) for _ in range(30)]
    for i, item in enumerate(items[:6]):
        texts[i] = f"{texts[i]} {item.upper()} {texts[i + 1]}"
        part = item.split(" ")
        texts[i + 8] += " " + " ".join(part[: max(1, len(part) * 9 // 10)])
    texts += [items[5], None, "", " ".join(words * 30)]
    got = {(r["doc_id"], r["item_id"]): (r["n_shingles"], r["shared"]) for r in decontaminate.leaks(
        documents(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    want = {}
    for i, t in enumerate(texts):
        for j, item in enumerate(items):
            a, b = sets(t, 5), sets(item, 5)
            if b and 100 * len(a & b) >= 80 * len(b):
                want[i, j] = (len(b), len(a & b))
    assert want and got == want
    kept = decontaminate.clean(documents(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    assert {r["doc_id"] for r in kept.collect()} == set(range(len(texts))) - {i for i, _ in want}
    assert kept.columns == documents(spark, texts).columns
    assert decontaminate.leaks(documents(spark, texts), spark.createDataFrame([], "item_id long, text string")).count() == 0


def fill(sizes, weights, budget, cap):
    total, fixed = budget * sum(sizes), set()
    while True:
        left = total - sum(cap * sizes[i] for i in fixed)
        level = left / (sum(w for i, w in enumerate(weights) if i not in fixed) or 1)
        out = [cap * s if i in fixed else level * weights[i] for i, s in enumerate(sizes)]
        over = {i for i in range(len(sizes)) if i not in fixed and out[i] > cap * sizes[i] + 1e-9}
        if not over:
            return out
        fixed |= over


@pytest.mark.parametrize("floor", [0.0, 1.0])
def test_mix_meets_targets(spark, floor):
    rng = random.Random(4)
    names = ["b", "a", "é", "hot", None]
    sources = [rng.choice(names + ["hot"] * 4) for _ in range(300)]
    texts = [" ".join("x" * rng.randint(1, 3) for _ in range(rng.choice([0, 3, 30, 200]))) for _ in sources]
    texts[3] = None
    docs = documents(spark, texts, sources)
    out = [r.asDict() for r in mix.mix(docs, floor=floor).collect()]
    assert len(out) == 300 and out and sorted(map(str, out)) == sorted(map(str, [r.asDict() for r in mix.mix(docs, floor=floor).collect()]))
    size = Counter()
    for t, s in zip(texts, sources, strict=True):
        size[s] += len(WORD.findall(t or ""))
    order = sorted((s for s in size if s), key=lambda s: s.encode()) + [None]
    more = fill([size[s] for s in order], [(3, 1, 2)[i % 3] for i in range(len(order))], 1.5 - floor, 2 - floor)
    want = {s: floor * size[s] + m for s, m in zip(order, more, strict=True)}
    taken = Counter()
    for r in out:
        assert r["size"] == len(WORD.findall(texts[r["doc_id"]] or "")) and r["source_size"] == size[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == sum(p["words"] for p in r["passes"])
        assert all(0 <= p["position"] <= 1 for p in r["passes"])
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    assert mix.mix(docs.limit(0)).count() == 0


def test_positions_invert_the_schedules(spark):
    for knots in mix.SCHEDULES:
        df = spark.range(0, 101).select((mix.F.col("id") / 100).alias("part"))
        total = sum((t2 - t1) * (y1 + y2) / 2 for (t1, y1), (t2, y2) in zip(knots, knots[1:]))
        for r in df.select("part", mix.position(df["part"], knots).alias("t")).collect():
            got = 0.0
            for (t1, y1), (t2, y2) in zip(knots, knots[1:]):
                end = min(max(r["t"], t1), t2)
                y = y1 + (y2 - y1) * (end - t1) / (t2 - t1)
                got += (end - t1) * (y1 + y) / 2
            assert got / total == pytest.approx(r["part"], abs=1e-9)


def brute_rules(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {i + k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(8)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def quality_corpus():
    rng = random.Random(6)
    good = [" ".join(rng.choice("the of and stone river light house water over under".split()) for _ in range(40)) for _ in range(60)]
    bad = [" ".join(rng.choice("THE OF AND BUY NOW".split()) + rng.choice(["!!", "$$$", "%%%"]) for _ in range(40)) for _ in range(60)]
    odd = ["x y\nx y\n\n x y\nz", "a b c d e f g h a b c d e f g h i", None, "", "é\xa0ß  |<>\r\nq\r\nq\r\n", "word " * 5000, "\n\n \n"]
    return good + bad + odd, [(i, int(i < 60), 0) for i in range(0, 120, 2)]


def test_quality_rules(spark):
    texts, labels = quality_corpus()
    lab = spark.createDataFrame([*labels, (1, None, None), (3, 0, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in rules.quality(documents(spark, texts), lab).collect()}
    assert len(out) == len(texts)
    for i, t in enumerate(texts):
        r = out[i]
        n, chars, symbols, lines, repeats = brute_rules(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, lines, repeats)
        assert r["base_failed"] == (n < 20 or 100 * repeats > 30 * n)
        assert not (r["base_failed"] and r["kept"])
    fresh = range(1, 120, 2)  # held out
    right = sum((out[i]["probability"] >= 0.5) == (i < 60) for i in fresh)
    assert right >= 0.95 * len(fresh)
    bare = rules.quality(documents(spark, texts[:3]), lab.limit(0)).collect()
    assert all(r["kept"] and r["probability"] is None for r in bare)


def test_resampling_keeps_the_target_side(spark):
    texts, labels = quality_corpus()
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in resample.resample(documents(spark, texts), lab).collect()}
    assert len(out) == len(texts)
    fresh = range(1, 120, 2)
    assert sum(out[i]["kept"] == (i < 60) for i in fresh) >= 0.95 * len(fresh)
    assert out[122]["log_weight"] is None and not out[122]["kept"] and not out[123]["kept"]
    kept = sorted((r["gumbel_key"] for r in out.values() if r["kept"]), reverse=True)
    lost = [r["gumbel_key"] for r in out.values() if not r["kept"] and r["gumbel_key"] is not None]
    assert min(kept) >= max(lost)  # top-k by key
    assert resample.resample(documents(spark, texts).limit(0), lab).count() == 0
    assert resample.select(documents(spark, texts), lab).columns == documents(spark, texts).columns


def test_shards(spark):
    texts = corpus()
    df = documents(spark, texts)
    df = df.union(df.where("doc_id = 3")).union(df.where("doc_id = 4").withColumn("doc_id", shard.F.lit(None).cast("long")))
    out = shard.sharded(df).collect()
    assert len(out) == len(texts) + 2
    slots = defaultdict(list)
    for r in out:
        t = texts[4 if r["doc_id"] is None else r["doc_id"]] or ""
        assert (r["size"], r["text_crc32"]) == (len(t.encode()) + 8, zlib.crc32(t.encode()))
        assert r["grown_shard"] in (r["shard"], shard.SHARDS) and 0 <= r["shard"] < shard.SHARDS
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    many = spark.range(40_000)
    counts = [r["count"] for r in shard.assign_shards(many, "id", [1.0] * 24).groupBy("shard").count().collect()]
    assert len(counts) == 24 and max(counts) < 1.15 * min(counts)
    heavy = {r["shard"]: r["count"] for r in shard.assign_shards(many, "id", [3.0, 1.0]).groupBy("shard").count().collect()}
    assert 2.8 < heavy[0] / heavy[1] < 3.2


def test_token_files_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    path = os.environ.get("TOKENIZER", None) or tokens.default_tokenizer()
    rng = random.Random(7)
    alphabet = "aA1 \t\n\r\x0b\x0c'sΣσİßé́ \xa0　|<>%endoftext'l日ǰJ̌KȘ\x1c\x85.,,!"
    texts = corpus() + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    texts += ["a<|endoftext|>b <|STARTOFTEXT|> <|startoftext|>", "é, É. ÷. ×! it's. IT'", "J̌ H̱, T̈", "long " * 20000]
    df = documents(spark, texts)
    tokenizer, want, at = Tokenizer.from_file(path), {}, 0
    for i, t in enumerate(texts):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        want[i], at = (at, len(ids), ids), at + len(ids)
    for encoding in ("dictionary", "delta"):
        where = str(tmp_path / encoding)
        tokens.write_tokens(df, where, path, encoding)
        got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids"]) for r in tokens.read_tokens(spark, where).collect()}
        assert got == want
    small = tokens.read_tokens(spark, where, ())
    assert "ids" not in small._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
    with pytest.raises(ValueError):
        tokens.write_tokens(df, str(tmp_path / "x"), path, "other")
    tokens.write_tokens(df.limit(0), str(tmp_path / "none"), path)
    assert tokens.read_tokens(spark, str(tmp_path / "none")).count() == 0


def test_quotes(spark):
    rows = [
        (1, 0, "user", "Hello there\nhow are you?"), (1, 1, "assistant", "> Hello there\nFine, thanks"),
        (1, 2, "user", "On Monday Bob wrote:\n> Fine,   thanks\n>> hello there\nGood\n> unknown"), (1, 3, "user", "new topic with\nenough words in it"),
        (1, 4, "assistant", "> how are you?\nok"), (2, 0, "user", "> New topic\n> with enough words in it\nyes"), (2, 1, "user", "> Fine, thanks\nshort ones stay at home"), (None, None, None, None), (1, 3, "user", "another at 3"), (5, 0, "user", ""),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("place", quotes.F.lit(9))
    got = {(r["conv_id"], r["turn"], r["content"]): r for r in quotes.conversations(df).collect()}
    assert len(got) == len(rows)
    r = got[1, 2, "Good"]
    assert (r["parent_conv"], r["parent_turn"], r["n_quoted"], r["linked"]) == (1, 1, 3, 2)
    assert got[1, 4, "ok"]["parent_turn"] == 0
    r = got[2, 0, "yes"]  # wrapped anew
    assert (r["parent_conv"], r["parent_turn"], r["linked"]) == (1, 3, 2)
    assert got[2, 1, "short ones stay at home"]["parent_conv"] is None
    order = [k[1] for k in sorted((k for k in got if k[0] == 1), key=lambda k: got[k]["place"])]
    assert order == [0, 1, 2, 4, 3, 3]
    chats = {(r["conv_id"], r["segment"]): r for r in quotes.formatted(df, segment=4).collect()}
    assert chats[1, 0]["n_messages"] == 4 and chats[1, 1]["n_messages"] == 2
    assert json.loads(chats[1, 0]["parents"])[0] == {"place": 1, "parent_conv": 1, "parent_turn": 0}
    assert [m.get("content") for m in json.loads(chats[1, 0]["chat"])] == ["Hello there\nhow are you?", "Fine, thanks", "Good", "ok"]
    assert quotes.formatted(df.limit(0)).count() == 0


def test_licenses(spark):
    texts = [
        "intro\nReleased under the MIT License.\nmore", "Licensed under the Apache License, Version 2.0.\nLicensed under CC BY-NC 4.0.",
        "This work is licensed under the GNU General Public License, version 3.", "The license plate of the car was lost.",
        "He studied at MIT and liked the apache helicopter.", None, "", "All rights reserved.", "Code is available under the BSD 2-Clause License",
    ] + corpus()[:20]
    out = defaultdict(set)
    for r in licenses.scan(documents(spark, texts)).collect():
        out[r["doc_id"]].add(r["family"])
        assert r["probability"] >= licenses.CERTAIN and r["similarity"] >= licenses.CONFIRM
    assert out == {0: {"mit"}, 1: {"apache", "cc-by-nc"}, 2: {"gpl"}, 8: {"bsd"}}
    assert licenses.scan(documents(spark, texts).limit(0)).count() == 0


def test_licenses_by_short_names_ids_and_body_paragraphs(spark):
    import textwrap

    short = [
        ("SPDX-License-Identifier: MIT", "mit"), ("License: MIT", "mit"), ("Released under the MIT.", "mit"), ("This file is under the GNU General Public License.", "gpl"),
        ("BSD license", "bsd"), ("Licensed under Apache 2.0", "apache"), ("CC BY 3.0 licensed", "cc-by"), ("Licensed under GPLv3", "gpl"), ("Licensed under LGPLv2.1", "lgpl"),
        ("SPDX-License-Identifier: AGPL-3.0-or-later", "agpl"), ("Licensed under CC BY-NC-SA 3.0.", "cc-by-nc-sa"),
    ]
    bodies = [(body, family) for family, paragraphs in licenses.BODIES.items() for body in paragraphs]
    wrapped = [(textwrap.fill(body, 70, initial_indent=" * ", subsequent_indent=" * "), family) for body, family in bodies]
    none = ["Das Haus mit Garten.", "He studied at MIT.", "Released under the name of the band."]
    mit = "MIT License\n\n" + "\n\n".join(textwrap.fill(body, 70) for body in licenses.BODIES["mit"])
    statements = [*short, *bodies, *wrapped]
    texts = [text for text, _ in statements] + none + ["some words\n#\n" + statements[0][0] + "\n", mit] + corpus()[:20]
    out = defaultdict(dict)
    for r in licenses.scan(documents(spark, texts)).collect():
        out[r["doc_id"]][r["family"]] = r["n_paragraphs"]
    n = len(statements)
    assert {i: set(out[i]) for i in range(n)} == {i: {family} for i, (_, family) in enumerate(statements)}
    assert not any(i in out for i in range(n, n + len(none)))
    assert out[n + len(none)] == {"mit": 1} and out[n + len(none) + 1] == {"mit": 4}


def brute_rule(host, path):
    fits = [(len(h + p), v, h + p) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_relative_and_escaped_links(spark):
    import html
    from urllib.parse import urljoin

    bases = ["http://h.info/a/b/page.html?x=1#f", "http://h.info/a/b/", "http://h.info"]
    links = ["next.html", "../x", "../../../x/./y", "./", "..", ".", "?id=3", "?a=1&amp;b=2", "sub/q?u=/../v", "/r/../s/.", "#top", "//o.info/p", "https://o.info/?a=1&#38;b=2",
             "caf&#xe9;", "&amp;amp;x", "a&#x26;#38;x", "x&lt;&gt;&quot;&apos;", "&#128512;", "&#0;", "&", " padded "]
    rows = [(b, x) for b in bases for x in links]
    df = spark.createDataFrame(rows, "base string, link string").withColumn("plain", urls.unescaped(urls.F.col("link")))
    df = df.withColumn("full", urls.resolved(urls.F.col("base"), urls.F.col("plain")))
    for r in df.collect():
        want = urljoin(r["base"], html.unescape(r["link"]).strip())
        if r["link"] == "?id=3" or r["link"].startswith("?a"):
            want = r["base"].split("?")[0].split("#")[0] + html.unescape(r["link"])
        assert r["full"].split("#")[0].split("://")[1] == want.split("#")[0].split("://")[1], (r["base"], r["link"])
    none = spark.createDataFrame([("mailto:a@b.c",), ("javascript:void(0)",)], "link string")
    assert none.select(urls.resolved(urls.F.lit("http://h.info/"), urls.F.col("link")).alias("x")).where("x is not null").count() == 0
    pages = [
        (1, "http://a.example.com/de/x", '<link rel=canonical href="http://m.info/d/p?a=1&amp;b=2">'), (2, "http://m.info/d/p?a=1&b=2", None),
        (3, "http://m.info/d/q", '<link rel="canonical" href="p?a=1&#38;b=2">'), (4, "http://m.info/d/e/r", '<meta http-equiv="refresh" content="0; url=../q">'),
        (5, "http://m.info/d/q?id=3", '<meta property="og:url" content="?id=4">'), (6, "http://m.info/d/q?id=4", '<link rel="canonical" href="./z/../q">'),
        (7, "http://other.info/", '<base href="http://m.info/d/e/"><link rel="canonical" href="r">'), (8, "http://m.info/q", '<link rel="canonical" href="s">'), (9, "http://other.info/r", None),
    ]
    out = urls.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["verdict"] for r in out} == {**dict.fromkeys(range(1, 8), "block"), 8: "allow", 9: "allow"}


def test_url_filters(spark):
    canonical = '<html><link href="{}" rel=canonical>'
    pages = [
        (1, "http://a.example.com/de/x?q", '<link rel="canonical" href="https://mirror.info/m">'), (2, "https://MIRROR.info/m#top", None),
        (3, "http://b.org/fr/ok", '<meta http-equiv="refresh" content="0; URL=http://mirror.info/m">'), (4, "http://c.info/", '<meta property="og:url" content="//mirror.info/m">'),
        (5, None, canonical), (6, "no scheme", None), (7, "http://example.net/en/page", None), (8, "http://net", None), (9, "ftp://sub.net:8080/x", None), (10, "http://net/", None),
        (11, "http://clean.info/y", '<link rel="canonical" href="/y2">'), (11, "http://clean.info/y2", None),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("rule", urls.F.lit("x")).withColumn("node", urls.F.lit("x"))
    out = {(r["page_id"], r["path"]): r for r in urls.judge(df).collect()}
    assert len(out) == len(pages)
    verdicts = {k[0]: r["verdict"] for k, r in out.items()}
    assert verdicts == {1: "block", 2: "block", 3: "allow", 4: "block", 5: "allow", 6: "allow", 7: "allow", 8: "allow", 9: "allow", 10: "block", 11: "allow"}
    for r in out.values():
        own, rule = brute_rule(r["host"], r["path"])
        assert r["rule"] == rule and (own is None or own == r["verdict"])
    table = spark.createDataFrame(list(urls.RULES), "verdict string, host string, path string")
    assert {(r["page_id"], r["path"]): (r["rule"], r["verdict"]) for r in urls.judge(df, table).collect()} == {k: (r["rule"], r["verdict"]) for k, r in out.items()}
    more = spark.createDataFrame([("http://net/", "http://clean.info/y")], "source string, target string")
    assert {r["verdict"] for r in urls.judge(df, redirects=more).collect() if r["page_id"] == 11} == {"block"}
    assert urls.judge(df.limit(0)).count() == 0


def test_equal_words_hash_alike_anywhere():
    texts = pa.array(["Hello wörld", None, "", "x hello", "wörld\thello\n"])
    seen = defaultdict(set)
    for limit in (1, 8, 1 << 20):
        for lo, _, b in kernel.blocks(texts, limit, lower=True):
            for h, d, s, e in zip(b.word_hashes(), b.wdoc, b.ws, b.we, strict=True):
                seen[b.buf[s:e].tobytes()].add(int(h))
                assert texts[lo + int(d)].as_py()
    assert len(seen) == 3 and all(len(h) == 1 for h in seen.values())


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_queries_against_sql(spark, name):
    import duckdb

    sf_dir = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations"):
        path = f"{sf_dir}/{t}.parquet"
        duck.execute(f"create view {t} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    frame = registry.QUERIES[name](spark, sf_dir)
    columns = sorted(frame.columns)
    mine = Counter(tuple(map(str, r)) for r in frame.select(*columns).collect())
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert mine == Counter(tuple(map(str, r)) for r in duck.sql(f"select {quoted} from ({registry.ORACLES[name]})").fetchall())


def test_quotes_against_sql(spark):
    import duckdb
    import pandas as pd

    rng, rows = random.Random(8), []
    for conv in range(6):
        said, paragraphs = [], [["nothing"]]
        for turn in range(7):
            lines = [rng.choice([f"line {rng.randrange(30)} of {rng.randrange(3)}", f"yes {rng.randrange(4)}", ""]) for _ in range(rng.randint(0, 4))]
            if said and rng.random() < 0.7:
                quoted = [f"{'>' * rng.randint(1, 2)} {rng.choice(said).upper()}" for _ in range(rng.randint(1, 3))]
                w = " ".join(rng.choice(paragraphs)).split(" ")  # a paragraph, wrapped anew
                cut = rng.randint(1, len(w))
                quoted += [">", f"> {' '.join(w[:cut])}", f">  {' '.join(w[cut:])}"]
                lines = ["On Friday someone wrote:", *quoted, *lines, "> nobody said this"]
            said += [x for x in lines if x and not x.startswith((">", "On "))]
            own = [x for x in lines if not x.startswith((">", "On "))]
            paragraphs += [p.split("\n") for p in "\n".join(own).split("\n\n") if p.strip("\n")]
            rows.append((conv, turn, "user" if turn % 2 else "assistant", "\n".join(lines)))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = quotes.formatted(df)
    columns = sorted(out.columns)
    duck = duckdb.connect()
    duck.register("conversations", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]))
    mine = Counter(tuple(map(str, r)) for r in out.select(*columns).collect())
    assert sum(int(r[columns.index("n_linked")]) for r in mine) > 10
    theirs = duck.sql(f"select {', '.join(columns)} from ({registry.ORACLES['op8_quotation_linking']})").fetchall()
    assert mine == Counter(tuple(map(str, r)) for r in theirs)
