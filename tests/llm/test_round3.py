"""Source divergence, SentencePiece and the conversation trie: plain models, SQL on hard tables, defined cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from plexus.functions import components as graph
from plexus.llm import divergence, jaccard, pieces, trie, urls


def test_divergence_equals_sql_with_and_without_shards(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = sorted(con.sql(divergence.ORACLES["op11_source_divergence"]).fetchall(), key=str)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert sorted(map(tuple, divergence.audit(docs).select("lang", "source", "part", "item", "value", "rank").collect()), key=str) == want
    texts = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    kept = divergence.vocabulary(texts, 3).cache()
    all_hot = sorted(map(tuple, divergence.postings(texts, kept).collect()))
    assert sorted(map(tuple, divergence.postings(texts, kept, hot=50, shard=30).collect())) == all_hot
    assert sorted(map(tuple, divergence.postings(texts, kept, hot=0, shard=100).collect())) == all_hot


def divergence_model(rows, least=3, ranks=200):
    """All zero counts written out, in plain Python."""
    import re

    docs = [tuple(x or "" for x in r) for r in rows]
    terms = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) for _, _, t in docs]
    out = []
    for lang in {d[0] for d in docs}:
        own = [(d[1], t) for d, t in zip(docs, terms, strict=True) if d[0] == lang]
        df = Counter(x for _, t in own for x in set(t))
        kept = [x for x in df if df[x] >= least]
        counts = defaultdict(Counter)
        for s, t in own:
            counts[s].update(x for x in t if df[x] >= least)
        total = Counter()
        for c in counts.values():
            total.update(c)
        share = lambda c: {x: 1 + 10**9 * (c[x] + 1) // (sum(c.values()) + len(kept)) for x in kept}
        p, q = {s: share(c) for s, c in counts.items()}, share(total)
        for s in counts:
            pair = [(-sum((p[s][x] - p[o][x]) ** 2 // p[o][x] for x in kept), o.encode(), o) for o in counts if o != s]
            term = [(-((p[s][x] - q[x]) ** 2 // q[x]), x.encode(), x) for x in kept if counts[s][x] and p[s][x] > q[x]]
            for part, items in (("pair", sorted(pair)), ("term", sorted(term)[:ranks])):
                out += [(lang, s, part, x, -v, i + 1) for i, (v, _, x) in enumerate(items)]
    return sorted(out)


def test_divergence_of_hard_texts(spark):
    rng = random.Random(3)
    vocabulary = ["a", "b", "ab", "Ä", "ä", "日本", "the", "THE", "x" * 70, "é́", "z1z"]
    rows = [(rng.choice(["en", None, "", "日"]), rng.choice(["s1", "s2", "S2", None, "é", "z"]), rng.choice(["", " ", "-"]).join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\x00", "_"]) for _ in range(rng.randrange(30)))) for _ in range(120)]
    rows += [("en", "s1", None), ("en", "s1", "word " * 60_000), ("en", "s2", "word"), ("en", "z", "word"), ("only", "one", "q w e"), ("two", "x", ""), ("two", "y", None)] + [("rep", "r", "same text")] * 5 + [("rep", "t", "other")]
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    df = df.withColumns({"value": F.lit(1), "item": F.lit("i"), "p": F.lit(2), "id": F.lit(7)})  # clashing names
    assert sorted(map(tuple, divergence.audit(df).select("lang", "source", "part", "item", "value", "rank").collect())) == divergence_model(rows)
    assert divergence.audit(df.limit(0)).count() == 0
    assert [tuple(r) for r in divergence.audit(df.where("lang = 'two'")).select("source", "part", "item", "value", "rank").orderBy("source").collect()] == [("x", "pair", "y", 0, 1), ("y", "pair", "x", 0, 1)]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())


@pytest.fixture(scope="module")
def tables():
    return pieces.read_model(pieces.default_model())


def hard_texts(rng, vocabulary, n):
    kinds = (
        lambda: "".join(rng.choice(" ab\n\t▁é日本語🙂\x00́") for _ in range(rng.randrange(60))),
        lambda: "".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x3000), rng.randrange(0x4E00, 0x9FFF), rng.randrange(0x10000, 0x1FFFF)])) for _ in range(rng.randrange(80))),
        lambda: rng.choice(["a", "ab", "the", "日", "=", " ", "-", "ha"]) * rng.randrange(1, 1500),
        lambda: "".join(rng.choice(vocabulary).replace("▁", " ") for _ in range(rng.randrange(40))),
        lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randrange(3000))),
        lambda: "".join(rng.choice("etaoin shr  <s></s>0x41") for _ in range(rng.randrange(300))),
        lambda: "",
    )
    return [rng.choice(kinds)() for _ in range(n)]


def test_pieces_equal_the_library(spark, library, tables, sf_dir):
    rng = random.Random(5)
    vocabulary = [library.id_to_piece(i) for i in range(259, library.vocab_size())]
    texts = [*hard_texts(rng, vocabulary, 300), None, "", "word " * 60_000, "x" * 30_000, "q7" * 9000, *["same text"] * 3]
    rows = [(i % 290, t) for i, t in enumerate(texts)] + [(None, "null id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"ids": F.lit(1), "n_tokens": F.lit(2)}).repartition(3)
    out = pieces.decode(pieces.encode(docs)).collect()
    want = Counter((i, tuple(ids := library.encode(t or "", add_eos=True)), library.decode(ids)) for i, t in rows)
    assert Counter((r["doc_id"], tuple(r["ids"]), r["text"]) for r in out) == want
    assert pieces.encode(docs.limit(0)).count() == 0
    got = {r["doc_id"]: r for r in pieces.op12_sentencepiece(spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = library.encode(r["text"] or "", add_eos=True)
        mine = got[r["doc_id"]]
        assert mine["n_tokens"] == len(ids)
        assert mine["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert mine["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_rounds_and_queue_merge_alike(library, tables):
    rng, encoder = random.Random(9), pieces.Encoder(tables)
    vocabulary = [library.id_to_piece(i) for i in range(259, library.vocab_size())]
    for text in hard_texts(rng, vocabulary, 150):
        points = np.array([0x2581 if c == " " else ord(c) for c in " " + text], np.uint32)
        symbols = encoder.symbol[points]
        rounds = encoder.merger.merge(symbols[: pieces.LONG].copy(), np.array([0]))
        queue = encoder.merger.queue(symbols[: pieces.LONG], 0)
        assert [x.tolist() for x in rounds] == [x.tolist() for x in queue]


def test_decoding_any_ids(spark, library, tables):
    rng, decoder = random.Random(2), pieces.Decoder(tables)
    lists = [[rng.choice([rng.randrange(0, 3), rng.randrange(3, 259), rng.randrange(259, 32000), 28705]) for _ in range(rng.randrange(12))] for _ in range(2000)]
    off = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    assert decoder.decode(np.array([i for x in lists for i in x], np.int64), off) == [library.decode(x) for x in lists]
    rows = spark.createDataFrame([(1, [2, 261]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert [r["text"] for r in pieces.decode(rows).orderBy("doc_id").collect()] == [library.decode([2, 261]), None, ""]


def test_other_models_are_refused(library, tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as proto

    for change in ({"model_type": 1}, {"treat_whitespace_as_suffix": True}):
        model = proto.ModelProto()
        model.ParseFromString(library.serialized_model_proto())
        for name, value in change.items():
            setattr(model.trainer_spec, name, value)
        path = tmp_path / "other.model"
        path.write_bytes(model.SerializeToString())
        with pytest.raises(ValueError, match="not a BPE model"):
            pieces.read_model(str(path))


def trie_model(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest(), role, text))
    own = {c: [x[3:] for x in sorted(t)] for c, t in convs.items()}
    built = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = own.get(c - (c % 100 if c >= 0 else -(-c % 100)), [])
        built[c] = tuple(base[:h] + t[h:])
    nodes = defaultdict(list)
    for c, t in built.items():
        for d in range(len(t) + 1):
            nodes[t[:d]].append(c)
    children = Counter(k[:-1] for k in nodes if k)
    leaves, worth = Counter(), Counter()
    for k, members in nodes.items():
        for d in range(len(k) + 1):
            worth[k[:d]] += (len(members) - 1) * (len(k[-1][1]) if k else 0)
            leaves[k[:d]] += not children[k]
    out = []
    for k, members in nodes.items():
        last = ",".join(str(c) for c in sorted(c for c in members if built[c] == k))
        out.append((min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), children[k], leaves[k], worth[k], hashlib.sha256(last.encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize(("segment", "packed"), [(1024, 4096), (2, 3)])
def test_trie_of_generated_conversations(spark, monkeypatch, segment, packed):
    rng = random.Random(7)
    rows = []
    for c in [*range(0, 230, 3), 700, 705, *range(-120, -80, 7), 10**12]:
        for t in range(rng.randrange(1, 9)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["hi", "hello", "é🙂", "", None, "long " * 50])))
    rows += [(5, None, "user", "first"), (5, 1, "user", "tie a"), (5, 1, "user", "tie b"), (None, 0, "user", "nobody"), (6, 0, None, None), (6, 0, None, None)]
    rows += [(900, t, "user", f"t{t % 3}") for t in range(40)] + [(c, t, "u", "same") for c in range(901, 960) for t in range(7)] + [(1000, 0, "u", "word " * 60_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"n": F.lit(1), "depth": F.lit(2), "place": F.lit(3), "last": F.lit(4)})
    monkeypatch.setattr(trie.prefixes, "__defaults__", (segment,))
    monkeypatch.setattr(trie.ends, "__defaults__", (packed,))
    out = sorted((tuple(r) for r in trie.trie(df).select(*COLUMNS).collect()), key=str)
    assert out == trie_model(rows)


def test_trie_of_no_rows(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert trie.trie(df).count() == 0


def test_trie_of_long_conversations(spark):
    rows = [(c, t, "u", f"{t if t < cut else (c, t)}") for c, cut in ((1, 3000), (2, 2500), (3, 1024), (4, 1025)) for t in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = sorted((tuple(r) for r in trie.trie(df).select(*COLUMNS).collect()), key=str)
    built = defaultdict(list)
    for c, t, r, x in rows:
        built[c].append((r, x))
    kept = {c: tuple(t[zlib.crc32(str(c).encode()) % 6 :]) for c, t in built.items()}
    ends = {hashlib.sha256(str(c).encode()).hexdigest() for c in kept}
    assert {r[7] for r in out if r[4] == 0} == ends and sum(r[4] == 0 for r in out) == 4
    top = [r for r in out if r[1] == 0][0]
    total = 0
    by_depth = defaultdict(lambda: defaultdict(int))
    for t in kept.values():
        h = hashlib.sha256()
        for d, x in enumerate(t):
            h.update(repr(x).encode())
            by_depth[d][h.digest(), len(x[1])] += 1
    for nodes in by_depth.values():
        total += sum((n - 1) * size for (_, size), n in nodes.items())
    assert len(out) == 1 + sum(map(len, by_depth.values())) and top[6] == total and top[5] == 4


def written(monkeypatch, *modules):
    """A list that gets an entry for every table that ``modules`` write."""
    tables = []
    for module in modules:
        monkeypatch.setattr(module, "saved", lambda df, save=module.saved: (tables.append(1), save(df))[1])
    return tables


@pytest.mark.parametrize("kind", ["long", "string"])
def test_small_link_tables_settle_without_rounds(spark, monkeypatch, kind):
    """One table is written for a chain, whose rounds grow with its length; the rounds give the same."""
    links = [(i, i + 1) for i in range(-20, 40)] + [(100 + i % 7, 100 + i) for i in range(30)] + [(7, 7), (None, 3), (500, 499), (499, 500)]
    name = (lambda i: i) if kind == "long" else (lambda i: None if i is None else chr(0xFFFF - 300 + i) * 2 if i < 450 else chr(0x10000 + i))
    df = spark.createDataFrame([(name(a), name(b)) for a, b in links], f"a {kind}, b {kind}").repartition(3)
    if kind == "string":  # bytes that are no UTF-8 are names too
        odd = spark.sql("select cast(x'ff61' as string) a, cast(x'ff62' as string) b union all select cast(x'ff62' as string), 'z'")
        df = df.union(odd)
    tables, seen = written(monkeypatch, graph), []
    for local, most in ((graph.LOCAL, graph.LOCAL_BYTES), (graph.LOCAL, 0), (0, 0)):
        monkeypatch.setattr(graph, "LOCAL", local)
        monkeypatch.setattr(graph, "LOCAL_BYTES", most)
        tables.clear()
        found = graph.components(df)
        assert [t for _, t in found.dtypes] == [{"long": "bigint"}.get(kind, kind)] * 2
        as_bytes = found.select(*[F.col(c).cast("string").cast("binary") for c in ("node", "component")])
        seen.append((sorted(tuple(map(bytes, r)) for r in as_bytes.collect()), len(tables)))
    text = [str(name(i)).encode() for i in (*range(-20, 41), *range(100, 130), 499, 500)]
    assert {n for n, _ in seen[0][0]} == {*text, *([b"\xffa", b"\xffb", b"z"] if kind == "string" else [])}
    assert seen[0][0] == seen[1][0] == seen[2][0]
    assert seen[0][1] == 1 and seen[2][1] > 8 and (kind == "long") == (seen[1][1] == 1)
    assert graph.components(df.limit(0)).count() == 0


def test_near_duplicates_write_few_tables(spark, monkeypatch):
    """Groups of near copies in clusters of several blocks: no rounds of tables for few links."""
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    rng, texts = random.Random(4), []
    pool = [" ".join(f"p{i}w{k}" for k in range(12)) for i in range(6)]
    for i in range(60):
        words = " ".join(rng.sample(pool, 3)).split()
        words[rng.randrange(len(words))] = f"edit{i % 9}"
        texts.append((i, " ".join(words)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    tables = written(monkeypatch, graph)
    assert jaccard.jaccard_classes(docs, 2, 70).count() == 60
    assert 1 <= len(tables) <= 7  # one for each search


def executed_plans(spark, since=0):
    """The physical plans of all SQL executions after the first ``since``, those that write tables too."""
    spark._jsparkSession.sparkContext().listenerBus().waitUntilEmpty()
    runs = spark._jsparkSession.sharedState().statusStore().executionsList()
    return [runs.apply(i).physicalPlanDescription() for i in range(since, runs.size())]


def test_url_filters_run_no_python_on_executors(spark):
    """A chain, a star and a cycle of aliases: judged by DataFrame operations alone, as a plain search does."""
    link = '<link rel="canonical" href="http://{}.info/{}">'
    pages = [(i, f"http://c.info/{i}", link.format("c", i + 1)) for i in range(40)]
    pages += [(100 + i, f"http://s.info/{i}", link.format("s", "hub")) for i in range(20)]
    pages += [(200 + i, f"http://r.info/{i}", link.format("r", (i + 1) % 5)) for i in range(5)]
    pages += [(300, "http://x.net/", link.format("c", 17)), (301, "http://y.net/", link.format("s", "hub")), (302, "http://lone.info/", None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    before = len(executed_plans(spark))
    out = urls.judge(df)
    got = {r["page_id"]: r["verdict"] for r in out.collect()}
    assert got == {i: "allow" if 200 <= i < 300 or i == 302 else "block" for i, _, _ in pages}
    plans = executed_plans(spark, before)
    names = {m[1] for plan in plans for m in re.finditer(r"(?m)^[\s:+*|-]*(?:\(\d+\) )?([A-Z]\w*)", plan)}
    assert "HashAggregate" in names and not {n for n in names if re.search("Python|Pandas|Arrow", n)}
    assert len(plans) > 8  # the rounds' tables are among them
