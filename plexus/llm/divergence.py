"""Operator 11: how the words of each source diverge from the other sources and from the language.

Two passes over the texts.  The first counts, for each language, in how many documents a term occurs;
terms in at least ``least`` documents are kept.  The second recounts the occurrences of the kept terms
with Aho-Corasick automata over terms padded by a delimiter, in texts whose runs of other characters are
delimiters: matches may share a delimiter, so every whole term is found and no part of one.

The vocabulary grows with the corpus, the automata do not.  The ``hot`` kept terms in most documents,
a bounded number of bounded length, form one automaton per language that every task has.  What it leaves of
a text goes, as text, to the shard that its terms belong to; a shard has an automaton of its own, of about
``shard`` terms.  If all kept terms are hot, nothing is left and nothing moves.

Counts of (language, source, term) that are not 0 are the postings.  Pairs of sources need no zero counts: a
term that a source lacks has the source's least share there, so a pair's value is that of two sources
without any term in common (from the number of terms at each share) plus a correction for each term that
both have.  Corrections come from each term's list of sources and are summed inside each batch.

Defined cases: null text, language and source are empty; every row is a document; a language without kept
terms has values of 0 between its sources and no terms; a language with one source has no pair; an empty
table gives an empty result; very long texts and terms are counted whole; repeated rows count each;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from plexus.llm.common import ordered, saved, small
from plexus.llm.kernel import _LOWER, U, Block, blocks, mix

#: Terms of the automata that every task has, and the most bytes of one.
HOT, HOT_BYTES = 100_000, 64
#: Terms of the automaton of one shard.
SHARD = 20_000
#: Bytes of text taken at a time, and matches that a task holds before it counts them.
TEXT, HELD = 2 << 20, 4_000_000
_GAPS = np.ones(256, bool)
_GAPS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
#: Terms of a language: any characters but the ASCII ones that are no letters.
_PLAIN = np.where(_GAPS, 32, _LOWER).astype(np.uint8)


def _gathered(flat: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    ends = np.cumsum(size)
    return flat[np.repeat(first - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]


def _strings(flat: np.ndarray, first: np.ndarray, size: np.ndarray) -> pa.Array:
    """Strings from runs of bytes, without a Python object each."""
    off = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(off), pa.py_buffer(_gathered(flat, first, size)))


def _coded(column: pa.Array) -> tuple[np.ndarray, list[str]]:
    code = column.dictionary_encode()
    return code.indices.to_numpy(zero_copy_only=False).astype(np.int64), code.dictionary.to_pylist()


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, b in blocks(batch.column(1), TEXT, lower=True, gaps=_GAPS):
            lang, langs = _coded(batch.column(0).slice(lo, hi - lo))
            at = lang[b.wdoc]
            key = b.word_hashes() ^ mix(np.arange(1, len(langs) + 1, dtype=U))[at]  # of term and language
            order = np.argsort(key, kind="stable")  # documents stay in order
            key, doc = key[order], b.wdoc[order]
            first = np.append(True, key[1:] != key[:-1])[: len(key)]
            new = first.copy()
            new[1:] |= doc[1:] != doc[:-1]  # once in each document
            one = np.flatnonzero(first)
            word = order[one]
            df = np.add.reduceat(new, one, dtype=np.int64) if len(one) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()).take(pa.array(at[word])), _strings(b.buf, b.ws[word], (b.we - b.ws)[word]), pa.array(df)],
                names=["lang", "term", "df"])


def vocabulary(docs: DataFrame, least: int) -> DataFrame:
    """``(lang, term, df)``: the terms in at least ``least`` documents of a language."""
    counts = docs.select("lang", "text").mapInArrow(_document_counts, "lang string, term string, df long")
    return counts.groupBy("lang", "term").agg(F.sum("df").alias("df")).where(F.col("df") >= least)


def _shards(term_hashes: np.ndarray, shards: int) -> np.ndarray:
    return (term_hashes % U(shards)).astype(np.int64)


def _dealt(shards: int):
    """Adds to ``(lang, term)`` the shard that its text will go to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, b in blocks(batch.column(1), TEXT, gaps=_GAPS):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(_shards(b.word_hashes(), shards)), batch.column(1).slice(lo, hi - lo)], names=["lang", "shard", "term"])

    return run


def _automaton(terms: list[str]):
    """Of bytes read as Latin-1, so that places in a text are places of its bytes."""
    import ahocorasick

    made = ahocorasick.Automaton()
    for i, term in enumerate(terms):
        made.add_word(f" {term.encode().decode('latin-1')} ", i)
    made.make_automaton()
    return made


def _hits(automaton, text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """``(end, term)`` of all terms in a padded text; the end is the place of the delimiter after it."""
    found = np.fromiter(chain.from_iterable(automaton.iter(text.decode("latin-1"))), np.int64).reshape(-1, 2)
    return found[:, 0], found[:, 1]


#: The automata of hot terms, kept between the tasks of a Python worker.
_workers: dict[str, dict] = {}


def _count_hot(hot, key: str, shards: int):
    """``(lang, source, shard, term, text, n)``: counts of hot terms, and what is left of the texts for each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _workers:
            _workers.clear()
            _workers[key] = {lang: (_automaton(terms), pa.array(terms, pa.string())) for lang, terms in hot.value.items()}
        automata, numbers, held = _workers[key], {}, {}

        def counted():
            names = pa.array(list(numbers), pa.string())
            for name, codes in held.items():
                terms = automata[name][1]
                code, n = np.unique(np.concatenate(codes), return_counts=True)
                for i in range(0, len(code), 1 << 18):
                    c = code[i : i + (1 << 18)]
                    yield _rows(name, names.take(pa.array(c // len(terms))), None, terms.take(pa.array(c % len(terms))), None, n[i : i + (1 << 18)])
            held.clear()

        for batch in batches:
            for lo, hi, b in blocks(batch.column(2), TEXT, gaps=_GAPS):
                lang, langs = _coded(batch.column(0).slice(lo, hi - lo))
                source, sources = _coded(batch.column(1).slice(lo, hi - lo))
                number = np.array([numbers.setdefault(x, len(numbers)) for x in sources], np.int64)
                sources = pa.array(sources, pa.string())
                plain, size = _PLAIN[b.raw], np.diff(b.off)
                for k, name in enumerate(langs):
                    own = np.flatnonzero(lang == k)
                    # " text text text ", with one delimiter more after each text
                    cut = np.cumsum(size[own] + 1) + 1
                    text = np.full(int(cut[-1]), 32, np.uint8)
                    begin = cut - size[own] - 1
                    text[np.repeat(begin - (np.cumsum(size[own]) - size[own]), size[own]) + np.arange(int(size[own].sum()))] = _gathered(plain, b.off[own], size[own])
                    of = source[own]
                    marked = np.zeros(len(text) + 1, bool)
                    if name in automata:
                        automaton, terms = automata[name]
                        end, term = _hits(automaton, text.tobytes())
                        marked[end] = True
                        held.setdefault(name, []).append(number[of[np.searchsorted(cut, end, "right")]] * len(terms) + term)
                        if sum(len(x) for codes in held.values() for x in codes) > HELD:
                            yield from counted()
                    if shards:
                        term = text != 32
                        start, stop = np.flatnonzero(term[1:] & ~term[:-1]) + 1, np.flatnonzero(term[:-1] & ~term[1:]) + 1
                        left = ~marked[stop]
                        start, stop = start[left], stop[left] + 1  # with the delimiter after the term
                        rest = Block(_gathered(text, start, stop - start), np.array([0, int((stop - start).sum())]), gaps=_GAPS)
                        place = of[np.searchsorted(cut, start, "right")] * shards + _shards(rest.word_hashes(), shards)
                        order = np.argsort(place, kind="stable")
                        start, stop, place = start[order], stop[order], place[order]
                        group, first = np.unique(place, return_index=True)
                        total = np.concatenate([[0], np.cumsum(stop - start)])
                        flat, first = _gathered(text, start, stop - start), np.append(first, len(place))
                        yield _rows(name, sources.take(pa.array(group // shards)), group % shards, None, _strings(flat, total[first[:-1]], np.diff(total[first])), None)
        yield from counted()

    return run


def _rows(lang: str, source: pa.Array, shard, term, text, n) -> pa.RecordBatch:
    size = len(source)
    columns = [
        pa.array([lang] * size, pa.string()), source, pa.array(shard, pa.int64()) if shard is not None else pa.nulls(size, pa.int64()),
        term if term is not None else pa.nulls(size, pa.string()), text if text is not None else pa.nulls(size, pa.string()),
        pa.array(n, pa.int64()) if n is not None else pa.nulls(size, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "shard", "term", "text", "n"])


def _count_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(lang, source, term, n)`` from rows ``(lang, shard, source, term, text)``: the terms of a shard, then its texts."""
    key, terms, automaton, counts = None, [], None, {}

    def flush():
        out = [(key[0], source, terms[i], n) for source, own in counts.items() for i, n in zip(*own, strict=True)]
        counts.clear()
        columns = list(zip(*out, strict=True)) or [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["lang", "source", "term", "n"])

    def count(texts: dict[str, list[str]]):
        for source, parts in texts.items():
            _, found = _hits(automaton, b" " + "".join(parts).encode())
            index, n = np.unique(found, return_counts=True)
            counts[source] = index.tolist(), n.tolist()

    for batch in batches:
        rows = zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True)
        texts: dict[str, list[str]] = {}
        for lang, shard, source, term, text in rows:
            if (lang, shard) != key:
                if texts:
                    count(texts)
                    yield flush()
                key, terms, automaton, texts = (lang, shard), [], None, {}
            if text is None:
                terms.append(term)
            elif terms:  # else the shard has no kept term
                if automaton is None:
                    automaton = _automaton(terms)
                texts.setdefault(source, []).append(text)
        if texts:
            count(texts)
            yield flush()


def postings(docs: DataFrame, kept: DataFrame, hot: int = HOT, shard: int = SHARD) -> DataFrame:
    """``(lang, source, term, n)``: how often the terms of ``kept(lang, term, df)`` occur in ``docs(lang, source, text)``, if at all."""
    spark = docs.sparkSession
    short = kept.where(F.octet_length("term") <= HOT_BYTES).orderBy(F.desc("df"), "lang", "term").limit(hot)
    short = saved(short.select("lang", "term"))
    terms: dict[str, list[str]] = {}
    for row in short.collect():  # a bounded number of bounded length
        terms.setdefault(row["lang"], []).append(row["term"])
    rest = kept.count() - sum(map(len, terms.values()))
    shards = -(-rest // shard)
    counted = docs.select("lang", "source", "text").mapInArrow(
        _count_hot(spark.sparkContext.broadcast(terms), uuid4().hex, shards), "lang string, source string, shard long, term string, text string, n long")
    if shards:
        counted = saved(counted)
        own = kept.join(small(short), ["lang", "term"], "left_anti").select("lang", "term").mapInArrow(_dealt(shards), "lang string, shard long, term string")
        none = F.lit(None).cast("string")
        both = own.select("lang", "shard", none.alias("source"), "term", none.alias("text")).union(
            counted.where("text is not null").select("lang", "shard", "source", none, "text"))
        dealt = both.repartition("lang", "shard").sortWithinPartitions("lang", "shard", F.col("text").isNotNull())
        counted = counted.where("n > 0").select("lang", "source", "term", "n").union(dealt.mapInArrow(_count_shards, "lang string, source string, term string, n long"))
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))


def _share(n: str, total: str, terms: str, scale: int) -> Column:
    """1 + floor(scale * (n + 1) / (total + terms)), exact; null without terms."""
    up = f"cast({scale} as decimal(10, 0)) * cast({n} + 1 as decimal(19, 0))"
    return F.expr(f"case when {terms} > 0 then 1 + {up} div cast({total} + {terms} as decimal(19, 0)) end")


def _gap(p: str, q: str) -> str:
    return f"(({p}) - ({q})) * (({p}) - ({q})) div ({q})"


def _corrections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(a, b, value)`` from lists ``(group, p, p0)`` of the groups that have a term: what the term adds to each pair."""
    gap = lambda p, q: (p - q) * (p - q) // q
    for batch in batches:
        flat = [batch.column(i).flatten().to_numpy() for i in range(3)]
        size = batch.column(0).value_lengths().to_numpy()
        first = np.cumsum(size) - size
        for s in np.unique(size[size > 1]).tolist():
            own = first[size == s]
            many, slab = max(1, (1 << 19) // (s * s)), max(1, (1 << 19) // s)
            for i in range(0, len(own), many):
                g, p, z = (x[own[i : i + many, None] + np.arange(s)] for x in flat)
                for j in range(0, s, slab):
                    a, pa_, za = (x[:, j : j + slab, None] for x in (g, p, z))
                    b, qb, zb = (x[:, None, :] for x in (g, p, z))
                    value = gap(pa_, qb) - gap(pa_, zb) - gap(za, qb) + gap(za, zb)
                    code = (a << 32 | b).ravel()
                    order = np.argsort(code, kind="stable")
                    code, value = code[order], value.ravel()[order]
                    one = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
                    code, value = code[one], np.add.reduceat(value, one)
                    own_pair = code >> 32 != code & 0xFFFFFFFF
                    yield pa.RecordBatch.from_arrays(
                        [pa.array((code >> 32)[own_pair]), pa.array((code & 0xFFFFFFFF)[own_pair]), pa.array(value[own_pair])], names=["a", "b", "value"])


def audit(docs: DataFrame, least: int = 3, ranks: int = 200, scale: int = 1_000_000_000) -> DataFrame:
    """``(lang, source, part, item, value, rank)``; see the module text.

    The share of a term in a group is p = 1 + floor(scale * (count + 1) / (N + V)), for N occurrences of V kept terms.
    Part ``pair``: the other sources of the language by the sum of floor((p - q)^2 / q) over all kept terms, q being
    the other's share.  Part ``term``: the ``ranks`` terms that stand out most from the language as a whole, p > q.
    """
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    kept = saved(vocabulary(docs, least))
    posts = saved(postings(docs, kept))
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    zero = F.lit(0).cast("long")
    group = docs.select("lang", "source").distinct().join(posts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("terms")), ["lang", "source"], "left")
    group = group.join(sizes, "lang", "left").select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("total", "terms", "v")])
    group = saved(ordered(group.withColumn("p0", _share("0", "total", "v", scale)), ["lang", "source"]).withColumnRenamed("__ix", "id"))
    own = small(group.select("lang", "source", "id", "total", "v", "p0"))
    shares = posts.join(own, ["lang", "source"]).withColumn("p", _share("n", "total", "v", scale))
    # one row of a term holds its sources: as many at most as the language has
    total = group.groupBy("lang").agg(F.sum("total").alias("total"), F.max("v").alias("v"))
    terms = shares.groupBy("lang", "term").agg(F.collect_list(F.struct("id", "p", "p0", "source")).alias("x"), F.sum("n").alias("n"))
    terms = saved(terms.join(small(saved(total)), "lang").select("lang", "term", "x", _share("n", "total", "v", scale).alias("q")))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    out = terms.select("lang", "term", "q", F.explode("x").alias("x")).select("lang", "term", "q", "x.source", "x.p").where("p > q")
    term = out.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(_gap("p", "q")).alias("value"))
    term = term.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ranks)

    lists = terms.where(F.size("x") > 1)
    fixes = lists.select("x.id", "x.p", "x.p0").mapInArrow(_corrections, "a long, b long, value long").groupBy("a", "b").agg(F.sum("value").alias("fix"))
    steps = shares.groupBy("id", "p").agg(F.count(F.lit(1)).alias("m")).groupBy("id").agg(F.collect_list(F.struct("p", "m")).alias("steps"))
    full = saved(group.join(steps, "id", "left"))
    left, right = (full.select("lang", *[F.col(c).alias(f"{c}_{k}") for c in ("source", "id", "p0", "terms", "steps")], *(["v"] if k == "a" else [])) for k in "ab")
    pairs = left.join(right, "lang").where("id_a <> id_b").join(fixes, (F.col("id_a") == F.col("a")) & (F.col("id_b") == F.col("b")), "left")
    value = (
        f"aggregate(steps_a, 0L, (s, x) -> s + x.m * ({_gap('x.p', 'p0_b')})) + aggregate(steps_b, 0L, (s, x) -> s + x.m * ({_gap('p0_a', 'x.p')}))"
        f" + (v - terms_a - terms_b) * ({_gap('p0_a', 'p0_b')}) + coalesce(fix, 0L)")
    value = value.replace("aggregate(steps_a", "aggregate(coalesce(steps_a, array())").replace("aggregate(steps_b", "aggregate(coalesce(steps_b, array())")
    pair = pairs.select("lang", F.col("source_a").alias("source"), F.lit("pair").alias("part"), F.col("source_b").alias("item"), F.expr(f"case when v > 0 then {value} else 0L end").alias("value"))
    return pair.withColumn("rank", F.row_number().over(order)).unionByName(term)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op11_source_divergence": op11_source_divergence}
ORACLES = {
    "op11_source_divergence": r"""
with d as (select row_number() over () as k, coalesce(lang, '') as lang, coalesce(source, '') as source,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
t as (select k, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
kept as (select lang, term from t group by lang, term having count(distinct k) >= 3),
v as (select lang, count(*) as v from kept group by lang),
g as (select distinct lang, source from d),
c as (select lang, source, term, count(*) as n from t semi join kept using (lang, term) group by lang, source, term),
n as (select g.lang, g.source, coalesce(sum(c.n), 0) as total from g left join c using (lang, source) group by g.lang, g.source),
p as (
  select n.lang, n.source, kept.term, coalesce(c.n, 0) as n,
    1 + cast(1000000000 as hugeint) * (coalesce(c.n, 0) + 1) // cast(n.total + v.v as hugeint) as p
  from n join kept using (lang) join v using (lang) left join c on c.lang = n.lang and c.source = n.source and c.term = kept.term),
w as (
  select lang, term, 1 + cast(1000000000 as hugeint) * (sum(n) + 1) // cast(any_value(t.total) + any_value(v.v) as hugeint) as q
  from c join (select lang, sum(n) as total from c group by lang) t using (lang) join v using (lang) group by lang, term),
pair as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(x.value, 0) as value
  from g a join g b on a.lang = b.lang and a.source <> b.source left join (
    select x.lang, x.source, y.source as other, sum((x.p - y.p) * (x.p - y.p) // y.p) as value
    from p x join p y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by all
  ) x on x.lang = a.lang and x.source = a.source and x.other = b.source),
term as (
  select p.lang, p.source, 'term' as part, p.term as item, (p.p - w.q) * (p.p - w.q) // w.q as value
  from p join w using (lang, term) where p.n > 0 and p.p > w.q),
r as (select *, row_number() over (partition by lang, source, part order by value desc, encode(item)) as rank from (select * from pair union all select * from term))
select lang, source, part, item, cast(value as bigint) as value, cast(rank as int) as rank from r where part = 'pair' or rank <= 200
""",
}
