"""Operator 5: n-gram Jaccard join by prefix trees.

A document's set is its distinct n-word shingles (64-bit hashes of A-Z-lower-cased words); fewer words
make one shingle of the whole sequence, none make the empty set, which links with nothing.  Two
documents link when ``100 * |intersection| >= percent * |union|``.

How it runs:

1. One Arrow pass gives each row its set size, a 128-bit set fingerprint and the part of its set that can
   hold its prefix: the shingles in the lowest quarter of the hash space, or all of a set of up to
   ``SMALL``.  Equal sets fold into one representative row.
2. The global order is: counted shingles by document frequency, then by hash, then the others.  Any such order
   is exact; this one keeps shared passages out of the prefixes.  Sets up to ``SMALL`` are joined with
   each other by counts of all their shingles, and larger ones (and those that can link with larger ones) by
   counts of that quarter.  Two sets that link share one of their first
   ``n - ceil(percent * n / 100) + 1`` shingles.  Sets that share none are out; those left, few, are ordered
   again by counts of all their shingles among each other, and the sets of each prefix shingle are a
   group.  A group is left out if all its sets have one and the same shingle before this one in their
   prefixes: then the group of that one has all of them.
3. A first wave takes every set once, in its largest group, and finds nearly all links.  Groups
   whose sets all are in one class are done.  The others are joined to clusters, so that each set is sent once more.
4. Inside a group or cluster sets sit in a radix trie, most frequent shingles first; a probe walks it carrying
   the overlap of the shared path, and leaves a subtree when the remaining lengths cannot reach the
   threshold or when all of it is in its own class already (the links left out join documents that are
   connected, so classes stay exact).  Clusters over ``BLOCK`` sets are cut into blocks in size order:
   first each block is joined in itself, then one set of each class of each block with the others, and
   last the pairs of blocks that may still hold a link between two classes.
5. Links go through connected components; copies take the class of their representative.

Defined cases: null or blank text has n_shingles 0 and links nothing by its text; rows that share a
doc_id are one document, whatever their texts; a row with a null doc_id is a document of its own, whose
component_id is the smallest doc_id it reaches (null if none); an empty table gives an empty result;
very long texts are one set each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plexus.llm.common import components, keyed, once, ordered, saved, small, without
from plexus.llm.kernel import U, Block, blocks, by_group, mix, windows

#: Sets in one block; a task holds two blocks.
BLOCK = 1024
#: Sets of up to so many shingles are joined by counts of all of them.
SMALL = 400
_BAND = U(1) << U(62)


def _least_overlap(n, percent: int):
    return -(-percent * n // 100)


def doc_sets(b: Block, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts in the block: ``(hash, doc)``, sorted by document and hash."""
    h = b.word_hashes()
    s, at = windows(h, b.wdoc, n)
    doc = b.wdoc[at]
    for k in range(1, n):  # texts of fewer words
        short = b.wn == k
        if short.any():
            pick = short[b.wdoc]
            s2, at2 = windows(h[pick], b.wdoc[pick], k)
            s, doc = np.concatenate([s, s2]), np.concatenate([doc, b.wdoc[pick][at2]])
    order = by_group(s, doc)
    s, doc = s[order], doc[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    return s[new], doc[new]


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    off = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off), pa.array(values.view(np.int64)))


def _heads(n: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, b in blocks(batch.column(2), lower=True):
                s, doc = doc_sets(b, n)
                size = np.bincount(doc, minlength=b.n)
                first = np.concatenate([[0], np.cumsum(size)])
                sums = []
                for seed in (U(0), U(0x5851F42D4C957F2D)):
                    total = np.concatenate([[U(0)], np.cumsum(mix(s ^ seed))])
                    sums.append((total[first[1:]] - total[first[:-1]]).view(np.int64))
                rank = np.arange(len(s)) - first[doc]
                keep = (s < _BAND) | (rank < (size - _least_overlap(size, percent) + 1)[doc]) | (size <= SMALL)[doc]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        batch.column(1).slice(lo, hi - lo),
                        pa.array(size.astype(np.int64)),
                        pa.array(sums[0]),
                        pa.array(sums[1]),
                        _lists(s[keep], np.bincount(doc[keep], minlength=b.n)),
                    ],
                    names=["__id", "__h", "n", "fa", "fb", "head"],
                )

    return run


def _whole(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, b in blocks(batch.column(0), lower=True):
                s, doc = doc_sets(b, n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).slice(lo, hi - lo) for i in (1, 2)] + [_lists(s, np.bincount(doc, minlength=b.n))], names=["rep", "n", "head"])

    return run


class _Node:
    __slots__ = ("seg", "kids", "ends", "lo", "hi", "any", "one")

    def __init__(self, seg, size, doc):
        self.seg, self.kids, self.ends, self.lo, self.hi, self.any, self.one = seg, {}, [], size, size, doc, True


class PrefixTree:
    """A radix trie of sets in one global order, with union-find classes over the stored sets."""

    def __init__(self, sets: list[np.ndarray], percent: int, known: list[int] | None = None):
        """``sets``: arrays of distinct hashes.  Their order here: most frequent first, so paths are shared.

        ``known``: a class of each set; sets of one class are not looked for.
        """
        self.percent = percent
        flat = np.concatenate(sets) if sets else np.zeros(0, U)
        _, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
        rank = np.empty(len(count), np.int64)
        rank[np.argsort(-count, kind="stable")] = np.arange(len(count))
        cuts = np.cumsum([len(x) for x in sets])[:-1]
        self.sets = [np.sort(x) for x in np.split(rank[inverse], cuts)] if sets else []
        self.inside = np.zeros(len(count), bool)
        first: dict = {}
        self.up = [first.setdefault(k, i) for i, k in enumerate(known)] if known else list(range(len(sets)))
        self.root = _Node(np.zeros(0, np.int64), 0, -1)
        self.root.one, self.root.lo = False, 1 << 60

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def add(self, doc: int) -> None:
        mine, node, at = self.sets[doc], self.root, 0
        size = len(mine)
        while True:
            if node.any >= 0 and node.one and self.find(node.any) != self.find(doc):
                node.one = False
            node.lo, node.hi, node.any = min(node.lo, size), max(node.hi, size), doc
            if at == size:
                node.ends.append(doc)
                return
            kid = node.kids.get(int(mine[at]))
            if kid is None:
                kid = node.kids[int(mine[at])] = _Node(mine[at:], size, doc)
                kid.ends.append(doc)
                return
            m = min(len(kid.seg), size - at)
            differ = np.flatnonzero(kid.seg[:m] != mine[at : at + m])
            same = int(differ[0]) if len(differ) else m
            if same < len(kid.seg):  # split
                top = _Node(kid.seg[:same], kid.lo, kid.any)
                top.hi, top.one = kid.hi, kid.one
                kid.seg = kid.seg[same:]
                top.kids[int(kid.seg[0])] = kid
                node.kids[int(mine[at])] = kid = top
            at += same
            node = kid

    def links(self, doc: int) -> list[int]:
        """Stored sets that link with ``doc``, one for each class it was not in before."""
        mine = self.sets[doc]
        a, need, out = len(mine), self.percent, []
        self.inside[mine] = True
        stack = [(k, 0, 0) for k in self.root.kids.values()]
        while stack:
            node, overlap, used = stack.pop()
            if 100 * a < need * node.lo or 100 * node.hi < need * a:
                continue
            if node.one and self.find(node.any) == self.find(doc):
                continue
            seg = node.seg
            overlap += int(np.count_nonzero(self.inside[seg]))
            used += len(seg)
            left = a - int(np.searchsorted(mine, seg[-1], "right"))
            most = overlap + min(node.hi - used, left)
            if (100 + need) * most < need * (a + node.lo):
                continue
            for other in node.ends:
                if (100 + need) * overlap >= need * (a + used) and (i := self.find(other)) != (j := self.find(doc)):
                    self.up[max(i, j)] = min(i, j)
                    out.append(other)
            stack.extend((k, overlap, used) for k in node.kids.values())
        self.inside[mine] = False
        return out


def group_links(ids: list[int], side: list[int], sets: list[np.ndarray], percent: int, known: list[int] | None = None) -> list[tuple[int, int]]:
    """Links of one group: among all (one block), or between sides 0 and 1 (a pair of blocks).

    ``known`` are classes found before; only links between two of them are given.
    """
    order = sorted(range(len(ids)), key=lambda i: (side[i], len(sets[i]), ids[i]))
    tree = PrefixTree([sets[i] for i in order], percent, [known[i] for i in order] if known else None)
    two, out = len(set(side)) > 1, []
    for k, i in enumerate(order):
        if not two or side[i]:
            out += [(ids[i], ids[order[o]]) for o in tree.links(k) if ids[i] != ids[order[o]]]
        if not two or not side[i]:
            tree.add(k)
    return out


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, side, known, sets = None, [], [], [], []

        def done():
            found = group_links(ids, side, sets, percent, known) if len(ids) > 1 else []
            return pa.RecordBatch.from_arrays(
                [pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"]
            )

        for batch in batches:
            cluster, b1, b2, block, rep, cls = (batch.column(i).to_pylist() for i in range(6))
            lists = batch.column(6)
            flat, off = lists.values.to_numpy(zero_copy_only=False).view(U), lists.offsets.to_numpy()
            for i in range(len(rep)):
                if (now := (cluster[i], b1[i], b2[i])) != key:
                    if ids:
                        yield done()
                    key, ids, side, known, sets = now, [], [], [], []
                ids.append(rep[i])
                side.append(int(block[i] != b1[i]))
                known.append(cls[i])
                sets.append(flat[off[i] : off[i + 1]].copy())
        if ids:
            yield done()

    return run


def shared_prefixes(reps: DataFrame, percent: int, counted: Column) -> DataFrame:
    """``(token, rep, before)``: the shingles of each set's prefix that other sets hold, from ``reps(rep, n, head)``.

    The first ``counted`` shingles of ``head`` come in the order (document frequency, hash).  Those of one set only
    come first and link nothing, so of a set with ``m`` counted shingles, ``c`` of them shared, the prefix of
    length p holds the first ``p - m + c`` shared ones; and of the shingles past them, which are in
    hash order, those before place p.  ``before`` is the shingle before in the set's part of the prefix.
    """
    length = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    sized = reps.select("rep", "n", "head", counted.alias("m")).withColumn("room", (length - F.col("m")).cast("int"))
    tokens = sized.select("rep", "room", "m", F.posexplode("head").alias("pos", "token"))
    tokens = tokens.where("pos < m or pos < m + room").select("rep", "token", F.when(F.col("pos") < F.col("m"), F.col("room")).alias("room"))
    frequent = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    inside = F.col("room").isNotNull()
    lists = tokens.join(frequent, "token").groupBy("rep").agg(
        F.max("room").alias("room"), F.sort_array(F.collect_list(F.when(inside, F.struct("df", "token")))).alias("inside"),
        F.sort_array(F.collect_list(F.when(~inside, F.col("token")))).alias("past"))
    taken = F.slice("inside.token", F.lit(1), F.greatest(F.coalesce("room", F.lit(0)) + F.size("inside"), F.lit(0)))
    prefix = lists.select("rep", F.concat(taken, "past").alias("prefix"))
    return prefix.select("rep", "prefix", F.posexplode("prefix").alias("pos", "token")).select("token", "rep", F.get("prefix", F.col("pos") - 1).alias("before"))


def candidates(reps: DataFrame, percent: int) -> DataFrame:
    """``(rep)``: the sets of ``reps(rep, n, head)`` that share a prefix shingle with another."""
    small_sets, large_sets = reps.where(F.col("n") <= SMALL), reps.where(F.col("n") * 100 >= SMALL * percent)
    of_small = shared_prefixes(small_sets, percent, F.size("head"))
    of_small = of_small.select(F.xxhash64("token").alias("token"), "rep")  # kept apart from the tokens of the other join
    of_large = shared_prefixes(large_sets, percent, F.size(F.filter("head", lambda t: t.between(0, int(_BAND) - 1))))
    prefix = saved(of_small.union(of_large.select("token", "rep")))
    met = saved(prefix.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("token"))
    return prefix.join(small(met), "token", "left_semi").select("rep").distinct()


def prefix_groups(sets: DataFrame, percent: int) -> DataFrame:
    """``(rep, cluster)``: groups of whole sets ``sets(rep, n, head)`` in which two that link are together."""
    prefix = saved(shared_prefixes(sets, percent, F.size("head")))
    groups = prefix.groupBy("token").agg(F.count(F.lit(1)).alias("c"), F.count("before").alias("k"), F.min("before").alias("lo"), F.max("before").alias("hi"))
    groups = saved(groups.where("c > 1 and not (k = c and lo = hi)").select("token"))
    return prefix.join(small(groups), "token").select("rep", F.col("token").alias("cluster"))


def verified(sets: DataFrame, members: DataFrame, groups: DataFrame | None, percent: int) -> DataFrame:
    """Links ``(a, b)`` inside groups of ``sets(rep, head)``: ``members(rep, cluster, block, cls)``, ``groups(cluster, b1, b2, block)``.

    Without ``groups`` every block is one.
    """
    whole = sets.select("rep", F.col("head").alias("set")).join(small(members.select("rep", "cluster", "block", "cls")), "rep")
    group = ["cluster", "b1", "b2"]
    if groups is None:
        dealt = whole.withColumns({"b1": F.col("block"), "b2": F.col("block")})
    else:
        dealt = whole.join(groups, ["cluster", "block"])
    dealt = dealt.select(*group, "block", "rep", "cls", "set").repartition(*[F.col(c) for c in group])
    return dealt.sortWithinPartitions(*group).mapInArrow(_verify(percent), "a long, b long")


def first_wave(sets: DataFrame, groups: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """``(links, open)`` of ``groups(rep, cluster)``: each set meets its largest group of up to ``BLOCK``.

    ``open(rep, cluster, cls)`` has the groups whose sets are not all of one class after it.
    """
    size = groups.groupBy("cluster").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") <= BLOCK)
    pick = groups.join(size, "cluster").groupBy("rep").agg(F.max_by("cluster", F.struct("c", "cluster")).alias("cluster"))
    links = saved(verified(sets, saved(pick.withColumns({"block": F.lit(0).cast("long"), "cls": F.col("rep")})), None, percent))
    classes = saved(components(links).toDF("rep", "__c"))
    classed = saved(groups.join(classes, "rep", "left").select("rep", "cluster", F.coalesce("__c", "rep").alias("cls")))
    several = classed.groupBy("cluster").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo <> hi").select("cluster")
    return links, saved(classed.join(several, "cluster", "left_semi"))


def _relabelled(members: DataFrame, links: DataFrame) -> DataFrame:
    """``members`` with ``cls`` moved to the component of the links between its sets."""
    classes = members.select("rep", "cls").distinct().where("rep <> cls").union(links.toDF("rep", "cls"))
    found = components(classes).toDF("rep", "__c")
    return members.join(found, "rep", "left").withColumn("cls", F.coalesce("__c", "cls")).drop("__c").select(*members.columns)


def _blocks(members: DataFrame, order: list[str]) -> DataFrame:
    """``members`` with ``block``: ``BLOCK`` rows of a cluster each, in the given order."""
    at = saved(ordered(members, ["cluster", *order]))
    start = at.groupBy("cluster").agg(F.min("__ix").alias("__start"))
    block = F.floor((F.col("__ix") - F.col("__start")) / BLOCK).cast("long")
    return at.join(start, "cluster").withColumn("block", block).select(*members.columns)


def large_clusters(sets: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """``(rep, cls)`` of clusters over ``BLOCK`` sets: ``members(rep, n, cluster, block, cls)``."""
    members = saved(_blocks(members, ["n", "rep"]))
    members = saved(_relabelled(members, verified(sets, members, None, percent)))
    # one set of each class of each block meets those of other blocks
    heads = members.groupBy("cluster", "block", "cls").agg(F.min("rep").alias("rep")).select("rep")
    heads = saved(_blocks(members.join(heads, "rep", "left_semi").select(*members.columns), ["n", "rep"]))
    if heads.limit(2).count() > 1:
        links = saved(verified(sets, heads, None, percent))
        members = saved(_relabelled(members, links))
    # pairs of blocks of like sizes, unless both are of one class
    span = members.groupBy("cluster", "block").agg(
        F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("cls").alias("c1"), F.max("cls").alias("c2"))
    span = saved(span)
    left, right = (span.select("cluster", *[F.col(c).alias(f"{c}_{k}") for c in ("block", "lo", "hi", "c1", "c2")]) for k in (1, 2))
    pairs = left.join(right, "cluster").where(
        f"block_1 < block_2 and 100 * hi_1 >= {percent} * lo_2 and not (c1_1 = c2_1 and c1_2 = c2_2 and c1_1 = c1_2)")
    groups = saved(pairs.select("cluster", F.col("block_1").alias("b1"), F.col("block_2").alias("b2")).withColumn("block", F.explode(F.array("b1", "b2"))))
    if groups.limit(1).count():
        asked = members.join(groups.select("cluster", "block").distinct(), ["cluster", "block"], "left_semi").select(*members.columns)
        members = saved(_relabelled(members, verified(sets, saved(asked), groups, percent)))
    return members.select("rep", "cls").where("rep <> cls").distinct()


def row_classes(docs: DataFrame, n: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A written table with a row for each row of ``docs``: ``(__id, __h, n, node, first, shared)``.

    Rows have one ``node`` if their sets are in one class; empty sets have a node of their own.  ``first`` is the
    ``(none, id, h)`` of the class's first row: the smallest doc_id, null last.  ``shared``: another row has an equal set.
    """
    texts = keyed(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    heads = texts.select("__id", "__h", "text").mapInArrow(_heads(n, percent), "__id long, __h long, n long, fa long, fb long, head array<long>")
    heads = saved(heads.withColumn("row", F.monotonically_increasing_id()))
    key = ["n", "fa", "fb"]
    sets = heads.select("row", "__id", "__h", *key, F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), F.col("__h").alias("h")).alias("first"))
    folded = sets.where("n > 0").groupBy(*key).agg(F.min("row").alias("rep"), F.min("first").alias("__f"), F.count(F.lit(1)).alias("copies"))
    folded = saved(folded.where("copies > 1").drop("copies"))
    member = saved(sets.join(folded, key, "left").select(
        "row", "__id", "__h", "n", F.coalesce("rep", "row").alias("rep"), F.coalesce("__f", "first").alias("first"), F.col("rep").isNotNull().alias("shared")))
    copies = saved(member.where("row <> rep").select("row"))
    reps = heads.where("n > 0").select("row", F.col("row").alias("rep"), "n", "head").join(small(copies), "row", "left_anti")

    found = saved(candidates(reps, percent))
    twice = member.where("shared").groupBy("__id", "__h").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("__id", "__h")
    twice = saved(twice)
    if twice.limit(1).count():
        texts = once(texts, twice)
    keys = member.where("row = rep").join(found, "rep", "left_semi").select(F.col("__id").alias("__i"), F.col("__h").alias("__k"), "rep", "n")
    match = (texts["__h"] == F.col("__k")) & texts["__id"].eqNullSafe(F.col("__i"))
    sets = saved(texts.join(small(saved(keys)), match).select("text", "rep", "n").mapInArrow(_whole(n), "rep long, n long, head array<long>"))
    links, left = first_wave(sets, saved(prefix_groups(sets, percent)), percent)
    hubs = left.groupBy("cluster").agg(F.min("rep").alias("first"))
    cluster = components(left.join(hubs, "cluster").select("rep", "first")).toDF("rep", "cluster")
    spot = left.select("rep", "cls").distinct().join(cluster, "rep").join(sets.select("rep", "n"), "rep")
    spot = saved(spot.select("rep", "n", "cluster", F.lit(0).cast("long").alias("block"), "cls"))
    large = saved(spot.groupBy("cluster").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > BLOCK).select("cluster"))
    links = links.union(verified(sets, saved(spot.join(large, "cluster", "left_anti").select(*spot.columns)), None, percent))
    if large.limit(1).count():
        wide = large_clusters(sets, spot.join(large, "cluster", "left_semi").select(*spot.columns), percent)
        links = links.union(wide.toDF("a", "b"))
    classes = saved(components(links).toDF("rep", "cls"))
    named = classes.join(member.where("row = rep").select("rep", "first"), "rep")
    first = named.groupBy("cls").agg(F.min("first").alias("__f"))
    found = named.join(first, "cls").select("rep", "cls", "__f")
    return saved(member.join(found, "rep", "left").select(
        "__id", "__h", "n", F.coalesce("cls", "rep").alias("node"), F.coalesce("__f", "first").alias("first"), "shared"))


def jaccard_classes(docs: DataFrame, n: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row of ``docs``; see the module text."""
    rows = row_classes(docs, n, percent, id_col, text_col)
    both = rows.where("__id is not null").groupBy("__id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b")
    both = saved(both.select("__id", "a"))
    if both.limit(1).count():  # doc_ids with several texts join the classes of these
        joined = saved(components(rows.join(both, "__id").select("node", "a")).toDF("node", "__c"))
        first = rows.join(joined, "node").groupBy("__c").agg(F.min("first").alias("__f"))
        rows = rows.join(joined.join(first, "__c").select("node", "__f"), "node", "left").withColumn("first", F.coalesce("__f", "first"))
    return rows.select(F.col("__id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("first.id").alias("component_id"))


def distinct_rows(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, but for rows whose text is in the class of an earlier row.

    Rows are taken by ``doc_id``, null last; of rows that share doc_id and text the one whose columns hash least stays.
    Rows of one doc_id with texts that are not alike all stay, and so do texts without words.
    """
    rows = row_classes(docs, n, percent)
    mine = F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), F.col("__h").alias("h"))
    out = saved(rows.where(F.col("n") > 0).where(mine != F.col("first")).select("__id", "__h").distinct())
    twice = rows.where("n > 0 and shared").where(mine == F.col("first")).groupBy("__id", "__h").agg(F.count(F.lit(1)).alias("__n"))
    twice = saved(twice.where("__n > 1").select("__id", "__h"))
    kept = without(keyed(docs), small(out))
    if twice.limit(1).count():
        kept = once(kept, twice)
    return kept.select(*docs.columns)


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op5_ngram_jaccard_join": op5_ngram_jaccard_join}
ORACLES = {
    "op5_ngram_jaccard_join": r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
s as (
  select doc_id, list_distinct(case when len(ws) = 0 then [] when len(ws) < 4 then [array_to_string(ws, ' ')]
    else [array_to_string(ws[i:i+3], ' ') for i in range(1, len(ws) - 2)] end) as sh from w),
x as (select doc_id, len(sh) as n, unnest(sh) as g from s),
y as (select doc_id, n, hash(g) as h, g from x where g in (select g from x group by g having count(*) > 1)),
l as (
  select a.doc_id as p, b.doc_id as q from y a join y b on a.h = b.h and a.g = b.g and a.doc_id <> b.doc_id
  where 100 * a.n >= 85 * b.n and 100 * b.n >= 85 * a.n
  group by a.doc_id, b.doc_id, a.n, b.n
  having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach(doc_id, r) as (select doc_id, doc_id from s union select l.q, reach.r from reach join l on l.p = reach.doc_id)
select s.doc_id, cast(len(s.sh) as bigint) as n_shingles, min(reach.r) as component_id
from s join reach on reach.doc_id = s.doc_id group by s.doc_id, len(s.sh)
""",
}
