"""Operator 13: the prefix trie of conversations.

A node of the trie is a distinct sequence of first turns, named by a SHA-256 digest that is chained along
the conversation: each digest covers the one before and the turn's role and text, so equal digests at
equal depth mean equal prefixes.  Every conversation is exploded into its prefixes; grouped by
(depth, digest) they are the nodes.  Each node is exploded to all its ancestors, where subtree sums meet.

Long conversations stay spread out.  Turns are placed by a global order, not by a sort of one
conversation in one task.  Digests are chained inside segments of ``SEGMENT`` turns; only the last
digest of each segment is chained along the conversation, and a prefix is named by that chain and the
chain inside its segment.  The nodes of which a conversation is the smallest member are the last part of its
path, so what they send to an ancestor is summed along the path first: a conversation of n turns
explodes into n rows, not n * n / 2.

The conversations that end at a node are hashed as one text in the order of their ids.  SHA-256 has no
parallel form, so that text runs through one task, packed by id range and never held as a whole.

Defined cases: null role or text is empty; a null turn comes first; rows of one conversation with equal
turns come in the order of the digests of role and text, and repeated rows stay; rows without conv_id
belong to no conversation; an empty table has no node; very long texts are hashed where they are read;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plexus.llm.common import ordered, saved

#: Turns chained in one row.
SEGMENT = 1024
#: Ids in one row of the ends of a node, at most.
PACKED = 1 << 12
_ROOT = bytes(32)
_EMPTY = hashlib.sha256(b"").hexdigest()


def _sha(x: Column) -> Column:
    return F.unhex(F.sha2(x, 256))


def turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv_id, place, turn, length)``: turns in order from 0, each as the digest of role and text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    named = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")
    own = rows.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("at"), _sha(named).alias("turn"), F.length(text).cast("long").alias("length"))
    placed = saved(ordered(own, ["conv_id", "at", "turn"]).drop("at"))
    first = placed.groupBy("conv_id").agg(F.min("__ix").alias("__first"))
    return placed.join(first, "conv_id").select("conv_id", (F.col("__ix") - F.col("__first")).alias("place"), "turn", "length")


def rebuilt(own: DataFrame, block: int = 100, heads: int = 6) -> tuple[DataFrame, DataFrame]:
    """``(conversations, turns)`` where each conversation takes its first turns from its block's first one.

    Of conversation c the first h = crc32(decimal c) % ``heads`` turns go, and the first h turns of conversation
    c - c % ``block`` (all if it has fewer, none if it is absent) come instead.
    ``conversations(conv_id, n)`` has all of them with their turns; ``turns(conv_id, place, turn, length)``.
    """
    size = own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    convs = saved(size.withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % block}))
    bases = convs.where("conv_id = base").select("base", F.col("n").alias("base_n"))
    convs = saved(convs.join(bases, "base", "left").withColumn("given", F.least("h", F.coalesce("base_n", F.lit(0)))).drop("base_n"))
    given = own.where((F.col("conv_id") % block == 0) & (F.col("place") < heads - 1)).withColumnRenamed("conv_id", "base")
    given = convs.where("given > 0").select("conv_id", "base", "given").join(given, "base").where("place < given")
    kept = own.join(convs.select("conv_id", "h", "given"), "conv_id").where("place >= h")
    out = given.select("conv_id", "place", "turn", "length").union(
        kept.select("conv_id", (F.col("place") - F.col("h") + F.col("given")).alias("place"), "turn", "length"))
    return convs.select("conv_id", (F.col("given") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n")), out


def _chained(digests: Column, start: Column) -> Column:
    """All digests of the chain that begins with ``start`` over an array of digests."""
    grown = F.reduce(digests, F.array(start), lambda done, d: F.array_append(done, _sha(F.concat(F.element_at(done, -1), d))))
    return F.slice(grown, F.lit(2), F.size(digests))


def prefixes(sequences: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """``(conv_id, depth, node, parent, length)`` of each non-empty prefix of ``sequences(conv_id, place, turn, length)``.

    ``node`` names the prefix, ``parent`` the one without its last turn.
    """
    root = F.lit(_ROOT)
    part = sequences.groupBy("conv_id", F.floor(F.col("place") / segment).alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("place", "turn", "length"))).alias("items"))
    part = saved(part.select("conv_id", "part", F.transform("items", lambda i: i["length"]).alias("lengths"), _chained(F.transform("items", lambda i: i["turn"]), root).alias("names")))
    last = part.join(part.where("part > 0").select("conv_id").distinct(), "conv_id", "left_semi").select("conv_id", "part", F.get("names", F.size("names") - 1).alias("name"))
    whole = last.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "name"))), lambda i: i["name"]).alias("names"))
    # the name of the end of segment k comes before segment k + 1
    chain = F.concat(F.array(F.get("names", F.lit(0))), _chained(F.slice("names", F.lit(2), F.size("names")), F.get("names", F.lit(0))))
    before = whole.select("conv_id", F.posexplode(chain).alias("__k", "before")).select("conv_id", (F.col("__k") + 1).cast("long").alias("part"), "before")
    named = part.join(before, ["conv_id", "part"], "left")
    long = lambda x: F.when(F.col("before").isNull(), x).otherwise(_sha(F.concat("before", x)))
    start = F.coalesce(F.col("before"), root)
    row = named.select("conv_id", "part", "before", "lengths", "names", F.posexplode("names").alias("__k", "__name"))
    return row.select(
        "conv_id", (F.col("part") * segment + F.col("__k") + 1).alias("depth"), long(F.col("__name")).alias("node"),
        F.when(F.col("__k") > 0, long(F.get("names", F.col("__k") - 1))).otherwise(start).alias("parent"), F.get("lengths", "__k").alias("length"))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(node, ends)`` of rows ``(node, ids)`` in the order of nodes and id ranges: SHA-256 of all ids of a node."""
    node, digest = None, None
    for batch in batches:
        out = []
        for name, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if name == node:
                digest.update(b",")
            else:
                if node is not None:
                    out.append((node, digest.hexdigest()))
                node, digest = name, hashlib.sha256()
            digest.update(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.string())], names=["name", "ends"])
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([digest.hexdigest()])], names=["name", "ends"])


def ends(members: DataFrame, packed: int = PACKED) -> DataFrame:
    """``(name, ends)``: for each node of ``members(node, conv_id)`` the SHA-256 of its ids, ascending, joined by commas."""
    bucket = F.floor(F.col("conv_id") / packed).alias("bucket")
    packs = members.groupBy("node", bucket).agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    packs = packs.select("node", "bucket", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))
    dealt = packs.repartition(F.col("node")).sortWithinPartitions("node", "bucket")
    return dealt.select("node", "ids").mapInArrow(_hashed, "name binary, ends string")


def trie(rows: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations of ``rows(conv_id, turn, role, text)``; see the module text.

    ``(node, conv_id, depth, parent, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)``.
    """
    convs, sequences = rebuilt(saved(turns(rows)))
    convs = saved(convs)
    steps = prefixes(sequences).join(convs, "conv_id").withColumn("last", (F.col("depth") == F.col("n")).cast("long")).drop("n")
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("binary")
    tops = convs.select("conv_id", zero.alias("depth"), F.lit(_ROOT).alias("node"), none.alias("parent"), zero.alias("length"), (F.col("n") == 0).cast("long").alias("last"))
    path = saved(steps.select(*tops.columns).union(tops))
    nodes = saved(path.groupBy("depth", "node", "parent", "length").agg(
        F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n_convs"), F.sum("last").alias("n_ends")))

    # what each conversation's own nodes send up its path, summed from its end
    worth = nodes.select("node", F.col("depth").alias("__d"), "owner", ((F.col("n_convs") - 1) * F.col("length")).alias("value"), (F.col("n_convs") == F.col("n_ends")).cast("long").alias("leaf"))
    mine = path.join(nodes.select(F.col("owner").alias("conv_id")).distinct(), "conv_id", "left_semi").select("conv_id", "depth", "node")
    mine = mine.join(worth, (worth["node"] == mine["node"]) & (worth["owner"] == mine["conv_id"]), "left").select(
        "conv_id", "depth", mine["node"], F.coalesce("value", zero).alias("value"), F.coalesce("leaf", zero).alias("leaf"))
    runs = saved(ordered(mine, ["conv_id", "depth"], "value"))
    total = runs.groupBy("conv_id").agg(F.max(F.col("__cum") + F.col("value")).alias("__end"), F.max("leaf").alias("__leaf"))
    up = runs.join(total, "conv_id").select("node", (F.col("__end") - F.col("__cum")).alias("saved"), F.col("__leaf").alias("leaves"), zero.alias("child"))
    below = up.union(nodes.where("parent is not null").select(F.col("parent"), zero, zero, F.lit(1).cast("long")))
    below = below.groupBy("node").agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"), F.sum("child").alias("n_children"))

    parents = nodes.select(F.col("node").alias("__parent"), F.col("owner").alias("parent_conv_id"))
    named = nodes.join(below, "node").join(ends(path.where("last = 1").select("node", "conv_id")), F.col("node") == F.col("name"), "left")
    return named.join(parents, F.col("parent") == F.col("__parent"), "left").select(
        "node", F.col("owner").alias("conv_id"), "depth", "parent", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends", F.lit(_EMPTY)).alias("ends_sha256"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet")).drop("node", "parent")


QUERIES = {"op13_conversation_trie": op13_conversation_trie}
_CRC = """list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(cast(conv_id as varchar), ''), lambda x: ascii(x)::bigint)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)::bigint[]), lambda v, i: xor(v >> 1, 3988292384 * (v & 1))))"""
ORACLES = {
    "op13_conversation_trie": f"""
with t as (
  select conv_id, turn, coalesce(text, '') as x, sha256(concat(octet_length(encode(coalesce(role, ''))), ':', coalesce(role, ''), coalesce(text, ''))) as k
  from conversations where conv_id is not null),
o as (select conv_id, list({{'k': k, 'n': length(x)}} order by turn nulls first, k) as own from t group by conv_id),
h as (select conv_id, own, conv_id - conv_id % 100 as base, xor({_CRC}, 4294967295) % 6 as h from o),
r as (
  select a.conv_id, list_concat(coalesce(b.own[1:a.h], []), case when len(a.own) > a.h then a.own[a.h+1:] else [] end) as seq
  from h a left join o b on b.conv_id = a.base),
p as (
  select conv_id, len(seq) as n, unnest(range(0, len(seq) + 1)) as depth, seq from r),
q as (
  select conv_id, n, depth, sha256(array_to_string(list_transform(seq[1:depth], lambda s: s.k), ' ')) as node,
    case when depth > 0 then sha256(array_to_string(list_transform(seq[1:depth-1], lambda s: s.k), ' ')) end as parent,
    case when depth > 0 then seq[depth].n else 0 end as len from p),
m as (
  select depth, node, any_value(parent) as parent, any_value(len) as len, min(conv_id) as conv_id, count(*) as n_convs, count(*) filter (n = depth) as n_ends,
    sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (n = depth), '')) as ends_sha256
  from q group by depth, node),
a as (
  select up.node, cast(sum((m.n_convs - 1) * m.len) as bigint) as saved_tokens, count(*) filter (m.n_convs = m.n_ends) as n_leaves
  from m join q own on own.node = m.node and own.depth = m.depth and own.conv_id = m.conv_id
  join q up on up.conv_id = own.conv_id and up.depth <= own.depth group by up.node),
c as (select parent, count(*) as k from m where parent is not null group by parent)
select m.conv_id, cast(m.depth as bigint) as depth, f.conv_id as parent_conv_id, m.n_convs, coalesce(c.k, 0) as n_children, a.n_leaves, a.saved_tokens, m.ends_sha256
from m join a on a.node = m.node left join c on c.parent = m.node left join m f on f.node = m.parent
"""
}
