"""Operator 8: chat formatting by quotation linking.

A message's lines carry a quote level, the number of leading ``>`` marks.  Lines of level 0 are its own
text (an attribution line such as ``On ... wrote:`` right before a quote goes).  Neighbouring lines of one
level, without a blank one between them, are a passage: its normal form (marks dropped, white space folded,
lines joined, lower case) is hashed, so a quote that was wrapped anew still meets its original.  Quoted
passages of any level are joined to the passages and lines that messages wrote themselves; the lines of a
quoted passage that is nobody's are looked up one by one.  Within a conversation the first message before
this one that wrote the words is the original, of any length; else the first other conversation with them,
if they are ``LONG`` words or more.  A message answers the message with most of its quoted lines, those of
its conversation first, then the outermost level, then the earlier message.

A conversation is laid out thread by thread: a thread is a message that answers none in its
conversation with all that answer it, directly or not; threads follow their first turns, messages
their turns, so an answer never precedes what it answers.  The place of every message comes from a
global range sort and the output has at most ``SEGMENT`` messages in a row: a conversation may be any
part of the table.

Defined cases: null or blank text gives an empty message; a null conv_id is a conversation of its own
and a null turn sorts first; rows that share conv_id and turn keep separate messages in text order and
are one message for linking; quotes of unknown passages are dropped and counted; very long texts are
parsed whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plexus.llm.common import ordered, saved

SEGMENT = 256
#: Words that a passage must have to be linked to another conversation.
LONG = 4
_MARKS = r"^[ \t]*(?:>[ \t]?)+"
_QUOTES = r"(?:^|\n)[ \t]*>"
_CREDIT = r"^\s*on\b.*\bwrote:\s*$"
_marks, _credit, _space = re.compile(_MARKS), re.compile(_CREDIT, re.IGNORECASE | re.ASCII), re.compile(r"[\x20\x09-\x0D]+")


def read_lines(text: str | None) -> list[tuple[int, str]]:
    """``(level, normal form)`` of each line; attribution lines have level -1."""
    out, raw = [], (text or "").split("\n")
    for line in raw:
        m = _marks.match(line)
        out.append((m.group().count(">") if m else 0, _space.sub(" ", line[m.end() if m else 0 :]).strip(" ").lower()))
    for i in range(len(raw) - 1):
        if out[i][0] == 0 < out[i + 1][0] and _credit.match(raw[i]):
            out[i] = (-1, out[i][1])
    return out


def passages(lines: list[tuple[int, str]]) -> list[tuple[int, list[str]]]:
    """Runs of lines of one level with words: ``(level, lines)``."""
    out, before = [], None
    for level, normal in lines:
        if normal and level >= 0:
            if before == level:
                out[-1][1].append(normal)
            else:
                out.append((level, [normal]))
        before = level if normal else None
    return out


def _key(normal: str) -> int:
    return int.from_bytes(blake2b(normal.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _quoted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for conv, turn, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            for level, lines in passages(read_lines(text)):
                if level > 0:
                    whole = " ".join(lines)
                    passage = _key(whole)
                    rows.append((conv, turn, passage, passage, True, level, len(lines), whole.count(" ") + 1))
                    if len(lines) > 1:
                        rows += [(conv, turn, passage, _key(x), False, level, 1, x.count(" ") + 1) for x in lines]
        names = ["conv_id", "turn", "passage", "hash", "whole", "level", "k", "words"]
        kinds = [pa.int64()] * 4 + [pa.bool_()] + [pa.int64()] * 3
        columns = list(zip(*rows, strict=True)) or [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for conv, turn, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            own = [lines for level, lines in passages(read_lines(text)) if level == 0]
            units = {" ".join(lines) for lines in own} | {x for lines in own for x in lines}
            rows += [(conv, turn, _key(x)) for x in units]
        columns = list(zip(*rows, strict=True)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["conv_id", "turn", "hash"])


def link(messages: DataFrame) -> DataFrame:
    """``(conv_id, turn, parent_conv, parent_turn, linked)`` for messages that quote known passages."""
    rows = messages.where("conv_id is not null and turn is not null").select("conv_id", "turn", "text")
    units = rows.where(F.col("text").rlike(_QUOTES)).mapInArrow(
        _quoted, "conv_id long, turn long, passage long, hash long, whole boolean, level long, k long, words long")
    quoted = units.groupBy("conv_id", "turn", "passage", "hash", "whole").agg(F.min("level").alias("level"), F.sum("k").alias("k"), F.max("words").alias("words"))
    quoted = saved(quoted)  # few beside the lines written
    written = rows.mapInArrow(_written, "conv_id long, turn long, hash long").join(quoted.select("hash").distinct(), "hash", "left_semi")
    # an original: the first turn of each conversation with the words, and the first two conversations of all
    near = saved(written.groupBy("conv_id", "hash").agg(F.min("turn").alias("near_turn")))
    far = near.groupBy("hash").agg(F.min(F.struct("conv_id", "near_turn")).alias("far"))
    next_far = near.join(far, "hash").where("conv_id <> far.conv_id").groupBy("hash").agg(F.min(F.struct("conv_id", "near_turn")).alias("next"))
    other = F.when(F.col("far.conv_id") != F.col("conv_id"), F.col("far")).otherwise(F.col("next"))
    found = (
        quoted.join(near, ["conv_id", "hash"], "left").join(far, "hash", "left").join(next_far, "hash", "left")
        .withColumn("own", F.coalesce(F.col("near_turn") < F.col("turn"), F.lit(False)))
        .withColumn("other", F.when(F.col("words") >= LONG, other))
        .withColumn("parent_conv", F.when(F.col("own"), F.col("conv_id")).otherwise(F.col("other.conv_id")))
        .withColumn("parent_turn", F.when(F.col("own"), F.col("near_turn")).otherwise(F.col("other.near_turn")))
        .where("parent_conv is not null").select("conv_id", "turn", "passage", "whole", "level", "k", "parent_conv", "parent_turn")
    )
    found = saved(found)
    entire = found.where("whole").select("conv_id", "turn", "passage")
    found = found.where("whole").unionByName(found.where("not whole").join(entire, ["conv_id", "turn", "passage"], "left_anti").select(*found.columns))
    votes = found.groupBy("conv_id", "turn", "parent_conv", "parent_turn").agg(F.sum("k").alias("n"), F.min("level").alias("level"))
    best = F.struct(
        (F.col("parent_conv") == F.col("conv_id")).cast("int"), -F.col("level"), "n", -F.col("parent_conv"), -F.col("parent_turn")
    )
    return votes.groupBy("conv_id", "turn").agg(
        F.max_by(F.struct("parent_conv", "parent_turn"), best).alias("p"), F.sum("n").alias("linked")
    ).select("conv_id", "turn", "p.parent_conv", "p.parent_turn", "linked")


def threads(links: DataFrame) -> DataFrame:
    """``(conv_id, turn, root)``: the first message of each linked message's thread, by pointer doubling."""
    now = saved(
        links.where("parent_conv = conv_id").select("conv_id", "turn", F.col("parent_turn").alias("root"))
    )
    for _ in range(40):  # turns decrease along links, so 2^40 links are no limit
        up = now.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("higher"))
        step = saved(now.join(up, ["conv_id", "root"], "left"))
        moved = step.where("higher is not null").limit(1).count()
        now = step.select("conv_id", "turn", F.coalesce("higher", "root").alias("root"))
        if not moved:
            break
    return now


def own_text(text: Column) -> tuple[Column, Column]:
    """A message's own lines as text, and how many quoted lines with words it has."""
    level = lambda x: F.length(F.regexp_replace(F.regexp_extract(x, _MARKS, 0), "[^>]", ""))
    raw = F.transform(F.split(text, "\n"), lambda x: F.struct(level(x).alias("level"), x.alias("text")))

    def mine(w: Column) -> Column:
        def credit(x: Column, i: Column) -> Column:
            return (F.get(w, i + 1)["level"] > 0) & x["text"].rlike(f"(?i){_CREDIT}")

        return F.array_join(F.transform(F.filter(w, lambda x, i: (x["level"] == 0) & ~F.coalesce(credit(x, i), F.lit(False))), lambda x: x["text"]), "\n")

    has = F.coalesce(text.rlike(_QUOTES), F.lit(False))
    own = F.when(has, F.get(F.transform(F.array(raw), mine), F.lit(0))).otherwise(F.coalesce(text, F.lit("")))
    quoted = F.filter(raw, lambda x: (x["level"] > 0) & F.regexp_replace(x["text"], _MARKS, "").rlike(r"[^\x20\x09-\x0D]"))
    return F.btrim(own, F.lit(" \t\n\r")), F.when(has, F.size(quoted)).otherwise(0).cast("long")


def conversations(messages: DataFrame) -> DataFrame:
    """One row per message: ``conv_id, turn, role, content, n_quoted, linked, parent_conv, parent_turn, place``."""
    rows = messages.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"),
    )
    links = saved(link(rows))
    roots = threads(links)
    content, n_quoted = own_text(F.col("text"))
    rows = rows.select("conv_id", "turn", "role", content.alias("content"), n_quoted.alias("n_quoted"))
    rows = rows.join(links, ["conv_id", "turn"], "left").join(roots, ["conv_id", "turn"], "left")
    rows = rows.withColumn("linked", F.coalesce("linked", F.lit(0))).withColumn("root", F.coalesce("root", "turn"))
    key = ["conv_id", "root", "turn"]
    at = saved(ordered(rows.withColumn("__h", F.xxhash64("role", "content")), [*key, "__h"]).drop("__h"))
    first = at.groupBy("conv_id").agg(F.min("__ix").alias("__first"))
    conv = F.col("conv_id")
    joined = at.join(first.withColumnRenamed("conv_id", "__conv"), conv.eqNullSafe(F.col("__conv")))
    return joined.withColumn("place", F.col("__ix") - F.col("__first")).drop("__ix", "__first", "__conv", "root")


def formatted(messages: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Reply-ordered chats: ``(conv_id, segment, n_messages, n_quoted, n_linked, chat, parents)``.

    ``chat`` is JSON; so is ``parents``, which names for each message with a known original the message it answers.
    """
    rows = conversations(messages).withColumn("segment", F.floor(F.col("place") / segment).cast("long"))
    turn = F.struct("place", F.struct("role", "content").alias("m"))
    parent = F.when(F.col("parent_conv").isNotNull(), F.struct("place", F.struct("place", "parent_conv", "parent_turn").alias("m")))
    as_json = lambda x: F.to_json(F.transform(F.array_sort(F.collect_list(x)), lambda y: y["m"]))
    return rows.groupBy("conv_id", "segment").agg(
        F.count(F.lit(1)).alias("n_messages"), F.sum("n_quoted").alias("n_quoted"), F.sum("linked").alias("n_linked"),
        as_json(turn).alias("chat"), as_json(parent).alias("parents"),
    )


def op8_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatted(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {"op8_quotation_linking": op8_quotation_linking}
ORACLES = {
    # (conv_id, turn) tells messages apart in the tables this runs on
    "op8_quotation_linking": r"""
with recursive m as (select row_number() over () as rid, conv_id, turn, role, string_split(coalesce(text, ''), chr(10)) as ls from conversations),
x as (select *, unnest(range(1, len(ls) + 1)) as i from m),
y as (select rid, conv_id, turn, role, i, ls[i] as t, length(regexp_replace(regexp_extract(ls[i], '^[ \t]*(?:>[ \t]?)+'), '[^>]', '', 'g')) as level,
  lower(trim(regexp_replace(regexp_replace(ls[i], '^[ \t]*(?:>[ \t]?)+', ''), '[\x20\x09-\x0D]+', ' ', 'g'))) as normal from x),
l as (select *, case when level = 0 and lead(level) over (partition by rid order by i) > 0 and regexp_matches(t, '(?i)^\s*on\b.*\bwrote:\s*$')
  then -1 else level end as lv from y),
b as (select *, case when normal <> '' and lag(normal) over (partition by rid order by i) <> '' and lag(lv) over (partition by rid order by i) = lv then 0 else 1 end as fresh from l),
r as (select *, sum(fresh) over (partition by rid order by i) as run from b),
p as (select rid, conv_id, turn, run, lv, string_agg(normal, ' ' order by i) as normal, count(*) as k from r
  where normal <> '' and lv >= 0 and conv_id is not null and turn is not null group by rid, conv_id, turn, run, lv),
u as (select rid, conv_id, turn, lv, normal as passage, normal, true as whole, k from p
  union all select p.rid, p.conv_id, p.turn, p.lv, p.normal, r.normal, false, 1 from p join r on r.rid = p.rid and r.run = p.run and r.normal <> '' where p.k > 1),
quoted as (select conv_id, turn, passage, normal, whole, min(lv) as lv, sum(k) as k, length(normal) - length(replace(normal, ' ', '')) + 1 as words from u where lv > 0 group by conv_id, turn, passage, normal, whole),
near as (select conv_id, normal, min(turn) as near_turn from u where lv = 0 and normal in (select normal from quoted) group by conv_id, normal),
o as (select q.conv_id, q.normal, n.conv_id as c, n.near_turn as t, row_number() over (partition by q.conv_id, q.normal order by n.conv_id, n.near_turn) as place
  from (select distinct conv_id, normal from quoted where words >= 4) q join near n on n.normal = q.normal and n.conv_id <> q.conv_id),
found as (select q.*, case when n.near_turn < q.turn then q.conv_id else o.c end as parent_conv, case when n.near_turn < q.turn then n.near_turn else o.t end as parent_turn
  from quoted q left join near n on n.conv_id = q.conv_id and n.normal = q.normal left join o on o.conv_id = q.conv_id and o.normal = q.normal and o.place = 1),
kept as (select * from found f where parent_conv is not null and (whole or not exists (select 1 from found g
  where g.whole and g.parent_conv is not null and g.conv_id = f.conv_id and g.turn = f.turn and g.passage = f.passage))),
votes as (select conv_id, turn, parent_conv, parent_turn, sum(k) as n, min(lv) as lv from kept group by conv_id, turn, parent_conv, parent_turn),
links as (select conv_id, turn, parent_conv, parent_turn, sum(n) over (partition by conv_id, turn) as linked, row_number() over (partition by conv_id, turn
  order by cast(parent_conv = conv_id as int) desc, lv, n desc, parent_conv, parent_turn) as r from votes),
up as (select conv_id, turn, parent_turn from links where r = 1 and parent_conv = conv_id),
walk(conv_id, turn, root) as (select conv_id, turn, parent_turn from up union all select w.conv_id, w.turn, u.parent_turn from walk w join up u on u.conv_id = w.conv_id and u.turn = w.root),
roots as (select conv_id, turn, min(root) as root from walk group by conv_id, turn),
msg as (select rid, any_value(conv_id) as conv_id, any_value(turn) as turn, any_value(role) as role,
  trim(coalesce(string_agg(t, chr(10) order by i) filter (where lv = 0), ''), ' ' || chr(9) || chr(10) || chr(13)) as content,
  count(*) filter (where lv > 0 and normal <> '') as n_quoted from l group by rid),
placed as (select msg.*, coalesce(k.linked, 0) as linked, k.parent_conv, k.parent_turn, row_number() over (partition by msg.conv_id order by coalesce(r.root, msg.turn), msg.turn) - 1 as place
  from msg left join (select * from links where r = 1) k on k.conv_id = msg.conv_id and k.turn = msg.turn left join roots r on r.conv_id = msg.conv_id and r.turn = msg.turn)
select conv_id, place // 256 as segment, count(*) as n_messages, cast(sum(n_quoted) as bigint) as n_quoted, cast(sum(linked) as bigint) as n_linked,
  '[' || string_agg(cast(to_json(struct_pack(role := role, content := content)) as varchar), ',' order by place) || ']' as chat,
  '[' || coalesce(string_agg(cast(to_json(struct_pack(place := place, parent_conv := parent_conv, parent_turn := parent_turn)) as varchar), ',' order by place) filter (where parent_conv is not null), '') || ']' as parents
from placed group by conv_id, place // 256
""",
}
