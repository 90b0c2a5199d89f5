"""Operator 2: mixing sources to target weights along a time-varying curriculum.

1. Every source asks for ``target`` words: its weight's part of the budget, at most ``cap`` times its
   size, the excess shared among the others by weight until none is above (water filling: the level
   rises until no source passes its cap).
2. The documents of a source form one stream in hash order, repeated pass after pass, until the
   target is met; the document at the end gives only its first words, so the taken words meet the
   target exactly.  Offsets come from a global range sort: a source may be any part of the corpus.
3. A source's weight changes over the training time ``t`` in [0, 1] along a piecewise linear schedule.
   Its integral up to ``t`` is the part of the target asked for by then; inverting it (a quadratic
   within a segment) at a document's offset gives the position.  Output is range-sorted by position.

Defined cases: null or blank text has size 0 and is never taken; a null source is one source, sorted
last; a null doc_id is taken like others, and rows that share one are rows of their own; rows equal in
all columns are told apart by nothing and may swap; an empty table gives an empty result; a very long
text is one row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plexus.llm.common import SPACES, ordered, saved

#: Weight schedules by the place of a source in code point order (they repeat): knots (t, factor).
RISE = ((0.0, 0.5), (1.0, 1.5))
FLAT = ((0.0, 1.0), (1.0, 1.0))
PEAK = ((0.0, 0.4), (0.5, 1.6), (1.0, 0.4))
SCHEDULES = (FLAT, RISE, PEAK)
WEIGHTS = (3, 1, 2)


def n_words(text: Column) -> Column:
    """Number of words; null gives 0."""
    flat = F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")
    flat = F.btrim(flat)
    return F.when(flat == "", 0).otherwise(F.length(flat) - F.length(F.replace(flat, F.lit(" "))) + 1).cast("long")


def position(part: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The time by which the schedule has asked for ``part`` (0 to 1) of its whole integral."""
    total = sum((t2 - t1) * (y1 + y2) / 2 for (t1, y1), (t2, y2) in zip(knots, knots[1:], strict=False))
    done, out = 0.0, None
    for (t1, y1), (t2, y2) in zip(knots, knots[1:], strict=False):
        area, slope = (t2 - t1) * (y1 + y2) / 2, (y2 - y1) / (t2 - t1)
        need = part * F.lit(total) - F.lit(done)
        root = F.sqrt(F.greatest(F.lit(y1 * y1) + need * F.lit(2 * slope), F.lit(0.0)))
        at = F.lit(t1) + need * F.lit(2.0) / (F.lit(y1) + root)
        done += area
        out = at if out is None else F.when(part * F.lit(total) <= F.lit(done - area), out).otherwise(at)
    return F.least(F.greatest(out, F.lit(0.0)), F.lit(1.0))


def targets(sizes: DataFrame, weights: Sequence[float], budget: float, cap: float, floor: float = 0.0) -> DataFrame:
    """``sizes(source, source_size)``, a row per source, with ``place``, ``weight`` and ``target``.

    ``target = floor * size + least((cap - floor) * size, level * weight)`` with the level at which the
    targets sum to ``budget`` times all sizes.  Each step of the level is one combinable sum over the
    sources; places come from a global range sort, so there may be any number of sources.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    df = ordered(sizes.withColumn("__none", F.col("source").isNull()), ["__none", "source"]).withColumnRenamed("__ix", "place")
    df = saved(df.withColumn("weight", w).withColumn("room", F.col("source_size") * (cap - floor)).drop("__none"))
    full, level = F.col("room") <= F.lit(-1.0), None
    while True:
        sums = df.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(full, F.col("room")).otherwise(0.0)).alias("full"),
            F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        if not sums["open"]:  # every source is at its cap
            share = F.col("room")
            break
        now = (sums["all"] * (budget - floor) - sums["full"]) / sums["open"]
        share = F.least(F.col("room"), F.lit(now) * F.col("weight"))
        if now == level:
            break
        level, full = now, F.col("room") / F.col("weight") <= F.lit(now)
    return df.withColumn("target", F.col("source_size") * floor + share).select(
        "source", "source_size", "place", "weight", "target"
    )


def mix(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = 1.5, cap: float = 2.0,
    schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES, floor: float = 0.0, keys: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """The ``keys`` of every row with ``source, size, source_size, target, taken, passes``.

    ``passes`` is an array of ``(position, words)``, one for each time that the mix takes the document.
    """
    rows = saved(docs.select(*keys, F.col("source").cast("string").alias("source"), n_words(F.col("text").cast("string")).alias("size")))
    share = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, budget, cap, floor)
    share = saved(share)
    order = F.md5(F.coalesce(F.col(keys[0]).cast("string"), F.lit("")))
    run = ordered(rows.withColumn("__md5", order), ["source", "__md5", *keys, "size"], "size")
    run = saved(run.drop("__md5"))
    base = run.groupBy("source").agg(F.min("__cum").alias("__base"))
    share = saved(share.join(base, share["source"].eqNullSafe(base["source"])).drop(base["source"]))
    run = run.withColumnRenamed("source", "__src")
    run = run.join(F.broadcast(share) if share.count() <= 100_000 else share, F.col("__src").eqNullSafe(F.col("source")))
    start, goal = F.col("__cum") - F.col("__base"), F.floor(F.col("target") + 0.5)

    def one(k: int) -> Column:
        at = start + F.col("source_size") * k
        took = F.greatest(F.least(goal - at, F.col("size")), F.lit(0)).cast("long")
        part = at / F.greatest(F.col("target"), F.lit(1.0))
        time = F.lit(None).cast("double")
        for i, knots in enumerate(schedules):
            time = F.when(F.col("place") % len(schedules) == i, position(part, knots)).otherwise(time)
        return F.struct(time.alias("position"), took.alias("words"))

    passes = F.filter(F.array(*[one(k) for k in range(int(-(-cap // 1)))]), lambda p: p["words"] > 0)
    run = run.withColumn("passes", passes)
    taken = F.aggregate("passes", F.lit(0).cast("long"), lambda a, p: a + p["words"])
    return run.select(*keys, "source", "size", "source_size", "target", taken.alias("taken"), "passes")


def op2_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    at = [F.round(F.get("passes", F.lit(k))["position"], 6).alias(name) for k, name in enumerate(("position", "position_2"))]
    out = mixed.select("doc_id", "size", "source_size", "target", "taken", *at)
    return out.repartitionByRange(F.col("position"), F.col("doc_id")).sortWithinPartitions("position", "doc_id")


QUERIES = {"op2_curriculum_mix": op2_curriculum_mix}


def _position_sql(part: str, knots) -> str:
    total = sum((t2 - t1) * (y1 + y2) / 2 for (t1, y1), (t2, y2) in zip(knots, knots[1:], strict=False))
    done, cases, at = 0.0, "", ""
    for (t1, y1), (t2, y2) in zip(knots, knots[1:], strict=False):
        need = f"({part} * {total!r}::double - {done!r}::double)"
        slope = (y2 - y1) / (t2 - t1)
        at = f"({t1!r}::double + {need} * 2.0::double / ({y1!r}::double + sqrt(greatest({y1 * y1!r}::double + {need} * {2 * slope!r}::double, 0.0::double))))"
        done += (t2 - t1) * (y1 + y2) / 2
        cases += f" when {part} * {total!r}::double <= {done!r}::double then {at}"
    return f"least(greatest(case {cases} else {at} end, 0.0::double), 1.0::double)"


ORACLES = {
    "op2_curriculum_mix": r"""
with d as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
    md5(cast(doc_id as varchar)) as h from documents),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
p as (select *, row_number() over (order by source nulls last) - 1 as place from s),
w as (select *, cast([3, 1, 2][place % 3 + 1] as double) as weight, cast(source_size * 2.0 as double) as room from p),
l as (select *, (cast(sum(source_size) over () as double) * 1.5::double - coalesce(sum(room) over (order by room / weight, place
    rows between unbounded preceding and 1 preceding), 0::double))
  / sum(weight) over (order by room / weight, place rows between current row and unbounded following) as level from w),
t as (select *, least(room, coalesce(max(case when room / weight > level then level end) over () * weight, room)) as target from l),
c as (select doc_id, size, source_size, target, place,
  coalesce(sum(size) over (partition by d.source order by h, doc_id, size rows between unbounded preceding and 1 preceding), 0) as a
  from d join t on d.source is not distinct from t.source),
k as (select *, greatest(least(floor(target + 0.5) - a, size), 0) as k0,
  greatest(least(floor(target + 0.5) - a - source_size, size), 0) as k1 from c)
select doc_id, size, source_size, target, cast(k0 + k1 as bigint) as taken,
  round(case when k0 > 0 then case place % 3 when 0 then {a} when 1 then {b} else {c} end end, 6) as position,
  round(case when k1 > 0 then case place % 3 when 0 then {d} when 1 then {e} else {f} end end, 6) as position_2 from k
""".replace("{a}", _position_sql("(a / greatest(target, 1.0::double))", FLAT))
    .replace("{b}", _position_sql("(a / greatest(target, 1.0::double))", RISE))
    .replace("{c}", _position_sql("(a / greatest(target, 1.0::double))", PEAK))
    .replace("{d}", _position_sql("((a + source_size) / greatest(target, 1.0::double))", FLAT))
    .replace("{e}", _position_sql("((a + source_size) / greatest(target, 1.0::double))", RISE))
    .replace("{f}", _position_sql("((a + source_size) / greatest(target, 1.0::double))", PEAK))
}
