"""Operator 1: benchmark decontamination by size-partitioned MinHash containment search (native).

Texts are lower-cased and cut into words; a text's set is its distinct shingles of five words (fewer
words: one shingle of the whole sequence; no word: none, and it matches nothing).  An item leaks into
a document when at least ``percent`` of the item's set is in the document's set.

Items are partitioned by the power of two of their set size.  Every partition has its own bottom-k
MinHash sketch length: one more than the most shingles that an item of that partition may miss.  So a
document that contains an item holds at least one sketch shingle of it, and the search misses
nothing, however long the document is.  Documents are probed with the sketches only; the pairs found
are verified by exact containment of the shingle strings.

Defined cases: null or blank texts on either side match nothing; an item of fewer words than a shingle
matches only a text that is that item; a null item_id is never reported, nor a null doc_id by ``leaks``
(``clean`` judges every row by its own text); for ``leaks`` rows that share a doc_id are one document with
the shingles of all, and rows that share an item_id are one item; repeated rows count once; very long
texts are searched whole; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plexus.llm.common import keyed, saved, small, words

NGRAM = 5
PERCENT = 80


def _runs(items: Column, n: int, join: Callable[[Column, Column], Column]) -> Column:
    """All runs of ``n`` neighbours of an array, as ``join(array, start)``; a shorter array is one run.

    The array is bound once as a lambda variable: a plain column would be computed anew per element.
    """

    def of(w: Column) -> Column:
        run = F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - n, F.lit(0))), lambda i: join(w, i))
        return F.when(F.size(w) > 0, run)

    return F.get(F.transform(F.array(items), of), F.lit(0))


def shingle_hashes(df: DataFrame, n: int = NGRAM) -> DataFrame:
    """``df(id, text)`` as one row ``(id, s)`` per position: the 64-bit hash of its ``n`` words."""
    hashed = F.transform(words(F.lower("text")), lambda w: F.xxhash64(w))
    run = _runs(hashed, n, lambda w, i: F.xxhash64(*[F.get(w, i + k) for k in range(n)]))
    return df.select("id", F.explode(run).alias("s"))


def shingle_texts(df: DataFrame, n: int = NGRAM) -> DataFrame:
    """``df(id, text)`` as the distinct rows ``(id, g)`` of its shingles as text."""
    run = _runs(words(F.lower("text")), n, lambda w, i: F.array_join(F.slice(w, i + 1, n), " "))
    return df.select("id", F.explode(run).alias("g")).distinct()


def contained(docs: DataFrame, items: DataFrame, percent: int = PERCENT, n: int = NGRAM) -> DataFrame:
    """``(id, item_id, n_shingles, shared, containment)`` of ``docs(id, text)`` and ``items(item_id, text)``."""
    docs = docs.select("id", F.col("text").cast("string").alias("text")).where("id is not null")
    items = items.select(F.col("item_id").alias("id"), F.col("text").cast("string").alias("text")).where("id is not null")

    goal = saved(shingle_texts(items, n).withColumnRenamed("id", "item_id"))
    sizes = goal.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_shingles"))
    hashed = shingle_hashes(items, n).withColumnRenamed("id", "item_id").distinct()
    largest = F.pow(F.lit(2), F.floor(F.log2("n_shingles")) + 1) - 1  # of the size partition
    by_hash = Window.partitionBy("item_id").orderBy(F.xxhash64("s", F.lit(17)), "s")
    sketch = saved(
        hashed.join(sizes, "item_id")
        .withColumn("k", F.floor(largest * (100 - percent) / 100) + 1)
        .withColumn("at", F.row_number().over(by_hash))
        .where("at <= k").select("s", "item_id")
    )
    # one row of each shingle is what documents meet; its items, any number, join the few that hit
    hit = saved(shingle_hashes(docs, n).join(small(saved(sketch.select("s").distinct())), "s").distinct())
    found = saved(hit.join(sketch, "s").select("id", "item_id").distinct())
    held = saved(found.select("id").distinct())
    inside = shingle_texts(docs.join(small(held), "id", "left_semi"), n)
    shared = (
        inside.join(small(goal), "g").join(found, ["id", "item_id"], "left_semi")
        .groupBy("id", "item_id").agg(F.count(F.lit(1)).alias("shared"))
    )
    return (
        shared.join(small(saved(sizes)), "item_id")
        .where(F.col("shared") * 100 >= F.col("n_shingles") * percent)
        .select(
            "id", "item_id", "n_shingles", "shared",
            F.round(F.col("shared") / F.col("n_shingles"), 6).alias("containment"),
        )
    )


def leaks(docs: DataFrame, items: DataFrame, percent: int = PERCENT, n: int = NGRAM) -> DataFrame:
    """``(doc_id, item_id, n_shingles, shared, containment)`` for every item contained in a document.

    ``docs(doc_id, text)``, ``items(item_id, text)``.
    """
    return contained(docs.select(F.col("doc_id").alias("id"), "text"), items, percent, n).withColumnRenamed("id", "doc_id")


def clean(docs: DataFrame, items: DataFrame, percent: int = PERCENT, n: int = NGRAM) -> DataFrame:
    """The rows of ``docs``, all columns, into whose text no item leaks; each row by itself, whatever its doc_id."""
    name = F.concat_ws(":", F.coalesce(F.col("__id").cast("string"), F.lit("null")), F.col("__h").cast("string"))
    rows = keyed(docs).withColumn("__row", name)
    bad = contained(rows.select(F.col("__row").alias("id"), "text"), items, percent, n)
    bad = saved(bad.select(F.col("id").alias("__leak")).distinct())
    return rows.join(small(bad), rows["__row"] == F.col("__leak"), "left_anti").select(*docs.columns)


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op1_benchmark_decontamination": op1_benchmark_decontamination}
_SETS = r"""
  select {id} as id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'),
    lambda x: x <> '') as ws from {table} where {id} is not null"""
_GRAMS = """
  select distinct id, unnest(case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
    else [array_to_string(ws[i:i+4], ' ') for i in range(1, len(ws) - 3)] end) as g from {name}"""
LEAK_SQL = f"""
dw as ({_SETS.format(id="doc_id", table="{docs}")}), iw as ({_SETS.format(id="item_id", table="benchmark")}),
dg as ({_GRAMS.format(name="dw")}), ig as ({_GRAMS.format(name="iw")}),
ic as (select id, count(*) as n from ig group by id),
leak as (select dg.id as doc_id, ig.id as item_id, ic.n as n_shingles, count(*) as shared,
  round(count(*) / cast(ic.n as double), 6) as containment
  from dg join ig on dg.g = ig.g join ic on ic.id = ig.id
  group by dg.id, ig.id, ic.n having count(*) * 100 >= ic.n * 80)"""
ORACLES = {"op1_benchmark_decontamination": f"with {LEAK_SQL.format(docs='documents')} select * from leak"}
