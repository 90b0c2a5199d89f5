"""The corpus pipeline: quality, near duplicates, benchmark leaks, mixing, shards.

Each stage is a function ``(spark, docs, sf_dir) -> DataFrame`` over whatever the stage before kept;
all but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexus.llm import decontaminate, jaccard, mix, resample, shard
from plexus.llm.common import keyed, once, saved

#: Least target of a source in the mixture, as a part of its size.
FLOOR = 1.0


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that importance resampling keeps, each judged by its own text; texts without n-grams go."""
    return resample.select(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of texts whose 5-word shingle sets have a Jaccard similarity of 0.8 or more.

    The row with the smallest doc_id stays (null is last).  Unlike texts under one doc_id all stay.
    """
    return jaccard.distinct_rows(docs, n=5, percent=80)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows into whose text no benchmark item leaks."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str, floor: float = FLOOR) -> DataFrame:
    """Every row as often as its source's target asks, in the order of the curriculum.

    With the ``floor`` of 1 targets lie between one and two times a source's size, so every row comes at least
    once; with 0 a source of little weight gives only the first of its rows.  A last pass that would take
    less than half of a row's words leaves it out.  Texts without words are not taken.  Rows equal in doc_id,
    text and source come as copies of one of them.
    """
    rows = keyed(docs).withColumn("__h", F.xxhash64(F.col("text").cast("string"), F.col("source").cast("string")))
    taken = mix.mix(rows, floor=floor, keys=("__id", "__h"))
    whole = F.transform(F.filter("passes", lambda p: p["words"] * 2 >= F.col("size")), lambda p: p["position"])
    places = taken.select(F.col("__id").alias("__i"), F.col("__h").alias("__k"), F.explode(whole).alias("__place"))
    twice = saved(rows.groupBy("__id", "__h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("__id", "__h"))
    if twice.limit(1).count():
        rows = once(rows, twice)
    placed = rows.join(places, (rows["__h"] == F.col("__k")) & rows["__id"].eqNullSafe(F.col("__i")))
    placed = placed.select(*[rows[c] for c in docs.columns], "__place")
    order = ["__place", "doc_id"]
    return placed.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order).drop("__place")


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows and columns with ``shard`` (0 to 23), by rendezvous hashing of doc_id; replaces a column of that name."""
    return shard.assign_shards(docs, "doc_id", [1.0] * shard.SHARDS)


STAGES = [
    ("quality classifier", quality),
    ("n-gram jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_leaks),
    ("mixing sources to target weights", mixture),
    ("sharding", shards),
]

#: The quality classifier is a trained model: no SQL gives these rows (tests hold each stage to brute force).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
