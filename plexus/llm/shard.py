"""Operator 6: sharding by weighted rendezvous hashing (native).

Every shard scores a record by ``-ln(u) / weight`` with ``u`` in (0, 1) hashed from the record key and
the shard number; the least score wins.  Only the key and the shard list decide, so a shard that
joins takes rows from all others and moves none between them.  The scores are plain expressions:
assigning needs no shuffle.  Slots number the rows of a shard in key order through a global range
sort, so a hot shard is many sorted partitions, not one task.

Defined cases: a null key hashes as the word ``null`` and such rows share a shard; null or empty text
has size 8 and checksum 0; rows equal in key, checksum and size get neighbouring slots in any order;
an empty table gives an empty result; other columns are ignored by the query and kept by
``assign_shards``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plexus.llm.common import ordered, saved

SHARDS = 24


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard (0-based) of ``key`` among shards of the given positive weights."""
    key = F.coalesce(key.cast("string"), F.lit("null"))

    def score(i: int, weight: float) -> Column:
        unit = (F.shiftrightunsigned(F.xxhash64(key, F.lit(i)), 11).cast("double") + 0.5) / float(1 << 53)
        return F.struct((-F.log(unit) / F.lit(float(weight))).alias("score"), F.lit(i).alias("shard"))

    scores = [score(i, w) for i, w in enumerate(weights)]
    return (F.least(*scores) if len(scores) > 1 else scores[0])["shard"]


def assign_shards(df: DataFrame, key: str, weights: Sequence[float], name: str = "shard") -> DataFrame:
    """``df`` with a column ``name`` holding each row's shard; no shuffle."""
    return df.withColumn(name, rendezvous(F.col(key), weights))


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)`` for every row of ``docs``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    rows = assign_shards(rows, "doc_id", [1.0] * shards)
    rows = assign_shards(rows, "doc_id", [1.0] * (shards + 1), "grown_shard")
    rows = saved(ordered(rows, ["shard", "doc_id", "text_crc32", "size"]))
    first = rows.groupBy("shard").agg(F.min("__ix").alias("__first"))  # one row per shard
    return rows.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("__ix") - F.col("__first")).alias("slot"), "grown_shard",
    )


def op6_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op6_rendezvous_sharding": op6_rendezvous_sharding}
ORACLES: dict = {}
