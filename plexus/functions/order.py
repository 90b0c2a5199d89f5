"""Global order without a sort in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plexus.sources.scratch import saved


def ordered(df: DataFrame, cols: list[str], value: str | None = None) -> DataFrame:
    """Number all rows in the global order of ``cols`` without bringing them into one task.

    Adds ``__ix`` (0-based, gapless) and, for a long column ``value``, ``__cum`` (its total over all
    rows before).  Rows are range-partitioned and sorted, cut to a table, and per-partition totals
    (one row per partition) give each partition its offset.  A hash of the whole row orders rows that
    are equal on ``cols``, so only equal rows must share a partition.
    """
    own = ["__pid", "__row"]
    tie = F.xxhash64(*[c for c, kind in df.dtypes if "map<" not in kind])
    parts = saved(
        df.withColumn("__tie", tie).repartitionByRange(*[F.col(c) for c in cols], F.col("__tie"))
        .sortWithinPartitions(*cols, "__tie")
        .drop("__tie")
        .withColumn("__pid", F.spark_partition_id())
        .withColumn("__row", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    )
    amount = F.sum(value) if value else F.lit(0).cast("long")
    before = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        parts.groupBy("__pid")
        .agg(F.count(F.lit(1)).alias("__n"), amount.alias("__s"))
        .select(
            "__pid",
            F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n0"),
            F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__s0"),
        )
    )
    out = parts.join(F.broadcast(offsets), "__pid")  # one row per partition
    if value:
        within = Window.partitionBy("__pid").orderBy("__row").rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumn("__cum", F.col("__s0") + F.coalesce(F.sum(value).over(within), F.lit(0)))
    return out.withColumn("__ix", F.col("__n0") + F.col("__row")).drop(*own, "__n0", "__s0")
