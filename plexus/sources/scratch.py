"""Tables that cut lineage, in the shared folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A fresh folder under ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder serves local mode alone: executors elsewhere would not share it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.gettempdir() + "/plexus-checkpoints"
    return f"{base.rstrip('/')}/plexus-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back; cuts the lineage.

    The tables stay until the folder is cleared: results are lazy and may read them at any time.
    """
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
