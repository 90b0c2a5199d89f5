"""Files: TSV with a header file of its own, JSON lines, XML, and Parquet by predicate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ARRAY_SEPARATOR = "ǂ"


def write_tsv(df: DataFrame, path: str, separator: str = ARRAY_SEPARATOR) -> None:
    """Rows under ``path/data`` and one header line under ``path/header``; arrays are delimited text."""
    kinds = dict(df.dtypes)
    flat = df.select(*[F.array_join(c, separator).alias(c) if kinds[c].startswith("array") else F.col(c) for c in df.columns])
    flat.write.option("sep", "\t").option("emptyValue", "").csv(f"{path}/data")
    df.sparkSession.createDataFrame([("\t".join(df.columns),)], "value string").coalesce(1).write.text(f"{path}/header")


def read_tsv(spark: SparkSession, path: str, arrays: Sequence[str] = (), separator: str = ARRAY_SEPARATOR) -> DataFrame:
    """The rows of ``write_tsv`` as text, ``arrays`` split again (no text gives an empty array)."""
    names = spark.read.text(f"{path}/header").first()["value"].split("\t")
    schema = ", ".join(f"`{n}` string" for n in names)
    df = spark.read.option("sep", "\t").schema(schema).csv(f"{path}/data")
    for c in arrays:
        df = df.withColumn(c, F.when(F.coalesce(F.col(c), F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(c, separator)))
    return df


def write_jsonl(df: DataFrame, path: str, gzip: bool = True) -> None:
    df.write.option("compression", "gzip" if gzip else "none").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines, gzipped or not; the schema is given, so nothing is read to infer it."""
    return spark.read.schema(schema).json(path)


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: StructType | str) -> DataFrame:
    return spark.read.option("rowTag", row_tag).schema(schema).xml(path)


def write_edges(edges: DataFrame, path: str) -> None:
    """Edges by predicate, so that a query edge's predicates prune partitions."""
    edges.repartition("predicate", F.pmod(F.xxhash64("subject"), F.lit(64))).write.partitionBy("predicate").parquet(path)


def read_edges(spark: SparkSession, path: str, predicates: Sequence[str] | None = None) -> DataFrame:
    edges = spark.read.parquet(path)
    return edges.where(F.col("predicate").isin(list(predicates))) if predicates else edges
