"""Pieces shared by the corpus operators: scratch tables, global order, row keys, connected components.

Everything here is lazy DataFrame work apart from the writes that cut lineage.  Cut tables go to
the folder the cluster names in ``spark.checkpoint.dir`` so that a lost executor loses nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plexus.functions.components import components
from plexus.functions.order import ordered
from plexus.sources.scratch import saved, scratch

__all__ = ["components", "keyed", "once", "ordered", "saved", "scratch", "small", "without", "words"]

#: Words everywhere in this package: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
#: A table is broadcast only if it measures at most this many bytes (as rows in memory).
BROADCAST_BYTES = 32 << 20


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its measured size allows it; else as it is, for a shuffled join.

    Pass a saved table.  Columns of fixed width need a count (Parquet footers only); the lengths of
    strings and arrays are summed.
    """
    wide = []
    for name, kind in df.dtypes:
        if kind == "string":
            wide.append(F.octet_length(name))
        elif kind in ("array<bigint>", "array<double>"):
            wide.append(F.size(name) * 8)
        elif kind.startswith(("array", "map", "struct")):
            raise TypeError(f"{name}: the size of a {kind} is not measured")
    fixed = 48 + 16 * len(df.columns)
    if not wide:
        rows = most // fixed
        return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
    size = sum((F.coalesce(w, F.lit(0)) for w in wide), F.lit(fixed).cast("long"))
    return F.broadcast(df) if (df.agg(F.sum(size).alias("n")).first()["n"] or 0) <= most else df


def words(text: Column) -> Column:
    """Array of the words of ``text``; null and blank texts give an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``__id`` and ``__h``, a hash of the text: rows equal in both hold one text under one id."""
    return docs.withColumns({"__id": F.col(id_col).cast("long"), "__h": F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))})


def without(docs: DataFrame, out: DataFrame) -> DataFrame:
    """The rows of ``docs`` (``keyed``) whose ``__id, __h`` are not in ``out``; null ids are equal."""
    gone = out.select(F.col("__id").alias("__i"), F.col("__h").alias("__k"))
    return docs.join(gone, (docs["__h"] == F.col("__k")) & docs["__id"].eqNullSafe(F.col("__i")), "left_anti")


def once(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """``docs`` (``keyed``) with one row of each ``repeated(__id, __h)``: the one whose columns hash least."""
    same = repeated.select(F.col("__id").alias("__i"), F.col("__h").alias("__k"))
    match = (docs["__h"] == F.col("__k")) & docs["__id"].eqNullSafe(F.col("__i"))
    one = docs.join(same, match, "left_semi").groupBy("__id", "__h").agg(
        F.min_by(F.struct(*docs.columns), F.xxhash64(*[c for c, kind in docs.dtypes if "map<" not in kind])).alias("row"))
    return without(docs, repeated).unionByName(one.select("row.*"))
