"""Readers, writers and the incremental index."""

from __future__ import annotations

from plexus.sources import files
from plexus.streaming import cooccurrence


def test_tables_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", ["x", "y"], 1), ("b", [], 2), ("c", None, None)], "id string, tags array<string>, n int")
    files.write_tsv(df, str(tmp_path / "t"))
    back = files.read_tsv(spark, str(tmp_path / "t"), arrays=("tags",))
    assert {r["id"]: (r["tags"], r["n"]) for r in back.collect()} == {"a": (["x", "y"], "1"), "b": ([], "2"), "c": ([], None)}
    files.write_jsonl(df, str(tmp_path / "j"))
    assert files.read_jsonl(spark, str(tmp_path / "j"), df.schema).count() == 3


def test_stream_counts_each_event_once(spark, tmp_path):
    src, rows = str(tmp_path / "in"), [(1, "2024-01-01 00:00:00", 7, "click"), (2, "2024-01-01 00:10:00", 7, "view"), (2, "2024-01-01 00:10:00", 7, "view")]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string")
    df = df.withColumn("ts", df["ts"].cast("timestamp"))
    df.write.parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    q = cooccurrence.windowed_counts(stream, "1 hour", "1 day").writeStream.format("memory").queryName("counts").outputMode("complete")
    q = q.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    assert q.awaitTermination(120)
    assert {r["event_type"]: r["n"] for r in spark.table("counts").collect()} == {"click": 1, "view": 1}
