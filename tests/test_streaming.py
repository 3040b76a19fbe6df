"""Streams over files, to their end."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.streaming import streams

SCHEMA = "k int, t timestamp, v double"


def source(spark, tmp_path):
    for n in range(3):
        rows = [(k, f"2024-01-01 00:{10 * n + k:02d}:00", float(10 * n + k)) for k in range(4)]
        spark.createDataFrame(rows, "k int, t string, v double").withColumn("t", F.col("t").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), spark.read.parquet(f"{tmp_path}/in")


def test_windows_are_those_of_a_batch(spark, tmp_path):
    stream, batch = source(spark, tmp_path)
    aggs = {"n": F.count(F.lit(1)), "s": F.sum("v")}
    query = streams.windowed(stream, "t", "k", aggs, "10 minutes", "1 hour").writeStream.format("memory").queryName("windows").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    want = streams.windowed(batch, "t", "k", aggs, "10 minutes", "1 hour")
    key = lambda df: sorted((r.k, r.begin, r.n, r.s) for r in df.collect())
    assert key(spark.table("windows")) == key(want) and want.count() == 12


def test_upserts_keep_the_newest(spark, tmp_path):
    stream, _ = source(spark, tmp_path)
    for _ in range(2):
        streams.upsert_stream(stream, f"{tmp_path}/out", "k", "t", f"{tmp_path}/state").awaitTermination(120)
    assert sorted((r.k, r.v) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [(k, 20.0 + k) for k in range(4)]
