"""Windowed aggregates with late data, sessions, and upserts of a stream into a stored table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.order import names
from ..sources.files import archive


def windowed(df: DataFrame, time: str, key, aggs: dict[str, Column], width: str, late: str, slide: str | None = None) -> DataFrame:
    """Aggregates by key and time window; rows later than ``late`` behind the newest are left out, and state ends there."""
    grouped = df.withWatermark(time, late).groupBy(F.window(time, width, slide), *names(key))
    return grouped.agg(*[c.alias(n) for n, c in aggs.items()]).withColumns({"begin": F.col("window.start"), "end": F.col("window.end")}).drop("window")


def sessions(df: DataFrame, time: str, key, aggs: dict[str, Column], gap: str, late: str) -> DataFrame:
    """Aggregates by key and session; a session ends when nothing comes for ``gap``."""
    grouped = df.withWatermark(time, late).groupBy(F.session_window(time, gap), *names(key))
    return grouped.agg(*[c.alias(n) for n, c in aggs.items()]).withColumns({"begin": F.col("session_window.start"), "end": F.col("session_window.end")}).drop("session_window")


def upsert_stream(df: DataFrame, path: str, keys, order: str, checkpoint: str) -> StreamingQuery:
    """Each batch's newest row of a key (by ``order``) replaces the stored one; run again, a batch changes nothing."""
    keys = names(keys)

    def store(batch: DataFrame, _: int) -> None:
        rest = [c for c in batch.columns if c not in keys]
        newest = batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__r")).select(*keys, *[F.col(f"__r.`{c}`").alias(c) for c in rest])
        archive(batch.sparkSession, newest, path, keys)

    return df.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
