"""Windowed aggregations over event streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling_counts(events: DataFrame, keys: Sequence[str], ts: str, size: str, delay: str) -> DataFrame:
    return (
        events.withWatermark(ts, delay)
        .groupBy(*keys, F.window(ts, size).alias("w"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(*keys, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n")
    )


def sliding_counts(events: DataFrame, keys: Sequence[str], ts: str, size: str, slide: str, delay: str) -> DataFrame:
    """Panes of one slide are counted first; only panes are expanded into windows."""
    panes = (
        events.withWatermark(ts, delay)
        .groupBy(*keys, F.window(ts, slide).alias("pane"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return (
        panes.groupBy(*keys, F.window(F.window_time("pane"), size, slide).alias("w"))
        .agg(F.sum("n").alias("n"))
        .select(*keys, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n")
    )


def session_counts(events: DataFrame, keys: Sequence[str], ts: str, gap: str, delay: str) -> DataFrame:
    return (
        events.withWatermark(ts, delay)
        .groupBy(*keys, F.session_window(ts, gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(*keys, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
    )


def cross_stream_daily(links: DataFrame, meetings: DataFrame, delay: str) -> DataFrame:
    """Both streams counted per (user, day) in one stateful aggregation.

    The union keeps counts as state instead of the rows a stream-stream join would
    buffer; pairings are the product of the counts.
    """
    a = links.select("user_id", "ts", F.lit(1).alias("l"), F.lit(0).alias("m"))
    b = meetings.select("user_id", F.col("start_at").alias("ts"), F.lit(0).alias("l"), F.lit(1).alias("m"))
    return (
        a.union(b)
        .withWatermark("ts", delay)
        .groupBy("user_id", F.window("ts", "1 day").alias("w"))
        .agg(F.sum("l").alias("n_links"), F.sum("m").alias("n_meetings"))
        .filter("n_links > 0 AND n_meetings > 0")
        .select("user_id", F.col("w.start").alias("day"), "n_links", "n_meetings", (F.col("n_links") * F.col("n_meetings")).alias("n_pairs"))
    )
