"""Time windows, sessions and their reports. All start with a partial aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.scans import position_chunk, running_max
from tidemark.operators.skew import skew_join


def _seconds(interval: str) -> int:
    """'30 minutes' -> 1800."""
    number, unit = interval.split()
    return int(number) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]


def tumbling_count(rows: DataFrame, keys: Sequence[str], ts: str, size: str) -> DataFrame:
    return (
        rows.groupBy(*keys, F.window(ts, size).alias("w"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(*keys, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n")
    )


def sliding_count(rows: DataFrame, keys: Sequence[str], ts: str, size: str, slide: str) -> DataFrame:
    """Counts per sliding window. Rows are first reduced to panes of one slide, and only
    the panes are copied into the windows that hold them."""
    panes = rows.groupBy(*keys, F.window(ts, slide).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    steps = _seconds(size) // _seconds(slide)
    starts = F.transform(
        F.sequence(F.lit(0), F.lit(steps - 1)),
        lambda i: F.timestamp_seconds(F.unix_seconds(F.col("w.start")) - i * _seconds(slide)),
    )
    return (
        panes.select(*keys, F.explode(starts).alias("window_start"), "n")
        .groupBy(*keys, "window_start")
        .agg(F.sum("n").alias("n"))
        .withColumn("window_end", F.timestamp_seconds(F.unix_seconds("window_start") + _seconds(size)))
    )


def sessions(rows: DataFrame, keys: Sequence[str], ts: str, gap: str = "30 minutes") -> DataFrame:
    """Session windows: a new session starts after a pause longer than `gap`.

    Two rows inside one slot as wide as the gap always share a session, so rows are
    reduced to slots first; the ordered pass then sees slots, whose number per key is
    bounded by time and not by traffic.
    """
    return (
        _slots(rows, keys, ts, gap)
        .groupBy(*keys, "session_no")
        .agg(
            F.min("first").alias("session_start"),
            F.max("last").alias("session_last"),
            F.sum("n").alias("n"),
        )
        .withColumn("session_end", F.timestamp_add("SECOND", F.lit(_seconds(gap)), "session_last"))
    )


def _slots(rows: DataFrame, keys: Sequence[str], ts: str, gap: str) -> DataFrame:
    width = _seconds(gap)
    slot = F.floor(F.unix_seconds(F.col(ts)) / width)
    slots = rows.groupBy(*keys, slot.alias("slot")).agg(
        F.min(ts).alias("first"), F.max(ts).alias("last"), F.count(F.lit(1)).alias("n")
    )
    w = Window.partitionBy(*keys).orderBy("slot")
    pause = F.unix_micros("first") - F.unix_micros(F.lag("last").over(w))
    starts = F.when(F.coalesce(pause > width * 1_000_000, F.lit(True)), 1).otherwise(0)
    return slots.withColumn("_s", starts).withColumn("session_no", F.sum("_s").over(w)).drop("_s")


def assign_sessions(rows: DataFrame, keys: Sequence[str], ts: str, gap: str = "30 minutes") -> DataFrame:
    """Adds session_no to every row by joining rows to slots on (key, slot)."""
    width = _seconds(gap)
    slots = _slots(rows, keys, ts, gap)
    counts = slots.select(*keys, "slot", "n")
    slots = slots.select(*keys, "slot", "session_no")
    placed = rows.withColumn("slot", F.floor(F.unix_seconds(F.col(ts)) / width))
    return skew_join(placed, slots, [*keys, "slot"], salt_by=rows.columns, counts=counts).drop("slot")


def session_topics(rows: DataFrame, keys: Sequence[str], ts: str, topic: str, gap: str = "30 minutes") -> DataFrame:
    """Sessions with their topics, one row per (session, topic); a session of any size
    stays a set of counted rows instead of one collected list."""
    return (
        assign_sessions(rows, keys, ts, gap)
        .groupBy(*keys, "session_no", topic)
        .agg(F.count(F.lit(1)).alias("n_items"), F.min(ts).alias("first_at"), F.max(ts).alias("last_at"))
    )


def anomalies(
    readings: DataFrame, key: str, ts: str, value: str, size: str = "1 hour", slide: str = "5 minutes", sigmas: float = 2.0
) -> DataFrame:
    """Readings further than `sigmas` standard deviations from the mean of a window that
    holds them (sample deviation, at least two readings).

    Panes of one slide are combined to windows; each reading meets, through one
    equi-join on (key, pane), the short array of its windows' statistics. Values are
    centred on their pane's mean before they are squared, and windows merge the panes'
    (count, mean, squared deviations), so a large common value cancels nothing.
    """
    step, span = _seconds(slide), _seconds(size)
    steps = span // step
    pane = F.floor(F.unix_seconds(F.col(ts)) / step)
    panes = readings.groupBy(key, pane.alias("pane")).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("m"),
        F.coalesce(F.var_pop(value) * F.count(value), F.lit(0.0)).alias("dev"),
    )
    panes = panes.filter(F.col("n") > 0)
    spread = panes.select(key, F.explode(F.sequence(F.col("pane") - (steps - 1), F.col("pane"))).alias("start"), "n", "m", "dev")
    # At most size/slide panes per window, so the collected array is small and fixed.
    windows = (
        spread.groupBy(key, "start")
        .agg(
            F.sum("n").alias("n"),
            (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"),
            F.sum("dev").alias("within"),
            F.collect_list(F.struct("n", "m")).alias("ps"),
        )
        .filter(F.col("n") >= 2)
        .withColumn(
            "dev",
            F.col("within") + F.aggregate("ps", F.lit(0.0), lambda acc, p: acc + p["n"] * F.pow(p["m"] - F.col("mean"), 2)),
        )
        .select(key, "start", "mean", F.sqrt(F.col("dev") / (F.col("n") - 1)).alias("sd"))
    )
    # At most size/slide windows per pane, so the collected array is small and fixed.
    per_pane = (
        windows.select(key, F.explode(F.sequence(F.col("start"), F.col("start") + (steps - 1))).alias("pane"), "start", "mean", "sd")
        .groupBy(key, "pane")
        .agg(F.collect_list(F.struct("start", "mean", "sd")).alias("ws"))
    )
    hit = F.filter("ws", lambda w: F.abs(F.col(value) - w["mean"]) > sigmas * w["sd"])
    placed = readings.filter(F.col(value).isNotNull()).withColumn("pane", pane)
    return (
        skew_join(placed, per_pane, [key, "pane"], salt_by=[ts, value], counts=panes.select(key, "pane", "n"))
        .select(*[c for c in readings.columns], F.explode(hit).alias("w"))
        .select(
            *readings.columns,
            F.timestamp_seconds(F.col("w.start") * step).alias("window_start"),
            F.col("w.mean").alias("mean"),
            F.col("w.sd").alias("sd"),
        )
    )


def weekly_digest(rows: DataFrame, ts: str, topic: str, top: int = 3) -> DataFrame:
    """Total and the leading topics per epoch-aligned week. Topic counts come first, so
    the ranking sees one row per (week, topic)."""
    counts = rows.groupBy(F.window(ts, "7 days").start.alias("week"), topic).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("week").agg(F.sum("n").alias("total"))
    w = Window.partitionBy("week").orderBy(F.desc("n"), topic)
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).join(totals, "week")


def topic_spikes(rows: DataFrame, ts: str, topic: str, factor: float = 2.0, floor: int = 3) -> DataFrame:
    """Days on which a topic reaches `factor` times the mean of its previous seven days
    (days without events count as zero, so a topic may spike after silence) and at least
    `floor` events."""
    daily = rows.groupBy(topic, F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(topic).orderBy(F.unix_date("day")).rangeBetween(-7, -1)
    return (
        daily.withColumn("before", F.sum("n").over(w))
        .withColumn("before", F.coalesce("before", F.lit(0).cast("bigint")))
        .filter((F.col("n") >= floor) & (F.col("n") * 7 >= F.col("before") * factor))
        .withColumn("mean_before", F.col("before") / 7.0)
        .drop("before")
    )


def late_events(events: DataFrame, delay: str, keys: Sequence[str] = (), position: str = "ord", chunk_rows: int = 1_000_000) -> DataFrame:
    """Events whose time lies before the watermark of everything that arrived earlier.

    The watermark runs over unique arrival positions cut into chunks of fixed length.
    `keys` gives a watermark per source partition.
    """
    tagged = events if keys else events.withColumn("_all", F.lit(0))
    group = list(keys) or ["_all"]
    marked = running_max(tagged, group, position_chunk(position, chunk_rows), [position], "occurred_at", "max_before")
    out = marked.withColumn("watermark", F.col("max_before") - F.expr(f"INTERVAL {delay}"))
    return out.filter(F.col("occurred_at") < F.col("watermark")).drop("max_before", "_all")


def period_change(rows: DataFrame, ts: str, keys: Sequence[str], unit: str = "month") -> DataFrame:
    """Count per period with the count of the period just before.

    A key's first silent period after one with rows has a row of its own, so a fall to zero
    shows. Periods after the last one in the table are not made.
    """
    counts = rows.groupBy(*keys, F.date_trunc(unit, ts).alias("period")).agg(F.count(F.lit(1)).alias("n"))
    previous = counts.select(
        *keys, F.timestamp_add(unit.upper(), F.lit(1), "period").alias("period"), F.col("n").alias("n_before")
    )
    last = counts.agg(F.max("period")).scalar()
    zero = F.lit(0).cast("bigint")
    return (
        counts.join(previous.filter(F.col("period") <= last), [*keys, "period"], "full_outer")
        .withColumns({"n": F.coalesce("n", zero), "n_before": F.coalesce("n_before", zero)})
        .withColumn("change", F.col("n") - F.col("n_before"))
    )


def active_hours(rows: DataFrame, ts: str) -> DataFrame:
    return rows.groupBy(F.dayofweek(ts).alias("day_of_week"), F.hour(ts).alias("hour")).agg(F.count(F.lit(1)).alias("n"))


def reading_stats(readings: DataFrame, key: str, value: str) -> DataFrame:
    return readings.groupBy(key).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("stddev"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )


def hourly_rollup(readings: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    return readings.groupBy(key, F.date_trunc("hour", ts).alias("hour")).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max")
    )


def climbing_runs(readings: DataFrame, key: str, ts: str, value: str, rises: int = 3) -> DataFrame:
    """Runs of at least `rises` hourly means that rise in a row over consecutive hours."""
    hourly = hourly_rollup(readings.filter(F.col(value).isNotNull()), key, ts, value)
    w = Window.partitionBy(key).orderBy("hour")
    consecutive = F.unix_seconds("hour") - F.unix_seconds(F.lag("hour").over(w)) == 3600
    rising = F.coalesce(consecutive & (F.col("mean") > F.lag("mean").over(w)), F.lit(False))
    return (
        hourly.withColumn("rise", rising)
        .withColumn("run", F.sum(F.when(~F.col("rise"), 1).otherwise(0)).over(w))
        .groupBy(key, "run")
        .agg(
            F.min("hour").alias("run_start"),
            F.max("hour").alias("run_end"),
            F.count_if("rise").alias("n_rises"),
        )
        .filter(F.col("n_rises") >= rises)
        .drop("run")
    )


def raw_or_rollup(readings: DataFrame, now: Column, days: int, key: str, ts: str, value: str) -> tuple[DataFrame, DataFrame]:
    """(raw rows still kept, hourly aggregates of the rows that expire)."""
    cutoff = now - F.expr(f"INTERVAL {int(days)} DAYS")
    return (
        readings.filter(F.col(ts) >= cutoff),
        hourly_rollup(readings.filter(F.col(ts) < cutoff), key, ts, value),
    )
