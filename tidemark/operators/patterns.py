"""Patterns across events: lifecycle, deep dive, as-of context, run traces, schedules."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.scans import carried_last, position_chunk, positions, time_chunk


def lifecycle(events: DataFrame, within_seconds: int = 300) -> DataFrame:
    """link.added followed by content.fetched followed by enrichment.completed of one
    run, all inside less than `within_seconds`.

    A match lies in the time slot of its start or the next one, so every event is
    placed in its own slot and the one before, and the ordered pass runs per
    (run, slot): a run of any length is spread over its slots.
    """
    e = events.filter(
        F.col("event_type").isin("link.added", "content.fetched", "enrichment.completed")
    ).select(
        F.coalesce("correlation_id", "id").alias("run_key"), "ord", "id", "event_type", "occurred_at",
        time_chunk("occurred_at", within_seconds).alias("_s"),
    )
    placed = e.withColumn(
        "slot",
        F.explode(F.when(F.col("event_type") == "link.added", F.array("_s")).otherwise(F.array(F.col("_s"), F.col("_s") - 1))),
    )
    kind = F.col("event_type")
    # Latest first: the running "last" value is the nearest later event.
    w = Window.partitionBy("run_key", "slot").orderBy(F.desc("occurred_at"), F.desc("ord")).rowsBetween(
        Window.unboundedPreceding, -1
    )
    enriched_at = F.last(F.when(kind == "enrichment.completed", F.col("occurred_at")), ignorenulls=True).over(w)
    step = placed.withColumn("_enriched", enriched_at)
    fetched = F.last(
        F.when(kind == "content.fetched", F.struct(F.col("occurred_at").alias("f"), F.col("_enriched").alias("e"))),
        ignorenulls=True,
    ).over(w)
    return (
        step.withColumn("_f", fetched)
        .filter(kind == "link.added")
        .select("run_key", F.col("id").alias("added_id"), F.col("occurred_at").alias("added_at"),
                F.col("_f.f").alias("fetched_at"), F.col("_f.e").alias("enriched_at"))
        .filter(
            (F.unix_micros("enriched_at") - F.unix_micros("added_at")) < within_seconds * 1_000_000
        )
    )


def stage_latency(events: DataFrame) -> DataFrame:
    """First time of each stage per run and the seconds between them."""
    def first(kind: str) -> Column:
        return F.min(F.when(F.col("event_type") == kind, F.col("occurred_at")))

    def gap(a: str, b: str) -> Column:
        return (F.unix_micros(b) - F.unix_micros(a)) / 1_000_000.0

    return (
        events.groupBy(F.coalesce("correlation_id", "id").alias("run_key"))
        .agg(
            first("link.added").alias("added_at"),
            first("content.fetched").alias("fetched_at"),
            first("enrichment.completed").alias("enriched_at"),
            first("publish.completed").alias("published_at"),
        )
        .withColumn("fetch_seconds", gap("added_at", "fetched_at"))
        .withColumn("enrich_seconds", gap("fetched_at", "enriched_at"))
        .withColumn("publish_seconds", gap("enriched_at", "published_at"))
    )


def run_trace(events: DataFrame, chunk_rows: int = 1_000_000) -> DataFrame:
    """All events of a run in arrival order with the seconds since the previous one.
    Chunks are ranges of unique positions, so none holds more than `chunk_rows` rows."""
    e = events.select(
        F.coalesce("correlation_id", "id").alias("run_key"), "ord", "id", "event_type", "occurred_at"
    )
    traced = carried_last(e, ["run_key"], position_chunk("ord", chunk_rows), ["ord"], F.col("occurred_at"), "previous_at")
    return traced.withColumn(
        "seconds_since", (F.unix_micros("occurred_at") - F.unix_micros("previous_at")) / 1_000_000.0
    )


def context_join(
    events: DataFrame, readings: DataFrame, keys: Sequence[str], ts: str, value: str, chunk_seconds: int = 600
) -> DataFrame:
    """Each event with the latest reading at or before its time (as-of join).

    Both sides are laid on one time line and the last reading is carried forward;
    chunks of time keep a busy sensor out of a single task.
    """
    right = readings.select(*keys, F.col(ts), F.struct(F.col(ts).alias("at"), F.col(value).alias("v")).alias("_r"), F.lit(0).alias("_side"))
    left = events.withColumns({"_side": F.lit(1)})
    line = left.unionByName(right, allowMissingColumns=True)
    out = carried_last(line, keys, time_chunk(ts, chunk_seconds), [ts, "_side"], F.col("_r"), "_ctx")
    return (
        out.filter(F.col("_side") == 1)
        .select(*events.columns, F.col("_ctx.at").alias("reading_at"), F.col("_ctx.v").alias("reading"))
    )


_DIVE = "vec_id long, n long, best double, best_id long"


def deep_dive(
    vectors: DataFrame, threshold: float = 0.7, hours: float = 2.0, slices: int = 1, block_rows: int = 20_000
) -> DataFrame:
    """Anchors with at least one later vector inside the time band whose cosine
    similarity is above the threshold: number of matches and the best one.

    Time is cut into slices. The anchors of a slice meet the vectors of their own and
    the next `slices` slices block by block, compared by a matrix product inside a
    task; only reduced rows leave the task, never pairs. A crowded slice is cut into
    as many blocks as its counted size needs, so a block stays near `block_rows`
    vectors and no partner is skipped.
    """
    width = hours * 3600.0 / slices
    v = vectors.select(
        "vec_id",
        F.unix_micros("ts").alias("us"),
        F.floor(F.unix_micros("ts") / F.lit(width * 1e6)).alias("s"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )
    # Blocks per slice on either side; one row per slice.
    reach = F.sequence(F.lit(0), F.lit(slices))
    own = v.groupBy("s").agg(F.count(F.lit(1)).alias("na"))
    seen = own.withColumn("d", F.explode(reach)).select((F.col("s") - F.col("d")).alias("s"), F.col("na").alias("nf"))
    grid = own.join(seen.groupBy("s").agg(F.sum("nf").alias("nf")), "s").select(
        "s", F.ceil(F.col("na") / block_rows).alias("ga"), F.ceil(F.col("nf") / block_rows).alias("gf")
    )
    digest = F.xxhash64("vec_id")
    zero = F.lit(0).cast("bigint")
    anchors = v.join(grid, "s").select(
        "vec_id", "us", "embedding", "s",
        F.pmod(digest, F.col("ga")).alias("i"),
        F.explode(F.sequence(zero, F.col("gf") - 1)).alias("j"),
    )
    # Fresh names on this side keep the two branches of one source apart.
    followers = (
        v.withColumn("d", F.explode(reach))
        .select("vec_id", "us", "embedding", (F.col("s") - F.col("d")).alias("s"))
        .join(grid, "s")
        .select(
            F.col("vec_id").alias("f_id"), F.col("us").alias("f_us"), F.col("embedding").alias("f_embedding"),
            F.col("s").alias("fs"),
            F.explode(F.sequence(zero, F.col("ga") - 1)).alias("fi"),
            F.pmod(digest, F.col("gf")).alias("fj"),
        )
    )
    band = int(hours * 3600 * 1e6)

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            r = _unit(right["f_embedding"])
            r_us, r_id = right["f_us"].to_numpy(), right["f_id"].to_numpy()
            step = max(1, 4_000_000 // len(right))
            for at in range(0, len(left), step):
                part = left.iloc[at : at + step]
                sim = _unit(part["embedding"]) @ r.T
                gap = r_us[None, :] - part["us"].to_numpy()[:, None]
                sim = np.where((gap > 0) & (gap < band) & (sim > threshold), sim, -np.inf)
                n = (sim > -np.inf).sum(axis=1)
                best = sim.max(axis=1)
                # Of equally similar vectors the smallest id is the best.
                first = np.where(sim == best[:, None], r_id[None, :], np.iinfo(np.int64).max).min(axis=1)
                hit = np.flatnonzero(n)
                found.append((part["vec_id"].to_numpy()[hit], n[hit], best[hit], first[hit]))
        columns = [np.concatenate(c) for c in zip(*found)] if found else [[]] * 4
        return pd.DataFrame(dict(zip(("vec_id", "n", "best", "best_id"), columns))).astype({"vec_id": "int64", "n": "int64", "best": "float64", "best_id": "int64"})

    partial = (
        anchors.groupBy("s", "i", "j").cogroup(followers.groupBy("fs", "fi", "fj")).applyInPandas(compare, _DIVE)
    )
    return partial.groupBy("vec_id").agg(
        F.sum("n").alias("n_related"), F.max(F.struct("best", (-F.col("best_id")).alias("_id"))).alias("_b")
    ).select("vec_id", "n_related", F.col("_b.best").alias("best_similarity"), (-F.col("_b._id")).alias("best_id"))


def _unit(vectors: pd.Series) -> np.ndarray:
    m = np.stack(vectors.to_numpy())
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norms == 0, 1.0, norms)


def fetch_schedule(work: DataFrame, domain: str, ts: str, unique: str, spacing_ms: int = 1000) -> DataFrame:
    """Planned start of each fetch, at least `spacing_ms` apart per domain.

    With n earlier fetches in a domain and k earlier ones at the same instant, the
    start is n*D + k*D + max over instants so far of (instant - its n * D), which
    needs one row per instant; single rows only get their rank inside the instant.
    """
    d = work.withColumn("_ms", F.unix_millis(ts))
    ranked = positions(
        d.withColumn("_zero", F.lit(0)), [domain, "_ms"], "_zero", unique, out="_k", total="_same"
    ).drop("_zero")
    instants = d.groupBy(domain, "_ms").agg(F.count(F.lit(1)).alias("_c"))
    # Instants are reduced to one hour slots before the ordered pass over a domain.
    slot = F.floor(F.col("_ms") / 3_600_000)
    by_slot = instants.groupBy(domain, slot.alias("_slot")).agg(F.sum("_c").alias("_sc"))
    before = (Window.unboundedPreceding, -1)
    slots = by_slot.withColumn(
        "_so", F.coalesce(F.sum("_sc").over(Window.partitionBy(domain).orderBy("_slot").rowsBetween(*before)), F.lit(0))
    )
    inner = Window.partitionBy(domain, "_slot").orderBy("_ms")
    counted = (
        instants.withColumn("_slot", slot)
        .withColumn("_in", F.coalesce(F.sum("_c").over(inner.rowsBetween(*before)), F.lit(0)))
        .join(slots.drop("_sc"), [domain, "_slot"])
        .withColumn("_n", F.col("_so") + F.col("_in"))
        .withColumn("_lead", F.col("_ms") - F.col("_n") * spacing_ms)
    )
    slot_max = counted.groupBy(domain, "_slot").agg(F.max("_lead").alias("_m"))
    carried = slot_max.select(
        domain, "_slot", F.max("_m").over(Window.partitionBy(domain).orderBy("_slot").rowsBetween(*before)).alias("_carry")
    )
    base = (
        counted.withColumn("_local", F.max("_lead").over(inner.rowsBetween(Window.unboundedPreceding, 0)))
        .join(carried, [domain, "_slot"])
        .select(domain, "_ms", (F.greatest("_local", "_carry") + F.col("_n") * spacing_ms).alias("_base"))
    )
    return (
        ranked.join(base, [domain, "_ms"])
        .withColumn("start_at", F.timestamp_millis(F.col("_base") + (F.col("_k") - 1) * spacing_ms))
        .drop("_ms", "_base", "_k", "_same")
    )


def series_navigation(posts: DataFrame) -> DataFrame:
    """Published posts of a series in part order with index, total, previous and next.

    Parts missing count as 0; equal parts are ordered by the digest of the slug. The
    neighbours come from the chunk of the row or the edges of the chunks beside it, so a
    series with a third of all posts is spread like any other.
    """
    live = posts.filter((F.col("status") == "published") & F.col("series").isNotNull()).withColumn(
        "_part", F.coalesce("part", F.lit(0))
    )
    placed = positions(live, ["series"], "_part", "slug", before="prev_slug", after="next_slug")
    return placed.select("series", "position", "slug", "part", "total", "next_slug", "prev_slug")
