"""Interval history of link states: any moment is one pruned read, without a fold.

One pass turns the ledger into rows [valid_from, valid_to) per subject, one for each change of its
state. Running values are carried over chunks of arrival positions, so a subject of any size is
scanned by many tasks; a chunk gives one summary row. Intervals are cut at the ends of periods:
the part of the table for a period holds every state that is valid in it. A moment therefore reads
one part, and what changed between two moments is the difference of two such reads.

Arrival positions and arrival times rise together. States that change twice at one instant have an
empty interval, which no moment meets.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.payload import present, valid_visibility
from tidemark.operators.folds import LINK_TYPES, decoded, fetch_error, is_type
from tidemark.operators.scans import position_chunk
from tidemark.operators.skew import skew_join
from tidemark.session import stored

#: Arrival positions of one chunk.
CHUNK = 1_000_000
STATE = ("status", "visibility", "retry_count", "last_error_at", "last_error")


def change_points(
    rows: DataFrame, keys: Sequence[str], order: str, at: str, lasts: dict[str, Column], counts: dict[str, Column], state: Callable[[dict[str, Column]], Column], chunk_rows: int = CHUNK
) -> DataFrame:
    """(keys, valid_from, valid_to, s) for each row at which a key's state `s` changes.

    `lasts` are running last non-null values and `counts` running numbers of true rows; `state`
    makes the state of them. `order` is a unique integer position and `at` the time of a row.
    """
    keys = list(keys)
    d = rows.withColumn("_chunk", position_chunk(order, chunk_rows))
    d = d.select(*keys, "_chunk", order, at, *(v.alias(f"v_{n}") for n, v in lasts.items()), *(v.cast("long").alias(f"v_{n}") for n, v in counts.items()))
    local = Window.partitionBy(*keys, "_chunk").orderBy(order)
    to_here, to_before = local.rowsBetween(Window.unboundedPreceding, 0), local.rowsBetween(Window.unboundedPreceding, -1)
    running = lambda n, w: F.last(f"v_{n}", ignorenulls=True).over(w) if n in lasts else F.coalesce(F.sum(f"v_{n}").over(w), F.lit(0))
    every = [*lasts, *counts]
    scanned = d.select("*", *(running(n, to_here).alias(f"here_{n}") for n in every), *(running(n, to_before).alias(f"before_{n}") for n in every))
    # One row a chunk; its last values are carried to the key's later chunks.
    ends = [F.max_by(f"v_{n}", F.when(F.col(f"v_{n}").isNotNull(), F.col(order))).alias(f"e_{n}") for n in lasts]
    chunks = d.groupBy(*keys, "_chunk").agg(*ends, *(F.sum(f"v_{n}").alias(f"e_{n}") for n in counts))
    across = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = [(F.last(f"e_{n}", ignorenulls=True) if n in lasts else F.sum(f"e_{n}")).over(across).alias(f"c_{n}") for n in every]
    both = scanned.join(chunks.select(*keys, "_chunk", F.count(F.lit(1)).over(across).alias("_earlier"), *carried), [*keys, "_chunk"])

    def made(side: str) -> Column:
        value = lambda n: F.coalesce(f"{side}_{n}", f"c_{n}") if n in lasts else F.col(f"{side}_{n}") + F.coalesce(f"c_{n}", F.lit(0))
        return state({n: value(n) for n in every})

    first = (F.col("_earlier") == 0) & (F.row_number().over(local) == 1)
    points = both.select(*keys, "_chunk", order, at, made("here").alias("s"), made("before").alias("_was"), first.alias("_first"))
    points = points.filter(F.col("_first") | ~F.col("s").eqNullSafe(F.col("_was"))).select(*keys, "_chunk", order, F.col(at).alias("valid_from"), "s")
    # The end of an interval is the key's next change, in this chunk or in a later one.
    begins = points.groupBy(*keys, "_chunk").agg(F.min_by("valid_from", order).alias("_begin"))
    later = Window.partitionBy(*keys).orderBy("_chunk")
    begins = begins.select(*keys, "_chunk", F.lead("_begin").over(later).alias("_next"))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(order)
    joined = points.withColumn("_lead", F.lead("valid_from").over(inside)).join(begins, [*keys, "_chunk"])
    return joined.select(*keys, "valid_from", F.coalesce("_lead", "_next").alias("valid_to"), "s")


def link_history(events: DataFrame, chunk_rows: int = CHUNK) -> DataFrame:
    """(subject_id, valid_from, valid_to, status, visibility, retry_count, last_error_at, last_error).

    The states are those of the fold over each prefix of the ledger. A subject begins with its
    first usable link.added; what came before does not count. The last interval is open.
    """
    ev = decoded(events, LINK_TYPES)
    failed, published, enriched = fetch_error(), is_type("publish.completed"), is_type("enrichment.completed")
    fetched = is_type("content.fetched") & ~present("p.fetch_error")
    shown = is_type("link.visibility_changed") & valid_visibility("p.visibility")
    narrow = ev.select(
        "subject_id", "ord", "received_at", (is_type("link.added") & present("p.url")).alias("added"), F.when(published, "published").when(failed, "error").alias("terminal"),
        F.when(enriched, True).alias("enriched"), F.when(fetched, True).alias("fetched"), F.when(shown, F.col("p.visibility")).alias("visibility"),
        F.when(failed, F.struct("occurred_at", F.col("p.fetch_error").alias("error"))).alias("err"), failed.alias("failed"),
    )
    anchors = narrow.filter("added").groupBy("subject_id").agg(F.min("ord").alias("a"))
    known = skew_join(narrow, anchors, ["subject_id"], salt_by="ord").filter(F.col("ord") >= F.col("a"))
    lasts = {n: F.col(n) for n in ("terminal", "enriched", "fetched", "visibility", "err")}

    def state(v: dict[str, Column]) -> Column:
        status = F.when(v["terminal"].isNotNull(), v["terminal"]).when(v["enriched"], "enriched").when(v["fetched"], "fetched").otherwise("new")
        return F.struct(
            status.alias("status"), F.coalesce(v["visibility"], F.lit("public")).alias("visibility"), v["failed"].cast("int").alias("retry_count"),
            v["err"]["occurred_at"].alias("last_error_at"), v["err"]["error"].alias("last_error"),
        )

    points = change_points(known, ["subject_id"], "ord", "received_at", lasts, {"failed": F.col("failed")}, state, chunk_rows)
    return points.select("subject_id", "valid_from", "valid_to", "s.*")


def write_history(history: DataFrame, path: str, period: str = "month") -> None:
    """Store intervals by period, sorted by time inside; an interval is in each period it meets.

    Open intervals reach to the period of the table's last change; later moments read that one.
    """
    history = stored(history, "intervals")
    start = lambda c: F.date_trunc(period, c)
    end = history.agg(F.max(start(F.greatest("valid_from", F.coalesce("valid_to", "valid_from"))))).scalar()
    step = F.expr(f"INTERVAL 1 {period}")
    # An interval that ends at the start of a period is not valid in it.
    last = start(F.coalesce(F.col("valid_to") - F.expr("INTERVAL 1 MICROSECOND"), end))
    parts = history.filter(F.col("valid_to").isNull() | (F.col("valid_to") > F.col("valid_from")))
    parts = parts.withColumn("period", F.explode(F.sequence(start(F.col("valid_from")), last, step))).withColumn("period", F.col("period").cast("date"))
    parts.repartitionByRange("period", "valid_from", "subject_id").sortWithinPartitions("period", "valid_from", "subject_id").write.partitionBy("period").parquet(path)


def read_as_of(spark: SparkSession, path: str, moment: datetime, period: str = "month") -> DataFrame:
    """The states at a moment, without valid_from and valid_to: one part of the stored history.

    The periods are the folders of the table, read from its metadata.
    """
    table = spark.read.parquet(path)
    m = F.lit(moment).cast("timestamp")
    periods = [r["period"] for r in table.select("period").distinct().collect()]
    wanted = [p for p in periods if datetime(p.year, p.month, p.day) <= moment.replace(tzinfo=None)]
    if not wanted:
        return table.limit(0).drop("valid_from", "valid_to", "period")
    rows = table.filter((F.col("period") == F.lit(max(wanted))) & (F.col("valid_from") <= m) & (F.col("valid_to").isNull() | (F.col("valid_to") > m)))
    return rows.drop("valid_from", "valid_to", "period")


def changes_between(spark: SparkSession, path: str, earlier: datetime, later: datetime, key: str = "subject_id", period: str = "month") -> DataFrame:
    """(key, before, after) of every key whose state differs at the two moments; NULL where it had none."""
    sides = [read_as_of(spark, path, m, period) for m in (earlier, later)]
    columns = [c for c in sides[0].columns if c != key]
    before, after = (rows.select(key, F.struct(*columns).alias(name)) for rows, name in zip(sides, ("before", "after"), strict=True))
    return before.join(after, key, "full_outer").filter(~F.col("before").eqNullSafe(F.col("after")))
