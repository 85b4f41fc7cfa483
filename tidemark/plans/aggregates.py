"""Counts, tag reports, period reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import folds, reads, rollups, windows
from tidemark.plans import sqltext as S
from tidemark.plans.registry import flat, ntz, query
from tidemark.sources import adapters


@query("count_unpublished", "SELECT count(*) AS n FROM events WHERE event_id % 10 >= 7")
def count_unpublished(spark, sf):
    return adapters.lifecycle_events(spark, sf).filter(~F.col("published_to_kafka")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "table_counts",
    f"""WITH {S.AFTER} SELECT 'events' AS table_name, count(*) AS n FROM life UNION ALL SELECT 'links', count(*) FROM links
    UNION ALL SELECT 'link_content', count(*) FROM link_content UNION ALL SELECT 'link_metadata', count(*) FROM link_metadata
    UNION ALL SELECT 'publish_state', count(*) FROM publish_state""",
)
def table_counts(spark, sf):
    from tidemark.plans.tables import link_tables

    t = link_tables(spark, sf)
    return reads.table_counts(
        {"events": t.events, "links": t.links, "link_content": t.content, "link_metadata": t.metadata, "publish_state": t.publish}
    )


@query(
    "max_offset",
    """SELECT 'events.raw' AS kafka_topic, CAST(user_id % 3 AS INTEGER) AS kafka_partition, max(event_id) AS max_offset
    FROM events GROUP BY user_id % 3""",
)
def max_offset(spark, sf):
    e = adapters.lifecycle_events(spark, sf)
    return e.groupBy("kafka_topic", "kafka_partition").agg(F.max("kafka_offset").alias("max_offset"))


@query(
    "array_elements",
    f"""WITH {S.LIFE} SELECT ord, tags, CASE WHEN tags = '' THEN 0 ELSE CAST(len(string_split(tags, ',')) AS INTEGER) END AS n
    FROM life WHERE kind = 'enrichment.completed'""",
)
def array_elements(spark, sf):
    from tidemark.functions.payload import json_fragment

    e = adapters.lifecycle_events(spark, sf).filter("event_type = 'enrichment.completed'")
    tags = F.from_json(json_fragment("payload", "$.tags"), "array<string>")
    return e.select("ord", F.array_join(tags, ",").alias("tags"), F.size(tags).alias("n"))


@query(
    "tag_counts",
    f"""WITH {S.POSTS} SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM posts WHERE status = 'published') GROUP BY tag""",
)
def tag_counts(spark, sf):
    live = adapters.posts(spark, sf).filter("status = 'published'")
    return reads.tag_counts(live).orderBy(F.desc("n"), "tag")


@query("distinct_tags", f"WITH {S.POSTS} SELECT DISTINCT unnest(tags) AS tag FROM posts WHERE status = 'published'")
def distinct_tags(spark, sf):
    return adapters.posts(spark, sf).filter("status = 'published'").select(F.explode("tags").alias("tag")).distinct()


@query("status_funnel", f"WITH {S.AFTER} SELECT status, count(*) AS n FROM links GROUP BY status")
def status_funnel(spark, sf):
    rows = folds.links(folds.link_partials(adapters.lifecycle_events(spark, sf)))
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(
    "reading_stats",
    f"""WITH {S.SENSOR} SELECT subject_id, count(celsius) AS n, round(avg(celsius), 6) AS mean, round(stddev_samp(celsius), 6) AS stddev,
      min(celsius) AS min, max(celsius) AS max FROM sensor WHERE celsius IS NOT NULL GROUP BY subject_id""",
)
def reading_stats(spark, sf):
    r = folds.temperature_readings(adapters.sensor_events(spark, sf))
    return windows.reading_stats(r, "subject_id", "celsius").withColumns(
        {"mean": F.round("mean", 6), "stddev": F.round("stddev", 6)}
    )


@query(
    "period_change",
    f"""WITH {S.ACTIVITY}, c AS (SELECT topic, CAST(date_trunc('week', ts) AS TIMESTAMP) AS period, count(*) AS n FROM activity GROUP BY ALL),
    b AS (SELECT topic, period + INTERVAL 7 DAY AS period, n FROM c WHERE period < (SELECT max(period) FROM c))
    SELECT topic, CAST(period AS TIMESTAMP) AS period, coalesce(c.n, 0) AS n, coalesce(b.n, 0) AS n_before, coalesce(c.n, 0) - coalesce(b.n, 0) AS change
    FROM c FULL JOIN b USING (topic, period)""",
)
def period_change(spark, sf):
    return flat(windows.period_change(adapters.activity(spark, sf), "ts", ["topic"], "week"))


@query(
    "active_hours",
    """SELECT CAST(dayofweek(ts) + 1 AS INTEGER) AS day_of_week, CAST(hour(ts) AS INTEGER) AS hour, count(*) AS n
    FROM events GROUP BY ALL""",
)
def active_hours(spark, sf):
    return windows.active_hours(adapters.activity(spark, sf), "ts")


@query(
    "attendee_patterns",
    """WITH e AS (SELECT array_to_string(list_sort(list_distinct(['p' || (o_custkey % 4), 'p' || (o_custkey % 3)])), ',') AS attendees FROM orders)
    SELECT attendees, count(*) AS n FROM e GROUP BY attendees HAVING count(*) > 1""",
)
def attendee_patterns(spark, sf):
    from tidemark import schemas
    from tidemark.sources.ledger import with_payload

    e = with_payload(adapters.calendar_events(spark, sf), schemas.CALENDAR_PAYLOAD)
    team = F.array_join(F.array_sort(F.array_distinct("p.attendees")), ",")
    return e.groupBy(team.alias("attendees")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query(
    "hourly_rollup",
    f"""WITH {S.SENSOR} SELECT subject_id, date_trunc('hour', occurred_at) AS hour, count(celsius) AS n, round(avg(celsius), 6) AS mean,
      min(celsius) AS min, max(celsius) AS max FROM sensor WHERE celsius IS NOT NULL GROUP BY ALL""",
)
def hourly_rollup(spark, sf):
    r = folds.temperature_readings(adapters.sensor_events(spark, sf))
    return flat(windows.hourly_rollup(r, "subject_id", "occurred_at", "celsius").withColumn("mean", F.round("mean", 6)))


@query(
    "daily_from_hourly",
    f"""WITH {S.SENSOR} SELECT subject_id, CAST(date_trunc('day', occurred_at) AS TIMESTAMP) AS period, count(celsius) AS n, round(avg(celsius), 9) AS mean, round(stddev_samp(celsius), 9) AS stddev,
      min(celsius) AS min, max(celsius) AS max, quantile_disc(celsius, 0.5) AS p50, quantile_disc(celsius, 0.95) AS p95 FROM sensor WHERE celsius IS NOT NULL GROUP BY ALL""",
)
def daily_from_hourly(spark, sf):
    """Days merged from hours; a sketch is exact up to its size, which no day of a sensor here exceeds."""
    r = folds.temperature_readings(adapters.sensor_events(spark, sf))
    days = rollups.merge_rollups(rollups.rollup(r, "subject_id", "occurred_at", "celsius", k=32_768), "subject_id", "day")
    stats = rollups.rollup_stats(days, "subject_id").drop("n_distinct")
    return flat(stats.withColumns({c: F.round(c, 9) for c in ("mean", "stddev")}))
