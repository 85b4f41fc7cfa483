"""Windows, sessions, patterns and ordered scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import folds, patterns, windows
from tidemark.plans import sqltext as S
from tidemark.plans.registry import flat, ntz, query
from tidemark.sources import adapters


@query(
    "links_per_hour",
    """SELECT user_id, date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, count(*) AS n
    FROM events GROUP BY user_id, date_trunc('hour', ts)""",
)
def links_per_hour(spark, sf):
    return flat(windows.tumbling_count(adapters.activity(spark, sf), ["user_id"], "ts", "1 hour"))


@query(
    "topic_frequency",
    f"""WITH {S.ACTIVITY}, p AS (SELECT topic, date_trunc('hour', ts) AS h, count(*) AS n FROM activity GROUP BY ALL)
    SELECT topic, h - to_hours(CAST(i AS INTEGER)) AS window_start, h - to_hours(CAST(i AS INTEGER)) + INTERVAL 24 HOUR AS window_end, CAST(sum(n) AS BIGINT) AS n
    FROM p, range(24) r(i) GROUP BY ALL""",
)
def topic_frequency(spark, sf):
    return flat(windows.sliding_count(adapters.activity(spark, sf), ["topic"], "ts", "24 hours", "1 hour"))


SESSIONS = """gaps AS (
  SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS brk FROM activity),
marked AS (SELECT *, CAST(sum(brk) OVER (PARTITION BY user_id ORDER BY ts) AS BIGINT) AS session_no FROM gaps)"""


@query(
    "session_windows",
    f"""WITH {S.ACTIVITY}, {SESSIONS} SELECT user_id, session_no, min(ts) AS session_start, max(ts) AS session_last, count(*) AS n,
      max(ts) + INTERVAL 30 MINUTE AS session_end FROM marked GROUP BY user_id, session_no""",
)
def session_windows(spark, sf):
    return flat(windows.sessions(adapters.activity(spark, sf), ["user_id"], "ts"))


@query("session_assignment", f"WITH {S.ACTIVITY}, {SESSIONS} SELECT event_id, user_id, session_no FROM marked")
def session_assignment(spark, sf):
    return windows.assign_sessions(adapters.activity(spark, sf), ["user_id"], "ts").select("event_id", "user_id", "session_no")


@query(
    "session_reconstruction",
    f"""WITH {S.ACTIVITY}, {SESSIONS} SELECT user_id, session_no, topic, count(*) AS n_items, min(ts) AS first_at, max(ts) AS last_at
    FROM marked GROUP BY ALL""",
)
def session_reconstruction(spark, sf):
    return flat(windows.session_topics(adapters.activity(spark, sf), ["user_id"], "ts", "topic"))


_ANOMALY = f"""{S.SENSOR},
r AS (SELECT subject_id, occurred_at, celsius, epoch_us(occurred_at) // 3600000000 AS pane FROM sensor WHERE celsius IS NOT NULL),
w AS (SELECT *, pane - i AS start FROM r, range(24) t(i)),
st AS (SELECT subject_id, start, avg(celsius) AS mean, stddev_samp(celsius) AS sd FROM w GROUP BY ALL HAVING count(*) >= 2)"""


@query(
    "anomalies",
    f"""WITH {_ANOMALY} SELECT w.subject_id, occurred_at, celsius, make_timestamp(start * 3600000000) AS window_start,
      round(mean, 6) AS mean, round(sd, 6) AS sd
    FROM w JOIN st USING (subject_id, start) WHERE abs(celsius - mean) > 2 * sd""",
)
def anomalies(spark, sf):
    r = folds.temperature_readings(adapters.sensor_events(spark, sf)).select("subject_id", "occurred_at", "celsius")
    rows = windows.anomalies(r, "subject_id", "occurred_at", "celsius", "1 day", "1 hour")
    return flat(rows.withColumns({"mean": F.round("mean", 6), "sd": F.round("sd", 6)}))


@query(
    "climbing_runs",
    f"""WITH {S.SENSOR},
    h AS (SELECT subject_id, date_trunc('hour', occurred_at) AS hour, avg(celsius) AS mean FROM sensor WHERE celsius IS NOT NULL GROUP BY ALL),
    f AS (SELECT *, CASE WHEN hour - lag(hour) OVER w = INTERVAL 1 HOUR AND mean > lag(mean) OVER w THEN 1 ELSE 0 END AS rise
      FROM h WINDOW w AS (PARTITION BY subject_id ORDER BY hour)),
    g AS (SELECT *, sum(1 - rise) OVER (PARTITION BY subject_id ORDER BY hour) AS run FROM f)
    SELECT subject_id, min(hour) AS run_start, max(hour) AS run_end, CAST(sum(rise) AS BIGINT) AS n_rises
    FROM g GROUP BY subject_id, run HAVING sum(rise) >= 3""",
)
def climbing_runs(spark, sf):
    r = folds.temperature_readings(adapters.sensor_events(spark, sf))
    return flat(windows.climbing_runs(r, "subject_id", "occurred_at", "celsius"))


@query(
    "weekly_digest",
    f"""WITH {S.ACTIVITY},
    c AS (SELECT time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS week, topic, count(*) AS n FROM activity GROUP BY ALL),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY week ORDER BY n DESC, topic) AS INTEGER) AS rank,
      CAST(sum(n) OVER (PARTITION BY week) AS BIGINT) AS total FROM c)
    SELECT week, topic, n, rank, total FROM r WHERE rank <= 3""",
)
def weekly_digest(spark, sf):
    return flat(windows.weekly_digest(adapters.activity(spark, sf), "ts", "topic"))


@query(
    "topic_spikes",
    f"""WITH {S.ACTIVITY}, c AS (SELECT fine_topic, CAST(ts AS DATE) AS day, count(*) AS n FROM activity GROUP BY ALL),
    b AS (SELECT c.fine_topic, c.day, c.n, coalesce(sum(p.n), 0) AS before FROM c LEFT JOIN c p ON p.fine_topic = c.fine_topic
      AND p.day >= c.day - 7 AND p.day < c.day GROUP BY ALL)
    SELECT fine_topic, day, n, round(before / 7.0, 6) AS mean_before FROM b WHERE n >= 3 AND n >= 2 * before / 7.0""",
)
def topic_spikes(spark, sf):
    rows = windows.topic_spikes(adapters.activity(spark, sf), "ts", "fine_topic")
    return rows.withColumn("mean_before", F.round(F.col("mean_before").cast("double"), 6))


@query(
    "late_events",
    f"""WITH {S.SENSOR}, m AS (
      SELECT ord, mixed, occurred_at, max(occurred_at) OVER (ORDER BY mixed ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM sensor)
    SELECT 'ev-' || ord AS id, mixed AS ord, occurred_at, top - INTERVAL 5 MINUTE AS watermark FROM m
    WHERE occurred_at < top - INTERVAL 5 MINUTE""",
)
def late_events(spark, sf):
    e = adapters.sensor_events(spark, sf, shuffled=True).select("id", "ord", "occurred_at")
    return flat(windows.late_events(e, "5 MINUTES", chunk_rows=50_000))


_PATTERN = """p AS (
  SELECT a.subject_id AS run_key, a.id AS added_id, a.ts AS added_at,
    (SELECT min(f.ts) FROM life f WHERE f.subject_id = a.subject_id AND f.kind = 'content.fetched' AND f.ts > a.ts) AS fetched_at
  FROM life a WHERE a.kind = 'link.added'),
q AS (
  SELECT p.*, (SELECT min(e.ts) FROM life e WHERE e.subject_id = p.run_key AND e.kind = 'enrichment.completed' AND e.ts > p.fetched_at) AS enriched_at
  FROM p)"""


@query(
    "lifecycle_pattern",
    f"""WITH {S.LIFE}, {_PATTERN} SELECT * FROM q WHERE enriched_at - added_at < INTERVAL 240 HOUR""",
)
def lifecycle_pattern(spark, sf):
    """The five minute default matches nothing on these tables; the check uses 240 hours."""
    return flat(patterns.lifecycle(adapters.lifecycle_events(spark, sf, runs=True), within_seconds=240 * 3600))


@query(
    "deep_dive",
    """WITH v AS (SELECT vec_id, ts, CAST(embedding AS DOUBLE[]) AS e FROM embeddings JOIN events ON vec_id = event_id),
    p AS (SELECT a.vec_id, b.vec_id AS other, list_cosine_similarity(a.e, b.e) AS sim
      FROM v a JOIN v b ON b.ts > a.ts AND b.ts < a.ts + INTERVAL 2 HOUR)
    SELECT vec_id, count(*) AS n_related, round(max(sim), 6) AS best_similarity, max_by(other, sim) AS best_id
    FROM p WHERE sim > 0.3 GROUP BY vec_id""",
)
def deep_dive(spark, sf):
    """The design threshold 0.7 matches nothing on these tables; the check uses 0.3."""
    rows = patterns.deep_dive(adapters.timed_vectors(spark, sf), threshold=0.3)
    return rows.withColumn("best_similarity", F.round("best_similarity", 6))


@query(
    "stage_latency",
    f"""WITH {S.LIFE}, s AS (SELECT subject_id AS run_key, min(ts) FILTER (WHERE kind = 'link.added') AS added_at,
      min(ts) FILTER (WHERE kind = 'content.fetched') AS fetched_at, min(ts) FILTER (WHERE kind = 'enrichment.completed') AS enriched_at,
      min(ts) FILTER (WHERE kind = 'publish.completed') AS published_at FROM life GROUP BY subject_id)
    SELECT *, (epoch_us(fetched_at) - epoch_us(added_at)) / 1000000.0 AS fetch_seconds,
      (epoch_us(enriched_at) - epoch_us(fetched_at)) / 1000000.0 AS enrich_seconds,
      (epoch_us(published_at) - epoch_us(enriched_at)) / 1000000.0 AS publish_seconds FROM s""",
)
def stage_latency(spark, sf):
    return flat(patterns.stage_latency(adapters.lifecycle_events(spark, sf, runs=True)))


@query(
    "stage_latency_percentiles",
    f"""WITH {S.LIFE}, s AS (SELECT subject_id, min(ts) FILTER (WHERE kind = 'link.added') AS a,
      min(ts) FILTER (WHERE kind = 'content.fetched') AS f FROM life GROUP BY subject_id)
    SELECT count(*) AS runs, round(quantile_cont(CAST((epoch_us(f) - epoch_us(a)) // 60000000 AS DOUBLE), 0.5), 3) AS fetch_p50,
      round(quantile_cont(CAST((epoch_us(f) - epoch_us(a)) // 60000000 AS DOUBLE), 0.9), 3) AS fetch_p90 FROM s WHERE f > a""",
)
def stage_latency_percentiles(spark, sf):
    """Percentiles of whole minutes. Runs are counted per minute first, so the last
    step sees one row per minute of latency, however many runs there are."""
    rows = patterns.stage_latency(adapters.lifecycle_events(spark, sf, runs=True)).filter("fetch_seconds > 0")
    minutes = rows.groupBy(F.floor(F.col("fetch_seconds") / 60).alias("m")).agg(F.count(F.lit(1)).alias("n"))
    return minutes.agg(
        F.sum("n").alias("runs"),
        F.round(F.percentile("m", F.lit(0.5), F.col("n")), 3).alias("fetch_p50"),
        F.round(F.percentile("m", F.lit(0.9), F.col("n")), 3).alias("fetch_p90"),
    )


@query(
    "run_trace",
    f"""WITH {S.LIFE}, t AS (SELECT subject_id AS run_key, id, kind AS event_type, ts AS occurred_at,
      lag(ts) OVER (PARTITION BY subject_id ORDER BY ts, ord) AS previous_at FROM life)
    SELECT *, (epoch_us(occurred_at) - epoch_us(previous_at)) / 1000000.0 AS seconds_since FROM t""",
)
def run_trace(spark, sf):
    return flat(patterns.run_trace(adapters.lifecycle_events(spark, sf, runs=True)).drop("ord"))


@query(
    "fetch_schedule",
    f"""WITH {S.PAGE}, w AS (SELECT page_id, host, (page_id % 5) * 700 AS t, md5('page-' || page_id) AS h FROM page_norm),
    j AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY t, h) - 1 AS j FROM w)
    SELECT page_id, host, make_timestamp(CAST((j * 1000 + max(t - j * 1000) OVER (PARTITION BY host ORDER BY t, h)) * 1000
      + epoch_us(TIMESTAMP '2024-01-01') AS BIGINT)) AS start_at FROM j""",
)
def fetch_schedule(spark, sf):
    """Five arrival instants, so many pages of a host share one."""
    from tidemark.functions.urls import domain

    p = adapters.table(spark, sf, "pages").select(
        "page_id",
        domain("url").alias("host"),
        F.concat(F.lit("page-"), "page_id").alias("work_id"),
        F.timestamp_millis(F.lit(1704067200000) + (F.col("page_id") % 5) * 700).alias("arrived_at"),
    )
    return flat(patterns.fetch_schedule(p, "host", "arrived_at", "work_id").select("page_id", "host", "start_at"))


@query(
    "series_navigation",
    f"""WITH {S.POSTS}, l AS (SELECT *, coalesce(part, 0) AS pt, md5(slug) AS h FROM posts WHERE status = 'published')
    SELECT series, slug, part, row_number() OVER w AS position, count(*) OVER (PARTITION BY series) AS total,
      lag(slug) OVER w AS prev_slug, lead(slug) OVER w AS next_slug
    FROM l WINDOW w AS (PARTITION BY series ORDER BY pt, h)""",
)
def series_navigation(spark, sf):
    return patterns.series_navigation(adapters.posts(spark, sf))
