"""The streaming forms, run to the end of the given events and read back.

Output and checkpoints go to a new folder below the shared checkpoint folder of the
session; a local temporary folder is used only where none is set.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.operators import folds
from tidemark.plans import sqltext as S
from tidemark.plans.registry import ORACLES, flat, query
from tidemark.plans.state import all_events
from tidemark.plans.temporal import _ANOMALY, _PATTERN
from tidemark.session import shared_folder
from tidemark.sources import adapters
from tidemark.streaming import windows
from tidemark.streaming.lifecycle import lifecycle_stream
from tidemark.streaming.materialize import StateTables, start_materializer
from tidemark.streaming.processors import anomaly_stream
from tidemark.streaming.sources import dedupe_stream
from tidemark.streaming.upsert import read_upserted, upsert_sink


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/streams-{uuid.uuid4().hex}"


def _finish(spark, stream):
    """Run an append-mode stream to the end of its source and return what it wrote."""
    folder = _folder(spark)
    query_ = (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query_.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


@query(
    "stream_links_per_hour",
    """SELECT user_id, date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, count(*) AS n
    FROM events GROUP BY user_id, date_trunc('hour', ts)
    HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 5 MINUTE FROM events)""",
)
def stream_links_per_hour(spark, sf):
    """Windows the watermark has closed by the end of the source."""
    e = adapters.event_stream(spark, sf)
    return flat(_finish(spark, windows.tumbling_counts(e, ["user_id"], "ts", "1 hour", "5 minutes")))


@query(
    "stream_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS brk
      FROM events), m AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g)
    SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM m GROUP BY user_id, s
    HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 5 MINUTE FROM events)""",
)
def stream_sessions(spark, sf):
    e = adapters.event_stream(spark, sf)
    return flat(_finish(spark, windows.session_counts(e, ["user_id"], "ts", "30 minutes", "5 minutes")))


@query("stream_dedupe", "SELECT 'ev-' || event_id AS id, event_id AS ord FROM events")
def stream_dedupe(spark, sf):
    e = adapters.lifecycle_events(spark, sf, stream=True)
    # Each tenth event arrives twice.
    twice = e.withColumn("copy", F.explode(F.when(F.col("ord") % 10 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    return _finish(spark, dedupe_stream(twice.drop("copy"), "1 hour").select("id", "ord"))


@query(
    "stream_lifecycle",
    f"""WITH {S.LIFE}, {_PATTERN} SELECT run_key, epoch_us(added_at) AS added_us, epoch_us(fetched_at) AS fetched_us,
      epoch_us(enriched_at) AS enriched_us FROM q WHERE enriched_at - added_at < INTERVAL 240 HOUR
      AND enriched_at <= (SELECT max(ts) FROM life WHERE kind <> 'publish.completed') - INTERVAL 1 HOUR""",
)
def stream_lifecycle(spark, sf):
    """Matches whose last event the watermark has passed by the end of the source."""
    e = adapters.lifecycle_events(spark, sf, runs=True, stream=True)
    return _finish(spark, lifecycle_stream(e, 240 * 3600, "1 hour"))


@query(
    "stream_anomalies",
    f"""WITH {_ANOMALY} SELECT w.subject_id, occurred_at, celsius, make_timestamp(start * 3600000000) AS window_start, round(mean, 10) AS mean, round(sd, 10) AS sd
    FROM w JOIN st USING (subject_id, start) WHERE abs(celsius - mean) > 2 * sd
      AND make_timestamp((start + 24) * 3600000000) <= (SELECT max(occurred_at) FROM r) - INTERVAL 1 HOUR""",
)
def stream_anomalies(spark, sf):
    """Windows that the watermark has closed by the end of the source."""
    r = folds.temperature_readings(adapters.sensor_events(spark, sf)).select("subject_id", "occurred_at", "celsius")
    rows = _finish(spark, anomaly_stream(_batches(spark, r), "subject_id", "occurred_at", "celsius", 86_400, 3_600, delay="1 hour"))
    return flat(rows.withColumns({"mean": F.round("mean", 10), "sd": F.round("sd", 10)}))


def _store(spark, events, table: str) -> StateTables:
    """State tables kept by the micro-batch materializer over a stream of events."""
    folder = _folder(spark)
    store = StateTables(spark, f"{folder}/state")
    start_materializer(events, store, f"{folder}/checkpoint", tables=(table,)).awaitTermination()
    return store


def _link_store(spark, sf) -> StateTables:
    return _store(spark, adapters.lifecycle_events(spark, sf, stream=True), "links")


@query("stream_publish_state", ORACLES["state_publish_state"])
def stream_publish_state(spark, sf):
    return flat(_link_store(spark, sf).publish_state())


@query("stream_links", f"WITH {S.AFTER} SELECT * FROM links")
def stream_links(spark, sf):
    return flat(_link_store(spark, sf).links())


@query("stream_link_content", ORACLES["state_link_content"])
def stream_link_content(spark, sf):
    return flat(_link_store(spark, sf).link_content())


@query("stream_link_metadata", ORACLES["state_link_metadata"])
def stream_link_metadata(spark, sf):
    return flat(_link_store(spark, sf).link_metadata())


def _batches(spark, events):
    """A batch frame as a stream: written to the shared folder and read file by file."""
    folder = f"{_folder(spark)}/in"
    events.write.parquet(folder)
    return spark.readStream.schema(events.schema).parquet(folder)


@query("stream_todos", ORACLES["state_todos"])
def stream_todos(spark, sf):
    return flat(_store(spark, _batches(spark, adapters.todo_events(spark, sf)), "todos").todos())


@query("stream_readings", ORACLES["state_temperature_readings"])
def stream_readings(spark, sf):
    e = adapters.sensor_events(spark, sf).withColumn("occurred_at", F.date_trunc("hour", "occurred_at"))
    return flat(_store(spark, _batches(spark, e), "readings").temperature_readings())


@query("stream_subjects", ORACLES["state_subjects"])
def stream_subjects(spark, sf):
    return flat(_store(spark, _batches(spark, all_events(spark, sf)), "subjects").subjects())


@query(
    "stream_upsert",
    f"""WITH {S.ACTIVITY} SELECT user_id, count(*) AS n, count(*) FILTER (WHERE hour(ts) < 12) AS n_morning, count(*) FILTER (WHERE topic IS NOT NULL) AS n_topics,
      'team-' || (user_id % 3) AS team FROM activity GROUP BY user_id""",
)
def stream_upsert(spark, sf):
    """A row per user kept by micro-batches, whatever the order of the source's files."""
    rows = adapters.activity(spark, sf)
    source, folder = f"{_folder(spark)}/in", _folder(spark)
    rows.repartitionByRange(4, "event_id").write.parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)

    def reduced(batch):
        sums = batch.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.hour("ts") < 12).alias("n_morning"), F.count("topic").alias("n_topics"))
        return sums.withColumn("team", F.concat(F.lit("team-"), (F.col("user_id") % 3).cast("string")))

    rules = {"n": "add", "n_morning": "add", "n_topics": "add", "team": "keep"}
    upsert_sink(stream, f"{folder}/table", f"{folder}/checkpoint", ["user_id"], rules, reduced, buckets=8).awaitTermination()
    return flat(read_upserted(spark, f"{folder}/table"))


@query(
    "stream_sliding",
    f"""WITH {S.ACTIVITY}, p AS (SELECT topic, date_trunc('hour', ts) AS h, count(*) AS n FROM activity GROUP BY ALL),
    w AS (SELECT topic, h - i * INTERVAL 1 HOUR AS window_start, n FROM p, range(24) t(i))
    SELECT topic, window_start, window_start + INTERVAL 24 HOUR AS window_end, CAST(sum(n) AS BIGINT) AS n FROM w GROUP BY topic, window_start
    HAVING window_start + INTERVAL 24 HOUR <= (SELECT max(ts) - INTERVAL 5 MINUTE FROM activity)""",
)
def stream_sliding(spark, sf):
    """Windows the watermark has closed by the end of the source."""
    e = _batches(spark, adapters.activity(spark, sf))
    return flat(_finish(spark, windows.sliding_counts(e, ["topic"], "ts", "24 hours", "1 hour", "5 minutes")))


@query(
    "stream_cross_daily",
    f"""WITH {S.ACTIVITY}, {S.CALENDAR}, l AS (SELECT user_id, CAST(ts AS DATE) AS d, count(*) AS n FROM activity GROUP BY ALL),
    m AS (SELECT user_id, CAST(start_at AS DATE) AS d, count(*) AS n FROM calendar GROUP BY ALL),
    top AS (SELECT greatest((SELECT max(ts) FROM activity), (SELECT max(start_at) FROM calendar)) - INTERVAL 1 HOUR AS t)
    SELECT l.user_id, CAST(l.d AS TIMESTAMP) AS day, l.n AS n_links, m.n AS n_meetings, l.n * m.n AS n_pairs
    FROM l JOIN m USING (user_id, d) WHERE CAST(l.d AS TIMESTAMP) + INTERVAL 1 DAY <= (SELECT t FROM top)""",
)
def stream_cross_daily(spark, sf):
    """Days the watermark has closed by the end of both sources."""
    links, meetings = adapters.activity(spark, sf), adapters.calendar(spark, sf)
    return flat(_finish(spark, windows.cross_stream_daily(_batches(spark, links), _batches(spark, meetings), "1 hour")))
