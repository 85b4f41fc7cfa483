"""Ledger scans, decoding, outbox, capture and filters."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.functions import payload
from tidemark.plans import sqltext as S
from tidemark.plans.registry import flat, ntz, query
from tidemark.session import shared_folder
from tidemark.sources import adapters, ledger
from tidemark.sources.capture import capture_links

NOW = "2024-01-31 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


@query(
    "ledger_scan",
    f"""WITH {S.LIFE} SELECT id, subject_id, kind AS event_type, ts AS occurred_at FROM life
    WHERE kind = 'content.fetched' AND source = 'source-1'""",
)
def ledger_scan(spark, sf):
    """The ledger is stored by date and type and scanned for one type and source."""
    folder = f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}"
    ledger.write_ledger(adapters.lifecycle_events(spark, sf), folder)
    rows = ledger.read_ledger(spark, folder, event_type="content.fetched", source="source-1")
    return flat(rows.select("id", "subject_id", "event_type", "occurred_at"))


@query(
    "ledger_trace",
    f"""WITH {S.LIFE} SELECT id, subject_id, kind AS event_type, ts AS occurred_at FROM life WHERE subject_id = 'link:11'""",
)
def ledger_trace(spark, sf):
    """All events of one run, looked up by its id in the stored ledger."""
    folder = f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}"
    ledger.write_ledger(adapters.lifecycle_events(spark, sf, runs=True), folder)
    rows = ledger.read_ledger(spark, folder, correlation_id="link:11")
    return flat(rows.select("id", "subject_id", "event_type", "occurred_at"))


def _raw(spark, sf):
    """Broker values: every thirteenth row is cut off in the middle."""
    e = adapters.lifecycle_events(spark, sf)
    body = F.to_json(F.struct("id", "occurred_at", "source", "subject_id", "event_type", "payload"))
    broken = F.concat(F.lit('{"id": "'), "id")
    return e.select("kafka_offset", F.when(F.col("kafka_offset") % 13 == 0, broken).otherwise(body).alias("value"))


@query(
    "decode_event",
    f"""WITH {S.LIFE} SELECT id, subject_id, kind AS event_type, date_trunc('millisecond', ts) AS occurred_at,
      CAST(NULL AS VARCHAR) AS correlation_id FROM life WHERE event_id % 13 <> 0""",
)
def decode_event(spark, sf):
    good, _ = ledger.decode_events(_raw(spark, sf))
    # The wire format carries milliseconds.
    return flat(good.select("id", "subject_id", "event_type", "occurred_at", "correlation_id"))


@query("decode_malformed", "SELECT event_id AS kafka_offset FROM events WHERE event_id % 13 = 0")
def decode_malformed(spark, sf):
    _, bad = ledger.decode_events(_raw(spark, sf))
    return bad.select("kafka_offset")


@query(
    "outbox_batch",
    "SELECT 'ev-' || event_id AS id FROM events WHERE event_id % 10 >= 7 ORDER BY ts, event_id LIMIT 50",
)
def outbox_batch(spark, sf):
    return ledger.outbox_batch(adapters.lifecycle_events(spark, sf)).select("id")


@query(
    "kafka_records",
    f"""WITH {S.LIFE} SELECT subject_id AS key, 'ev-' || event_id AS body_id, kind AS body_type, source AS body_source, subject_id AS body_subject,
      date_trunc('millisecond', ts) AS body_at, url AS body_url, title AS body_title, text_content AS body_text,
      'event_type=' || kind || ';source=' || source AS headers FROM life""",
)
def kafka_records(spark, sf):
    """Headers and the decoded body, the payload inside it included."""
    r = ledger.to_kafka_records(adapters.lifecycle_events(spark, sf))
    back, _ = ledger.decode_events(r.select("key", "headers", "value"))
    r = ledger.with_payload(back)
    head = F.array_join(F.transform("headers", lambda h: F.concat(h["key"], F.lit("="), h["value"].cast("string"))), ";")
    return flat(
        r.select(
            "key", F.col("id").alias("body_id"), F.col("event_type").alias("body_type"), F.col("source").alias("body_source"),
            F.col("subject_id").alias("body_subject"), F.date_trunc("millisecond", "occurred_at").alias("body_at"),
            F.col("p.url").alias("body_url"), F.col("p.title").alias("body_title"), F.col("p.text_content").alias("body_text"), head.alias("headers"),
        )
    )


@query(
    "mark_published",
    """SELECT 'ev-' || event_id AS id, event_id % 10 < 7 OR event_id % 10 = 8 AS published_to_kafka FROM events""",
)
def mark_published(spark, sf):
    e = adapters.lifecycle_events(spark, sf)
    return ledger.mark_published(e, e.filter("ord % 10 = 8").select("id")).select("id", "published_to_kafka")


def _shares(spark, sf):
    p = adapters.table(spark, sf, "pages")
    n = F.col("page_id") % 9
    return p.select(
        F.when(n == 0, "").when(n == 1, F.concat(F.lit("no link "), "page_id")).otherwise(F.col("url")).alias("url"),
        F.when(F.col("page_id") % 2 == 0, "chrome").alias("source"),
        F.concat(F.lit("share-"), F.lpad(F.col("page_id").cast("string"), 12, "0")).alias("id"),
        F.timestamp_add("SECOND", F.col("page_id").cast("int"), F.lit("2024-01-01").cast("timestamp")).alias("occurred_at"),
        "page_id",
    )


_SHARED = f"""{S.PAGE}, ok AS (
  SELECT *, CASE WHEN page_id % 2 = 0 THEN 'chrome' ELSE 'unknown' END AS source,
    TIMESTAMP '2024-01-01' + to_seconds(page_id) AS shared_at FROM page_links WHERE page_id % 9 > 1)"""


@query(
    "capture_links",
    f"""WITH {_SHARED} SELECT subject_id, max_by(url, page_id) AS url, url_norm, max(shared_at) AS created_at,
      max_by(source, page_id) AS source, 'new' AS status, 'public' AS visibility, FALSE AS pinned
    FROM ok GROUP BY subject_id, url_norm""",
)
def captured_links(spark, sf):
    return flat(capture_links(_shares(spark, sf)).links)


@query(
    "capture_subjects",
    f"""WITH {_SHARED} SELECT 'link' AS subject, subject_id, max(shared_at) AS created_at, 'public' AS visibility, '{{}}' AS meta
    FROM ok GROUP BY subject_id""",
)
def captured_subjects(spark, sf):
    return flat(capture_links(_shares(spark, sf)).subjects)


@query(
    "capture_events",
    f"""WITH {_SHARED} SELECT 'share-' || lpad(CAST(page_id AS VARCHAR), 12, '0') AS id, subject_id, 'link.added' AS event_type,
      shared_at AS occurred_at, url, url_norm, source FROM ok""",
)
def captured_events(spark, sf):
    e = ledger.with_payload(capture_links(_shares(spark, sf)).events)
    return flat(e.select("id", "subject_id", "event_type", "occurred_at", "p.url", "p.url_norm", "source"))


@query(
    "capture_rejected",
    """SELECT page_id, CASE WHEN page_id % 9 = 0 THEN 'Missing or invalid ''url'' field' ELSE 'Invalid URL format' END AS error
    FROM pages WHERE page_id % 9 < 2""",
)
def captured_rejected(spark, sf):
    return capture_links(_shares(spark, sf)).rejected.select("page_id", "error")


@query(
    "dispatch",
    f"WITH {S.LIFE} SELECT kind AS event_type, count(*) AS n, count(url) AS urls, count(title) AS titles FROM life GROUP BY kind",
)
def dispatch(spark, sf):
    e = ledger.with_payload(adapters.lifecycle_events(spark, sf))
    return e.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count("p.url").alias("urls"), F.count("p.title").alias("titles")
    )


@query(
    "default_fields",
    f"""WITH {S.LIFE} SELECT id, coalesce(url, 'none') AS url_norm, summary_short, 'private' AS visibility FROM life""",
)
def default_fields(spark, sf):
    e = ledger.with_payload(adapters.lifecycle_events(spark, sf))
    return e.select(
        "id",
        F.coalesce("p.url_norm", "p.url", F.lit("none")).alias("url_norm"),
        F.coalesce("p.summary_short", "p.summary").alias("summary_short"),
        F.coalesce("p.visibility", F.lit("private")).alias("visibility"),
    )


@query(
    "quarantine",
    f"""WITH {S.SENSOR}, {S.LIFE[len(S.BASE) + 1:]}
    SELECT 'ev-' || ord AS id, 'missing celsius' AS reason FROM sensor WHERE celsius IS NULL
    UNION ALL
    SELECT id, 'missing title' FROM life WHERE kind = 'content.fetched' AND title IS NULL""",
)
def quarantine(spark, sf):
    """Rows that fail validation, each with its reason, instead of three failing attempts."""
    from tidemark.operators.validation import split_valid

    e = adapters.lifecycle_events(spark, sf).filter(F.col("event_type") == "content.fetched")
    rules = {"missing title": payload.present("p.title")}
    _, a = split_valid(ledger.with_payload(e), rules)
    s = ledger.with_payload(adapters.sensor_events(spark, sf))
    _, b = split_valid(s, {"missing celsius": F.col("p.celsius").isNotNull()})
    return a.select("id", "reason").unionByName(b.select("id", "reason"))


@query(
    "require_fields",
    f"WITH {S.SENSOR} SELECT ord, subject_id, celsius FROM sensor WHERE celsius IS NOT NULL",
)
def require_fields(spark, sf):
    from tidemark.operators.validation import split_valid

    good, _ = split_valid(
        ledger.with_payload(adapters.sensor_events(spark, sf)), {"missing celsius": F.col("p.celsius").isNotNull()}
    )
    return good.select("ord", "subject_id", "p.celsius")


@query(
    "valid_visibility",
    f"""WITH {S.BASE} SELECT 'ev-' || event_id AS id, CASE WHEN k % 5 = 0 THEN 'private' ELSE 'public' END AS visibility
    FROM base WHERE event_type = 'purchase' AND k % 5 <> 1""",
)
def valid_visibility(spark, sf):
    e = ledger.with_payload(adapters.visibility_events(spark, sf))
    return e.filter(payload.valid_visibility("p.visibility")).select("id", "p.visibility")


@query(
    "split_by_error",
    f"""WITH {S.LIFE} SELECT id, CASE WHEN fetch_error IS NULL THEN 'success' ELSE 'error' END AS branch
    FROM life WHERE kind = 'content.fetched'""",
)
def split_by_error(spark, sf):
    e = ledger.with_payload(adapters.lifecycle_events(spark, sf)).filter(F.col("event_type") == "content.fetched")
    failed = payload.present("p.fetch_error")
    good = e.filter(~failed).select("id", F.lit("success").alias("branch"))
    return good.unionByName(e.filter(failed).select("id", F.lit("error").alias("branch")))


@query(
    "typed_literals",
    f"""WITH {S.LIFE} SELECT subject_id, 'link' AS subject, CAST(NULL AS VARCHAR) AS display_name, FALSE AS pinned,
      0 AS retry_count, CAST(NULL AS TIMESTAMP) AS last_error_at FROM life WHERE kind = 'link.added'""",
)
def typed_literals(spark, sf):
    e = adapters.lifecycle_events(spark, sf).filter(F.col("event_type") == "link.added")
    return e.select(
        "subject_id",
        F.lit("link").alias("subject"),
        F.lit(None).cast("string").alias("display_name"),
        F.lit(False).alias("pinned"),
        F.lit(0).alias("retry_count"),
        ntz(F.lit(None).cast("timestamp"), "last_error_at"),
    )


@query(
    "retention",
    f"""WITH {S.LIFE} SELECT id, ts AS received_at FROM life WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY""",
)
def retention(spark, sf):
    return flat(ledger.retention(adapters.lifecycle_events(spark, sf), now(), 7).select("id", "received_at"))


@query(
    "dedupe_events",
    f"WITH {S.LIFE} SELECT id, ord, subject_id FROM life",
)
def dedupe_events(spark, sf):
    """Re-sent events have new broker positions, so the event id is the key."""
    e = adapters.duplicated(adapters.lifecycle_events(spark, sf)).select("id", "ord", "subject_id")
    return ledger.duplicates_removed(e, ["id"])


@query(
    "union_subject_inserts",
    f"""WITH {S.LIFE} SELECT 'link' AS subject, subject_id FROM life WHERE kind = 'link.added'
    UNION ALL SELECT 'sensor', 'sensor:room_' || (user_id % 2) FROM base
    UNION ALL SELECT 'todo', 'todoist:' || o_orderkey FROM orders
    UNION ALL SELECT 'todo', 'todoist:' || o_orderkey FROM orders WHERE o_orderkey % 7 = 0
    UNION ALL SELECT 'annotation', 'anno:a' || (user_id * 10 + event_id % 10) FROM base WHERE event_type = 'click'""",
)
def union_subject_inserts(spark, sf):
    parts = [
        adapters.lifecycle_events(spark, sf).filter("event_type = 'link.added'"),
        adapters.sensor_events(spark, sf),
        adapters.todo_events(spark, sf).filter("event_type = 'todo.created'"),
        adapters.annotation_events(spark, sf),
    ]
    out = None
    for frame in parts:
        rows = frame.select("subject", "subject_id")
        out = rows if out is None else out.unionByName(rows)
    return out
