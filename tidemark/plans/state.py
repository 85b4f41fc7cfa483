"""State tables folded from the ledger."""

from __future__ import annotations

import functools
import uuid
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import domains, folds, history, merge
from tidemark.plans import sqltext as S
from tidemark.plans.registry import flat, query
from tidemark.session import shared_folder
from tidemark.sources import adapters, ledger

_VIS = f"""{S.AFTER},
vis AS (
  SELECT subject_id, max_by(v, o) AS v, max(o) AS o FROM (
    SELECT 'link:' || (user_id * 10 + k % 10) AS subject_id, event_id * 2 + 1 AS o,
      CASE WHEN k % 5 = 0 THEN 'private' ELSE 'public' END AS v
    FROM base WHERE event_type = 'purchase' AND k % 5 <> 1) c
  WHERE EXISTS (SELECT 1 FROM anchor n WHERE n.subject_id = c.subject_id AND c.o > n.a * 2)
  GROUP BY subject_id)"""

# Changes before A do not count, and the last change overall is after A or there is none.
_LINKS_SQL = f"""WITH {_VIS}
SELECT l.subject_id, url, url_norm, created_at, source, status, coalesce(vis.v, 'public') AS visibility, pinned,
  retry_count, last_error_at, last_error
FROM links l LEFT JOIN vis USING (subject_id)"""


@query("state_links", _LINKS_SQL)
def state_links(spark, sf):
    rows = folds.links(folds.link_partials(adapters.link_events(spark, sf)))
    return flat(rows.drop("added_ord"))


@query(
    "state_links_unique_url",
    f"""WITH {S.PAGE}, r AS (
      SELECT 'link:p' || page_id AS subject_id, 'https://' || host || '/' AS url_norm, page_id,
        row_number() OVER (PARTITION BY host ORDER BY page_id) AS rn FROM page_norm)
    SELECT subject_id, url_norm, page_id AS added_ord FROM r WHERE rn = 1""",
)
def state_links_unique_url(spark, sf):
    """Many subjects claim the root of one host; the first arrival keeps it."""
    from tidemark.functions.urls import domain

    p = adapters.table(spark, sf, "pages")
    events = p.select(
        F.col("page_id").alias("ord"),
        F.concat(F.lit("link:p"), "page_id").alias("subject_id"),
        F.lit("link.added").alias("event_type"),
        F.lit("2024-01-01").cast("timestamp").alias("occurred_at"),
        F.lit("chrome").alias("source"),
        F.to_json(F.struct(F.concat(F.lit("https://"), domain("url")).alias("url"))).alias("payload"),
    )
    rows = folds.unique_url(folds.links(folds.link_partials(events)))
    return rows.select("subject_id", "url_norm", "added_ord")


@query("state_link_status", f"WITH {S.AFTER} SELECT subject_id, status, retry_count, last_error_at, last_error FROM links")
def state_link_status(spark, sf):
    rows = folds.links(folds.link_partials(adapters.lifecycle_events(spark, sf)))
    return flat(rows.select("subject_id", "status", "retry_count", "last_error_at", "last_error"))


@query("state_link_content", f"WITH {S.AFTER} SELECT * FROM link_content")
def state_link_content(spark, sf):
    return flat(folds.link_content(folds.link_partials(adapters.lifecycle_events(spark, sf))))


@query("state_link_metadata", f"WITH {S.AFTER} SELECT * FROM link_metadata")
def state_link_metadata(spark, sf):
    return flat(folds.link_metadata(folds.link_partials(adapters.lifecycle_events(spark, sf))))


@query("state_publish_state", f"WITH {S.AFTER} SELECT * FROM publish_state")
def state_publish_state(spark, sf):
    return flat(folds.publish_state(folds.link_partials(adapters.lifecycle_events(spark, sf))))


@query(
    "state_links_sql_dialect",
    f"""WITH {S.LIFE},
    anchor AS (SELECT subject_id, min(ord) AS a0, max(ord) AS a FROM life WHERE kind = 'link.added' GROUP BY subject_id),
    f AS (SELECT subject_id, max(ord) AS s_ord, max(ord) FILTER (WHERE fetch_error IS NOT NULL AND ord > a) AS e_ord,
        count(*) FILTER (WHERE fetch_error IS NOT NULL AND ord > a) AS n_err
      FROM life JOIN anchor USING (subject_id) GROUP BY subject_id)
    SELECT l.subject_id, l.url, l.url AS url_norm, l.ts AS created_at, l.source,
      CASE WHEN s.fetch_error IS NOT NULL THEN 'error' WHEN s.kind = 'link.added' THEN 'new'
        WHEN s.kind = 'content.fetched' THEN 'fetched' WHEN s.kind = 'enrichment.completed' THEN 'enriched'
        ELSE 'published' END AS status,
      'public' AS visibility, FALSE AS pinned, CAST(n_err AS INTEGER) AS retry_count,
      e.ts AS last_error_at, e.fetch_error AS last_error
    FROM anchor n JOIN life l ON l.ord = n.a JOIN f ON f.subject_id = n.subject_id
      JOIN life s ON s.ord = f.s_ord LEFT JOIN life e ON e.ord = f.e_ord""",
)
def state_links_sql_dialect(spark, sf):
    return flat(folds.links_sql(adapters.lifecycle_events(spark, sf)))


@query(
    "state_link_content_sql_dialect",
    f"""WITH {S.AFTER}
    SELECT f.subject_id, c.final_url, c.title, c.text_content, CAST(NULL AS VARCHAR) AS html_storage_key,
      c.ts AS fetched_at, c.fetch_error FROM facts f JOIN life c ON c.ord = f.c_ord""",
)
def state_link_content_sql_dialect(spark, sf):
    return flat(folds.link_content_sql(adapters.lifecycle_events(spark, sf)))


@query("state_link_metadata_sql_dialect", f"WITH {S.AFTER} SELECT * FROM link_metadata")
def state_link_metadata_sql_dialect(spark, sf):
    """Tags never vanish here: the adapter always sends the field, '[]' keeps the old array."""
    return flat(folds.link_metadata_sql(adapters.lifecycle_events(spark, sf)))


@query(
    "state_publish_state_sql_dialect",
    f"""WITH {S.LIFE}, f AS (
      SELECT subject_id, max(ord) FILTER (WHERE kind = 'enrichment.completed') AS e,
        max(ord) FILTER (WHERE kind = 'publish.completed') AS p
      FROM life WHERE kind IN ('enrichment.completed', 'publish.completed') GROUP BY subject_id)
    SELECT f.subject_id, CASE WHEN e IS NOT NULL THEN 1 ELSE 0 END AS desired_version,
      CASE WHEN p > coalesce(e, -1) THEN 1 ELSE 0 END AS published_version,
      NOT coalesce(p > coalesce(e, -1), FALSE) AS dirty,
      CASE WHEN p > coalesce(e, -1) THEN l.ts END AS last_published_at
    FROM f LEFT JOIN life l ON l.ord = f.p""",
)
def state_publish_state_sql_dialect(spark, sf):
    return flat(folds.publish_state_sql(adapters.lifecycle_events(spark, sf)))


_SUBJECTS_SQL = f"""WITH {S.LIFE},
raw AS (
  SELECT 'link' AS subject, subject_id, ord * 10 AS o, ts, NULL AS title, 'public' AS v, '{{}}' AS meta
    FROM life WHERE kind = 'link.added'
  UNION ALL
  SELECT 'sensor', 'sensor:room_' || (user_id % 2), event_id * 10 + 1, ts, NULL, 'private', '{{"type":"temperature"}}'
    FROM base WHERE k % 50 <> 0
  UNION ALL
  SELECT 'annotation', 'anno:a' || (user_id * 10 + event_id % 10), event_id * 10 + 2, ts, NULL,
    CASE WHEN k % 5 = 0 THEN 'public' ELSE 'private' END, '{{}}' FROM base WHERE event_type = 'click'
  UNION ALL
  SELECT 'todo', 'todoist:' || o_orderkey, (o_orderkey * 4) * 10, o_orderdate, o_orderpriority, 'private',
    '{{"source":"todoist"}}' FROM orders
  UNION ALL
  SELECT 'todo', 'todoist:' || o_orderkey, (o_orderkey * 4 + 2) * 10, o_orderdate + INTERVAL 2 HOUR,
    'again ' || o_orderpriority, 'private', '{{"source":"todoist"}}' FROM orders WHERE o_orderkey % 7 = 0),
first AS (
  SELECT subject, subject_id, min(o) AS o, min_by(ts, o) AS created_at, max_by(title, o) AS display_name,
    min_by(v, o) AS v, min_by(meta, o) AS meta FROM raw GROUP BY ALL),
vis AS (
  SELECT 'link:' || (user_id * 10 + k % 10) AS subject_id, max(event_id * 10 + 3) AS o,
    max_by(CASE WHEN k % 5 = 0 THEN 'private' ELSE 'public' END, event_id) AS v
  FROM base WHERE event_type = 'purchase' AND k % 5 <> 1 GROUP BY 1)
SELECT subject, f.subject_id, created_at, display_name,
  CASE WHEN vis.o > f.o THEN vis.v ELSE f.v END AS visibility, meta
FROM first f LEFT JOIN vis USING (subject_id)"""


def all_events(spark, sf):
    """Links, sensors, annotations, todos and visibility changes in one arrival order."""
    parts = [
        (adapters.lifecycle_events(spark, sf), 0),
        (adapters.sensor_events(spark, sf), 1),
        (adapters.annotation_events(spark, sf), 2),
        (adapters.visibility_events(spark, sf), 3),
        (adapters.todo_events(spark, sf), 0),
    ]
    names = ["ord", "id", "occurred_at", "received_at", "source", "subject", "subject_id", "event_type", "payload"]
    out = None
    for frame, slot in parts:
        rows = frame.select(*names).withColumn("ord", F.col("ord") * 10 + slot)
        out = rows if out is None else out.unionByName(rows)
    return out


@query("state_subjects", _SUBJECTS_SQL)
def state_subjects(spark, sf):
    return flat(folds.subjects(all_events(spark, sf)))


@query(
    "state_temperature_readings",
    f"""WITH {S.SENSOR}, h AS (SELECT *, date_trunc('hour', occurred_at) AS hour_at FROM sensor WHERE celsius IS NOT NULL)
    SELECT subject_id, hour_at AS occurred_at, min_by(celsius, ord) AS celsius, min_by(humidity, ord) AS humidity,
      CAST(NULL AS DOUBLE) AS battery FROM h GROUP BY subject_id, hour_at""",
)
def state_temperature_readings(spark, sf):
    return flat(folds.temperature_readings(adapters.minute_sensor_events(spark, sf)))


@query(
    "state_temperature_readings_sql_dialect",
    f"""WITH {S.SENSOR}, h AS (SELECT *, date_trunc('hour', occurred_at) AS hour_at FROM sensor WHERE celsius IS NOT NULL)
    SELECT subject_id, hour_at AS occurred_at, max_by(celsius, ord) AS celsius, max_by(humidity, ord) AS humidity,
      CAST(NULL AS DOUBLE) AS battery FROM h GROUP BY subject_id, hour_at""",
)
def state_temperature_readings_sql_dialect(spark, sf):
    return flat(folds.temperature_readings(adapters.minute_sensor_events(spark, sf), dialect="sql"))


@query(
    "state_temperature_latest",
    f"""WITH {S.SENSOR} SELECT subject_id, max(occurred_at) AS occurred_at, max_by(celsius, occurred_at) AS celsius,
      max_by(humidity, occurred_at) AS humidity, CAST(NULL AS DOUBLE) AS battery
    FROM sensor WHERE celsius IS NOT NULL GROUP BY subject_id""",
)
def state_temperature_latest(spark, sf):
    return flat(folds.temperature_latest(adapters.sensor_events(spark, sf, shuffled=True)))


@query(
    "state_temperature_latest_sql_dialect",
    f"""WITH {S.SENSOR} SELECT subject_id, max_by(occurred_at, mixed) AS occurred_at, max_by(celsius, mixed) AS celsius,
      max_by(humidity, mixed) AS humidity, CAST(NULL AS DOUBLE) AS battery
    FROM sensor WHERE celsius IS NOT NULL GROUP BY subject_id""",
)
def state_temperature_latest_sql_dialect(spark, sf):
    return flat(folds.temperature_latest(adapters.sensor_events(spark, sf, shuffled=True), dialect="sql"))


TODO_STATE = f"""{S.TODO},
todos AS (
  SELECT subject_id, max_by(title, ord) FILTER (WHERE kind = 'created') AS title,
    max_by(project, ord) FILTER (WHERE project IS NOT NULL) AS project,
    max_by(labels, ord) FILTER (WHERE kind = 'created') AS labels,
    CASE WHEN count(*) FILTER (WHERE kind = 'completed') > 0 THEN 'done' ELSE 'open' END AS status,
    max_by(due_at, ord) FILTER (WHERE due_at IS NOT NULL) AS due_at,
    max(ts) FILTER (WHERE kind = 'completed') AS completed_at, '{{"source":"todoist"}}' AS meta
  FROM todo_events GROUP BY subject_id)"""


@query("state_todos", f"WITH {TODO_STATE} SELECT * FROM todos")
def state_todos(spark, sf):
    return flat(folds.todos(adapters.todo_events(spark, sf)))


@query(
    "state_annotations",
    f"""WITH {S.LIFE},
    parent AS (SELECT subject_id, min(ord) AS a FROM life WHERE kind = 'link.added' GROUP BY subject_id),
    note AS (
      SELECT event_id, ts, 'a' || (user_id * 10 + event_id % 10) AS annotation_id,
        'link:' || (user_id * 10 + k % 10) AS link_subject_id,
        CASE WHEN k % 2 = 0 THEN 'quote ' || k END AS quote, CASE WHEN k % 3 = 0 THEN 'note ' || k END AS note,
        CASE WHEN k % 4 = 0 THEN '{{"page":' || k || '}}' ELSE '{{}}' END AS selector,
        CASE WHEN k % 5 = 0 THEN 'public' ELSE 'private' END AS visibility
      FROM base WHERE event_type = 'click'),
    made AS (
      SELECT annotation_id, min(event_id) AS first FROM note JOIN parent ON link_subject_id = subject_id
      WHERE event_id > a GROUP BY annotation_id),
    live AS (SELECT note.*, first FROM note JOIN made USING (annotation_id) WHERE event_id >= first)
    SELECT annotation_id, 'anno:' || annotation_id AS subject_id,
      max(link_subject_id) FILTER (WHERE event_id = first) AS link_subject_id,
      max(ts) FILTER (WHERE event_id = first) AS created_at,
      CASE WHEN max(event_id) > max(first) THEN max_by(ts, event_id) END AS updated_at,
      max_by(quote, event_id) FILTER (WHERE quote IS NOT NULL) AS quote,
      max_by(note, event_id) FILTER (WHERE note IS NOT NULL) AS note,
      max_by(selector, event_id) AS selector,
      max(visibility) FILTER (WHERE event_id = first) AS visibility
    FROM live GROUP BY annotation_id""",
)
def state_annotations(spark, sf):
    names = ["ord", "subject_id", "event_type", "occurred_at", "payload"]
    events = adapters.lifecycle_events(spark, sf).select(*names).unionByName(
        adapters.annotation_events(spark, sf).select(*names)
    )
    return flat(folds.annotations(events))


@query(
    "state_calendar_events",
    """WITH e AS (
      SELECT o_orderkey AS ord, o_orderdate AS ts, 'c' || (o_custkey % 5) AS calendar_id,
        'e:' || (o_orderkey - CASE WHEN o_orderkey % 3 = 2 THEN 1 ELSE 0 END) AS external_event_id,
        o_orderpriority AS title, CASE WHEN o_orderkey % 5 = 0 THEN 'order ' || o_orderkey END AS description,
        TIMESTAMP '2024-01-01 09:00:00' + to_days(CAST(o_orderkey % 30 AS INTEGER)) AS start_at,
        'p' || (o_custkey % 4) || ',p' || (o_custkey % 3) AS attendees FROM orders)
    SELECT 'gcal:' || calendar_id || ':' || external_event_id AS subject_id, calendar_id, external_event_id,
      max_by(title, ord) AS title,
      CASE WHEN max(ord) = max(ord) FILTER (WHERE description IS NOT NULL)
        THEN max_by(description, ord) FILTER (WHERE description IS NOT NULL) END AS description,
      max_by(start_at, ord) AS start_at, max_by(start_at, ord) + INTERVAL 1 HOUR AS end_at,
      CAST(NULL AS VARCHAR) AS location, max_by(attendees, ord) AS attendees, 'confirmed' AS status,
      min_by(ts, ord) AS created_at
    FROM e GROUP BY calendar_id, external_event_id""",
)
def state_calendar_events(spark, sf):
    return flat(domains.calendar_events(adapters.calendar_events(spark, sf)))


@query(
    "state_voice_notes",
    """SELECT 'voice:' || conv_id AS note_id, CAST(turn // 4 AS BIGINT) AS part,
      string_agg(text, ' ' ORDER BY turn) AS transcription, count(*) AS segments
    FROM conversations GROUP BY conv_id, turn // 4""",
)
def state_voice_notes(spark, sf):
    return domains.transcript_parts(adapters.voice_segments(spark, sf), turns_per_part=4)


@query(
    "state_as_of",
    f"""WITH {S.LIFE.replace('FROM events', "FROM events WHERE ts <= TIMESTAMP '2024-01-15 00:00:00'")},
    {S.AFTER[len(S.LIFE) + 1:]}
    SELECT subject_id, status, retry_count, last_error_at, last_error FROM links""",
)
def state_as_of(spark, sf):
    """Replay up to a moment: the same fold over a prefix of the ledger."""
    events = ledger.as_of(adapters.lifecycle_events(spark, sf), F.lit("2024-01-15").cast("timestamp"))
    rows = folds.links(folds.link_partials(events))
    return flat(rows.select("subject_id", "status", "retry_count", "last_error_at", "last_error"))


@query("state_delta_merge", f"WITH {S.AFTER} SELECT * FROM publish_state")
def state_delta_merge(spark, sf):
    """Two batches folded one after the other give the state of the whole ledger."""
    events = adapters.lifecycle_events(spark, sf)
    cut = F.lit("2024-01-16").cast("timestamp")
    first = folds.link_partials(events.filter(F.col("received_at") < cut))
    second = folds.link_partials(events.filter(F.col("received_at") >= cut), known=first)
    return flat(folds.publish_state(folds.merge_partials(first, second)))


@query(
    "state_merge_policies",
    f"""WITH {S.AFTER}
    SELECT coalesce(m.subject_id, c.subject_id) AS subject_id, coalesce(c.title, m.summary_short) AS label,
      CASE WHEN m.subject_id IS NULL THEN '' ELSE m.tags END AS tags,
      CAST(coalesce(c.n, 0) + CASE WHEN m.subject_id IS NULL THEN 0 ELSE 1 END AS BIGINT) AS seen
    FROM link_metadata m FULL JOIN (SELECT subject_id, title, 1 AS n FROM link_content) c USING (subject_id)""",
)
def state_merge_policies(spark, sf):
    """coalesce, nonempty and add rules over a full outer merge of two tables."""
    partials = folds.link_partials(adapters.lifecycle_events(spark, sf))
    current = folds.link_metadata(partials).select(
        "subject_id", F.col("summary_short").alias("label"), "tags", F.lit(1).cast("bigint").alias("seen")
    )
    changes = folds.link_content(partials).select(
        "subject_id",
        F.col("title").alias("label"),
        F.array().cast("array<string>").alias("tags"),
        F.lit(1).cast("bigint").alias("seen"),
    )
    return flat(merge.merge_state(current, changes, ["subject_id"], {"label": "coalesce", "tags": "nonempty", "seen": "add"}))


@query(
    "state_partial_update",
    f"""WITH {S.LIFE},
    l AS (SELECT subject_id, max(url) AS url FROM life WHERE kind = 'link.added' GROUP BY subject_id),
    u AS (
      SELECT subject_id, max(ord) FILTER (WHERE kind <> 'link.added') AS s_ord,
        max(ord) FILTER (WHERE fetch_error IS NOT NULL) AS e_ord,
        count(*) FILTER (WHERE fetch_error IS NOT NULL) AS n FROM life GROUP BY subject_id)
    SELECT l.subject_id, l.url,
      CASE WHEN s.kind IS NULL THEN 'new' WHEN s.fetch_error IS NOT NULL THEN 'error'
        WHEN s.kind = 'content.fetched' THEN 'fetched' WHEN s.kind = 'enrichment.completed' THEN 'enriched'
        ELSE 'published' END AS status,
      'public' AS visibility, CAST(n AS INTEGER) AS retry_count, e.ts AS last_error_at, e.fetch_error AS last_error
    FROM l JOIN u USING (subject_id) LEFT JOIN life s ON s.ord = u.s_ord LEFT JOIN life e ON e.ord = u.e_ord""",
)
def state_partial_update(spark, sf):
    """Update-only changes applied to freshly inserted link rows."""
    events = ledger.with_payload(adapters.lifecycle_events(spark, sf))
    fresh = (
        events.filter(F.col("event_type") == "link.added")
        .groupBy("subject_id")
        .agg(F.max("p.url").alias("url"))
        .select(
            "subject_id",
            "url",
            F.lit("new").alias("status"),
            F.lit("public").alias("visibility"),
            F.lit(0).alias("retry_count"),
            F.lit(None).cast("timestamp").alias("last_error_at"),
            F.lit(None).cast("string").alias("last_error"),
        )
    )
    return flat(merge.partial_update(fresh, merge.updates_from_events(events)))


MOMENTS = ("2024-01-02 06:00:00", "2024-01-09 12:30:00", "2024-01-15 00:00:00", "2024-01-22 23:59:59", "2024-03-01 00:00:00")


def _links_at(moment: str) -> str:
    return f"""(WITH {S.LIFE.replace("FROM events", f"FROM events WHERE ts <= TIMESTAMP '{moment}'")}, {S.AFTER[len(S.LIFE) + 1 :]}
    SELECT TIMESTAMP '{moment}' AS moment, subject_id, status, visibility, retry_count, last_error_at, last_error FROM links)"""


def _stored_history(spark, sf) -> str:
    folder = f"{shared_folder(spark)}/history-{uuid.uuid4().hex}"
    history.write_history(history.link_history(adapters.lifecycle_events(spark, sf)), folder, "week")
    return folder


@query("link_history_as_of", " UNION ALL ".join(_links_at(m) for m in MOMENTS))
def link_history_as_of(spark, sf):
    """The states at five moments, each read from one part of the stored history."""
    folder = _stored_history(spark, sf)
    at = [history.read_as_of(spark, folder, datetime.fromisoformat(m), "week").withColumn("moment", F.lit(m).cast("timestamp")) for m in MOMENTS]
    return flat(functools.reduce(DataFrame.unionByName, at))


@query(
    "link_history_changes",
    f"""WITH x AS {_links_at(MOMENTS[1])}, y AS {_links_at(MOMENTS[3])}
    SELECT coalesce(x.subject_id, y.subject_id) AS subject_id, x.status AS before, y.status AS after, y.retry_count - coalesce(x.retry_count, 0) AS more_errors
    FROM x FULL JOIN y ON x.subject_id = y.subject_id WHERE x.subject_id IS NULL OR (x.status, x.retry_count, x.last_error_at, x.last_error) IS DISTINCT FROM (y.status, y.retry_count, y.last_error_at, y.last_error)""",
)
def link_history_changes(spark, sf):
    changed = history.changes_between(spark, _stored_history(spark, sf), *(datetime.fromisoformat(MOMENTS[i]) for i in (1, 3)), period="week")
    more = F.col("after.retry_count") - F.coalesce("before.retry_count", F.lit(0))
    return changed.select("subject_id", F.col("before.status").alias("before"), F.col("after.status").alias("after"), more.alias("more_errors"))
