"""Join operators not already part of a page read."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import catalog, domains, folds, patterns, reads, routing
from tidemark.plans import sqltext as S
from tidemark.plans.registry import flat, ntz, query
from tidemark.plans.state import TODO_STATE
from tidemark.plans.tables import link_tables
from tidemark.sources import adapters


@query(
    "not_yet_fetched",
    f"WITH {S.AFTER} SELECT subject_id FROM links_base WHERE subject_id NOT IN (SELECT subject_id FROM link_content)",
)
def not_yet_fetched(spark, sf):
    t = link_tables(spark, sf)
    return routing.without(t.links, routing.fetched_subjects(t.content)).select("subject_id")


@query(
    "not_yet_enriched",
    f"WITH {S.AFTER} SELECT subject_id FROM links_base WHERE subject_id NOT IN (SELECT subject_id FROM link_metadata WHERE tags <> '')",
)
def not_yet_enriched(spark, sf):
    t = link_tables(spark, sf)
    return routing.without(t.links, routing.enriched_subjects(t.metadata)).select("subject_id")


@query(
    "not_yet_published",
    f"""WITH {S.AFTER} SELECT subject_id FROM links_base WHERE subject_id NOT IN (
      SELECT subject_id FROM publish_state WHERE published_version >= desired_version AND NOT dirty)""",
)
def not_yet_published(spark, sf):
    t = link_tables(spark, sf)
    return routing.without(t.links, routing.published_subjects(t.publish)).select("subject_id")


@query(
    "with_parent_link",
    f"""WITH {S.LIFE}, l AS (SELECT DISTINCT subject_id FROM life WHERE kind = 'link.added')
    SELECT 'ev-' || event_id AS id, 'link:' || (user_id * 10 + k % 10) AS link_subject_id FROM base
    WHERE event_type = 'click' AND 'link:' || (user_id * 10 + k % 10) IN (SELECT subject_id FROM l)""",
)
def with_parent_link(spark, sf):
    from tidemark.sources.ledger import with_payload

    notes = with_payload(adapters.annotation_events(spark, sf)).select("id", "p.link_subject_id")
    links = adapters.lifecycle_events(spark, sf).filter("event_type = 'link.added'")
    return reads.with_parent(notes, links, "link_subject_id", salt_by="id")


@query(
    "public_children",
    f"""WITH {S.AFTER}, vis AS (
      SELECT subject_id, max_by(v, o) AS v FROM (
        SELECT 'link:' || (user_id * 10 + k % 10) AS subject_id, event_id * 2 + 1 AS o,
          CASE WHEN k % 5 = 0 THEN 'private' ELSE 'public' END AS v
        FROM base WHERE event_type = 'purchase' AND k % 5 <> 1) c JOIN anchor USING (subject_id)
      WHERE c.o > a * 2 GROUP BY subject_id)
    SELECT c.subject_id, title FROM link_content c LEFT JOIN vis USING (subject_id) WHERE coalesce(v, 'public') = 'public'""",
)
def public_children(spark, sf):
    t = link_tables(spark, sf, visibility=True)
    return reads.public_children(t.content, t.links).select("subject_id", "title")


@query(
    "causation_edges",
    f"""WITH {S.LIFE} SELECT c.id, c.kind AS event_type, c.ts AS occurred_at, p.id AS causation_id, p.kind AS parent_type, p.ts AS parent_at
    FROM life c JOIN life p ON p.event_id = c.event_id - 1 WHERE c.event_id % 4 = 0""",
)
def causation_edges(spark, sf):
    return flat(reads.causation_edges(adapters.lifecycle_events(spark, sf)))


@query(
    "todos_without_calendar",
    f"""WITH {TODO_STATE} SELECT subject_id, title, due_at AS start_at, due_at + INTERVAL 1 HOUR AS end_at FROM todos
    WHERE due_at IS NOT NULL AND CAST(split_part(subject_id, ':', 2) AS BIGINT) % 6 <> 0""",
)
def todos_without_calendar(spark, sf):
    """Every sixth order already has a calendar.event_created for its todo."""
    made = adapters.table(spark, sf, "orders").filter("o_orderkey % 6 = 0").select(
        F.lit("calendar.event_created").alias("event_type"),
        F.to_json(F.struct(F.concat(F.lit("todoist:"), "o_orderkey").alias("todo_subject_id"))).alias("payload"),
    )
    return flat(domains.todos_without_calendar(folds.todos(adapters.todo_events(spark, sf)), made))


@query(
    "cross_stream_daily",
    f"""WITH {S.ACTIVITY}, {S.CALENDAR},
    a AS (SELECT user_id, date_trunc('day', ts) AS day, count(*) AS n_links FROM activity GROUP BY ALL),
    b AS (SELECT user_id, date_trunc('day', start_at) AS day, count(*) AS n_meetings FROM calendar GROUP BY ALL)
    SELECT user_id, CAST(day AS TIMESTAMP) AS day, n_links, n_meetings, n_links * n_meetings AS n_pairs FROM a JOIN b USING (user_id, day)""",
)
def cross_stream_daily(spark, sf):
    return flat(domains.cross_stream_daily(adapters.activity(spark, sf), adapters.calendar(spark, sf)))


@query(
    "reading_context_by_meeting",
    f"""WITH {S.ACTIVITY}, {S.CALENDAR},
    p AS (SELECT topic, title, user_id, CAST(ts AS DATE) AS day FROM activity a JOIN calendar c USING (user_id)
      WHERE CAST(ts AS DATE) = CAST(start_at AS DATE))
    SELECT topic, title, count(*) AS n_pairs, count(DISTINCT (user_id, day)) AS n_days FROM p GROUP BY topic, title""",
)
def reading_context_by_meeting(spark, sf):
    return domains.reading_context_by_meeting(adapters.activity(spark, sf), adapters.calendar(spark, sf))


@query(
    "context_join",
    f"""WITH {S.SENSOR}, r AS (SELECT subject_id AS room, occurred_at, celsius FROM sensor WHERE celsius IS NOT NULL ),
    e AS (SELECT event_id, 'sensor:room_' || (user_id % 2) AS room, ts FROM events WHERE event_type = 'click')
    SELECT event_id, e.room, r.occurred_at AS reading_at, r.celsius AS reading
    FROM e ASOF LEFT JOIN r ON e.room = r.room AND e.ts >= r.occurred_at""",
)
def context_join(spark, sf):
    """Clicks of a user with the latest earlier reading of that user's room."""
    rooms = folds.temperature_readings(adapters.sensor_events(spark, sf)).select(
        F.col("subject_id").alias("room"), F.col("occurred_at").alias("ts"), "celsius"
    )
    e = (
        adapters.table(spark, sf, "events")
        .filter("event_type = 'click'")
        .select("event_id", F.concat(F.lit("sensor:room_"), F.col("user_id") % 2).alias("room"), "ts")
    )
    return flat(patterns.context_join(e, rooms, ["room"], "ts", "celsius").drop("ts"))


@query(
    "enrich_with_catalog",
    f"""WITH {S.LIFE},
    t AS (SELECT ord, unnest(string_split(tags, ',')) AS tag, generate_subscripts(string_split(tags, ','), 1) AS pos FROM life WHERE tags <> ''),
    f AS (SELECT tag, min(ord * 10 + pos) AS f FROM t GROUP BY tag)
    SELECT 'doc:' || doc_id AS subject_id, (SELECT string_agg(tag, ',' ORDER BY f) FROM f) AS known, CAST(0 AS BIGINT) AS n_left_out FROM documents""",
)
def enrich_with_catalog(spark, sf):
    work = adapters.enrich_work(spark, sf).select("subject_id")
    return flat(catalog.with_prompt_tags(work, catalog.tag_catalog(_enrichments(spark, sf))))


def _enrichments(spark, sf):
    from tidemark.sources.ledger import with_payload

    e = adapters.lifecycle_events(spark, sf).filter("event_type = 'enrichment.completed'")
    return with_payload(e).select("ord", "id", "subject_id", "p.tags")


@query(
    "voice_note_lookup",
    """SELECT 'rec-' || conv_id AS id, 'voice:' || conv_id AS subject_id, TIMESTAMP '2024-01-15' AS recorded_at,
      'audio/' || conv_id AS audio_storage_key, CASE WHEN conv_id % 4 <> 0 THEN max_by(text, turn) END AS transcription
    FROM conversations GROUP BY conv_id""",
)
def voice_note_lookup(spark, sf):
    """Recordings with the last transcription event that names them as its cause."""
    c = adapters.table(spark, sf, "conversations")
    at = F.lit("2024-01-15").cast("timestamp").alias("occurred_at")
    rec = F.concat(F.lit("rec-"), "conv_id")
    recorded = c.filter("turn = 0").select(
        F.lit(0).cast("bigint").alias("ord"), rec.alias("id"), F.concat(F.lit("voice:"), "conv_id").alias("subject_id"),
        F.lit("voice.recorded").alias("event_type"), at, F.lit(None).cast("string").alias("causation_id"),
        F.to_json(F.struct(F.concat(F.lit("audio/"), "conv_id").alias("audio_storage_key"))).alias("payload"),
    )
    said = c.filter("conv_id % 4 <> 0").select(
        (F.col("turn") + 1).alias("ord"), F.concat(F.lit("tr-"), "conv_id", F.lit("-"), "turn").alias("id"), rec.alias("subject_id"),
        F.lit("voice.transcribed").alias("event_type"), at, rec.alias("causation_id"),
        F.to_json(F.struct(F.col("text").alias("transcription"))).alias("payload"),
    )
    notes = domains.voice_notes(recorded.unionByName(said))
    return flat(notes.select("id", "subject_id", "recorded_at", "audio_storage_key", "transcription"))
