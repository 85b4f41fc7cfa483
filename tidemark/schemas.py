"""Row shapes of the ledger, the work queues and the state tables (DDL strings)."""

EVENT = (
    "id STRING, occurred_at TIMESTAMP, received_at TIMESTAMP, source STRING, subject STRING, "
    "subject_id STRING, event_type STRING, schema_version INT, payload STRING, "
    "correlation_id STRING, causation_id STRING"
)

# Ledger rows also carry the broker bookkeeping columns.
LEDGER = EVENT + (
    ", kafka_topic STRING, kafka_partition INT, kafka_offset BIGINT, published_to_kafka BOOLEAN"
)

WORK_MESSAGE = (
    "subject_id STRING, work_type STRING, correlation_id STRING, triggered_by_event_id STRING, "
    "attempt INT, max_attempts INT, created_at STRING, last_error STRING, payload STRING"
)

# Union of the payload fields the folds and the router read. `from_json` with this
# type is pruned by Catalyst to the fields a query touches.
PAYLOAD = (
    "url STRING, url_norm STRING, final_url STRING, title STRING, text_content STRING, "
    "html_storage_key STRING, fetch_error STRING, tags ARRAY<STRING>, summary_short STRING, "
    "summary STRING, summary_long STRING, language STRING, model_version STRING, "
    "celsius DOUBLE, humidity DOUBLE, battery DOUBLE, project STRING, labels ARRAY<STRING>, "
    "due_at STRING, visibility STRING, annotation_id STRING, link_subject_id STRING, "
    "quote STRING, note STRING, selector STRING, work_message STRING, error STRING, agent STRING"
)

CALENDAR_PAYLOAD = (
    "title STRING, description STRING, start_at STRING, end_at STRING, location STRING, "
    "attendees ARRAY<STRING>, todo_subject_id STRING, external_event_id STRING"
)

VOICE_PAYLOAD = (
    "audio_storage_key STRING, duration_seconds DOUBLE, transcription STRING, "
    "transcription_model STRING, language STRING, activity STRING, "
    "location STRUCT<latitude: DOUBLE, longitude: DOUBLE, place_name: STRING>"
)

ENRICHMENT_RESPONSE = (
    "tags ARRAY<STRING>, summary_short STRING, summary_long STRING, language STRING"
)

# Fixed values of the data model.
EVENT_TYPES = (
    "link.added",
    "content.fetched",
    "enrichment.completed",
    "publish.completed",
    "temp.reading_recorded",
    "todo.created",
    "todo.completed",
    "link.visibility_changed",
    "annotation.added",
)
LINK_STATUSES = ("new", "fetched", "enriched", "published", "error")
VISIBILITIES = ("public", "private")
WORK_TOPICS = {
    "fetch_link": "work.fetch_link",
    "enrich_link": "work.enrich_link",
    "publish_link": "work.publish_link",
}
DEAD_LETTER_TOPIC = "work.dead_letter"
MAX_ATTEMPTS = 3
MAX_CONTENT_CHARS = 32000
MAX_TAGS_IN_PROMPT = 100
