"""Routing, retry and dead letter."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators import enrich, folds, routing
from tidemark.plans import sqltext as S
from tidemark.plans.ingest import NOW, now
from tidemark.plans.registry import flat, ntz, query
from tidemark.sources import adapters
from tidemark.sources.ledger import with_payload

# State as of the middle of the ledger; the events after it are the batch to route.
CUT = "2024-01-16 00:00:00"


def _state_and_batch(spark, sf):
    events = adapters.lifecycle_events(spark, sf, runs=False)
    cut = F.lit(CUT).cast("timestamp")
    p = folds.link_partials(events.filter(F.col("received_at") < cut))
    batch = with_payload(events.filter(F.col("received_at") >= cut))
    return folds.link_content(p), folds.link_metadata(p), folds.publish_state(p), batch


# The fold tables of the prefix: every reference to the ledger inside the fold reads the
# prefix, `batch` reads the rest.
_STATE = S.LIFE + ",\nwhole AS (SELECT * FROM life),\nbatch AS (SELECT * FROM whole WHERE ts >= TIMESTAMP '" + CUT + "')" + S.AFTER[
    len(S.LIFE) :
].replace(" life ", " past ").replace("life.*", "past.*")
_STATE = _STATE.replace(",\nanchor AS", ",\npast AS (SELECT * FROM whole WHERE ts < TIMESTAMP '" + CUT + "'),\nanchor AS", 1)


def _work(work_type: str, topic: str, payload: str, where: str) -> str:
    return f"""SELECT '{topic}' AS topic, subject_id, '{work_type}' AS work_type, id AS correlation_id, id AS triggered_by_event_id,
      1 AS attempt, 3 AS max_attempts, TIMESTAMP '{NOW}' AS created_at, CAST(NULL AS VARCHAR) AS last_error, {payload} AS payload
    FROM batch WHERE {where}"""


_FETCH = _work("fetch_link", "work.fetch_link", "'{\"url\":\"' || url || '\"}'",
               "kind = 'link.added' AND subject_id NOT IN (SELECT subject_id FROM link_content)")
_ENRICH = _work(
    "enrich_link", "work.enrich_link",
    "'{' || CASE WHEN title IS NULL THEN '' ELSE '\"title\":\"' || title || '\",' END || '\"text_content\":\"' || text_content || '\"}'",
    "kind = 'content.fetched' AND fetch_error IS NULL AND text_content IS NOT NULL "
    "AND subject_id NOT IN (SELECT subject_id FROM link_metadata WHERE tags <> '')")
_PUBLISH = _work("publish_link", "work.publish_link", "'{}'",
                 "kind = 'enrichment.completed' AND subject_id NOT IN (SELECT subject_id FROM publish_state "
                 "WHERE published_version >= desired_version AND NOT dirty)")


@query("route_fetch", f"WITH {_STATE} {_FETCH}")
def route_fetch(spark, sf):
    content, _, _, batch = _state_and_batch(spark, sf)
    return flat(routing.route_fetch(batch, content, now()))


@query("route_enrich", f"WITH {_STATE} {_ENRICH}")
def route_enrich(spark, sf):
    _, metadata, _, batch = _state_and_batch(spark, sf)
    return flat(routing.route_enrich(batch, metadata, now()))


@query("route_publish", f"WITH {_STATE} {_PUBLISH}")
def route_publish(spark, sf):
    _, _, publish, batch = _state_and_batch(spark, sf)
    return flat(routing.route_publish(batch, publish, now()))


@query("route_all", f"WITH {_STATE} {_FETCH} UNION ALL {_ENRICH} UNION ALL {_PUBLISH}")
def route_all(spark, sf):
    events = adapters.lifecycle_events(spark, sf)
    cut = F.lit(CUT).cast("timestamp")
    done = routing.stages_done(folds.link_rows(folds.link_partials(events.filter(F.col("received_at") < cut))))
    work, _ = routing.route_all(events.filter(F.col("received_at") >= cut), done, now())
    return flat(work)


_FAILED = f"""{S.BASE},
failed AS (
  SELECT event_id, 'link:' || (user_id * 10 + k % 10) AS subject_id, ['fetch_link', 'enrich_link', 'publish_link'][k % 3 + 1] AS work_type,
    'run-' || user_id AS correlation_id, 'ev-' || (event_id - 1) AS triggered_by_event_id, 1 + k % 3 AS attempt,
    'HTTP ' || (400 + k % 7) AS error, '{{"url":"https://site' || user_id || '.example.com/"}}' AS payload
  FROM base WHERE event_type = 'error' AND event_id % 11 <> 0)"""


@query(
    "retry_work",
    f"""WITH {_FAILED} SELECT 'work.' || work_type AS topic, subject_id, work_type, correlation_id, triggered_by_event_id,
      attempt + 1 AS attempt, 3 AS max_attempts, TIMESTAMP '{NOW}' AS created_at, error AS last_error, payload
    FROM failed WHERE attempt < 3""",
)
def retry_work(spark, sf):
    failed = routing.failed_work(with_payload(adapters.work_failures(spark, sf)))
    return flat(routing.retry_work(failed, now()))


@query(
    "dead_letters",
    f"""WITH {_FAILED} SELECT 'work.dead_letter' AS topic, subject_id, work_type, attempt, error AS final_error,
      TIMESTAMP '{NOW}' AS failed_at, 'fetcher' AS agent FROM failed WHERE attempt >= 3""",
)
def dead_letters(spark, sf):
    failed = routing.failed_work(with_payload(adapters.work_failures(spark, sf)))
    d = routing.dead_letters(failed, now())
    return d.select("topic", "original_work.subject_id", "original_work.work_type", "original_work.attempt", "final_error",
                    ntz("failed_at"), "agent")


@query(
    "work_records",
    f"""WITH {_FAILED} SELECT 'work.' || work_type AS topic, subject_id AS key,
      'work_type=' || work_type || ';attempt=' || (attempt + 1) AS headers, error AS last_error, payload, correlation_id AS run,
      triggered_by_event_id AS cause, CAST(attempt + 1 AS INTEGER) AS attempt FROM failed WHERE attempt < 3
    UNION ALL SELECT 'work.dead_letter', subject_id, 'work_type=' || work_type || ';agent=fetcher', error, payload, correlation_id,
      triggered_by_event_id, CAST(attempt AS INTEGER) FROM failed WHERE attempt >= 3""",
)
def work_records(spark, sf):
    failed = routing.failed_work(with_payload(adapters.work_failures(spark, sf)))
    head = F.array_join(F.transform("headers", lambda h: F.concat(h["key"], F.lit("="), h["value"].cast("string"))), ";").alias("headers")
    a = routing.work_records(routing.retry_work(failed, now()))
    b = routing.dead_letter_records(routing.dead_letters(failed, now()))
    def body(at: str) -> list:
        get = lambda name: F.get_json_object("value", f"$.{at}{name}")
        return [get("payload").alias("payload"), get("correlation_id").alias("run"), get("triggered_by_event_id").alias("cause"), get("attempt").cast("int").alias("attempt")]

    return a.select("topic", "key", head, F.get_json_object("value", "$.last_error").alias("last_error"), *body("")).unionByName(
        b.select("topic", "key", head, F.get_json_object("value", "$.final_error").alias("last_error"), *body("original_work."))
    )


def _fetch_results(spark, sf):
    k = F.col("k")
    return adapters.base_events(spark, sf).select(
        F.concat(F.lit("link:"), "user_id").alias("subject_id"),
        F.lit("fetch_link").alias("work_type"),
        F.concat(F.lit("run-"), "event_id").alias("correlation_id"),
        F.concat(F.lit("ev-"), "event_id").alias("triggered_by_event_id"),
        (F.lit(1) + k % 3).cast("int").alias("attempt"),
        F.lit(3).alias("max_attempts"),
        F.lit("2024-01-01T00:00:00Z").alias("created_at"),
        F.lit(None).cast("string").alias("last_error"),
        F.concat(F.lit('{"url":"https://site'), "user_id", F.lit('.example.com/"}')).alias("payload"),
        F.lit("https://final/").alias("final_url"),
        F.lit("t").alias("title"),
        F.when(k % 5 != 0, F.lit("text")).alias("text_content"),
        F.when(k % 2 == 0, F.lit("Timeout")).alias("error"),
    )


_MESSAGE = """'{"subject_id":"link:' || user_id || '","work_type":"fetch_link","correlation_id":"run-' || event_id || '","triggered_by_event_id":"ev-' || event_id
      || '","attempt":' || (1 + k % 3) || ',"max_attempts":3,"created_at":"2024-01-01T00:00:00Z","payload":"{\\"url\\":\\"https://site' || user_id || '.example.com/\\"}"}'"""


@query(
    "fetch_outcome",
    f"""WITH {S.BASE}, m AS (SELECT *, {_MESSAGE} AS message FROM base)
    SELECT 'link:' || user_id AS subject_id, 'run-' || event_id AS correlation_id, 'ev-' || event_id AS causation_id, 'agent:fetcher' AS source,
      CASE WHEN k % 10 = 0 THEN 'work.failed' ELSE 'content.fetched' END AS event_type,
      CASE WHEN k % 10 = 0 THEN '{{"work_message":' || message || ',"error":"Timeout","agent":"fetcher"}}'
        ELSE '{{"final_url":"https://final/","title":"t"' || CASE WHEN k % 5 <> 0 THEN ',"text_content":"text"' ELSE '' END
          || CASE WHEN k % 2 = 0 THEN ',"fetch_error":"Timeout"' ELSE '' END || '}}' END AS payload
    FROM m""",
)
def fetch_outcome(spark, sf):
    """Outcome events with their whole bodies."""
    return routing.fetch_outcome(_fetch_results(spark, sf))


def _events(outcome):
    return with_payload(outcome)


@query(
    "work_round_trip",
    f"""WITH {S.BASE} SELECT 'run-' || event_id AS correlation_id, CASE WHEN k % 3 < 2 THEN 'retry' ELSE 'dead' END AS kind,
      CAST(CASE WHEN k % 3 < 2 THEN 2 + k % 3 ELSE 3 END AS INTEGER) AS attempt, 'Timeout' AS error,
      '{{"url":"https://site' || user_id || '.example.com/"}}' AS payload FROM base WHERE k % 10 = 0""",
)
def work_round_trip(spark, sf):
    """Failed fetches as events and back: the retry, or the dead letter, has the first payload."""
    failed = routing.failed_work(_events(routing.fetch_outcome(_fetch_results(spark, sf))))
    now = F.lit("2024-02-01T00:00:00Z")
    again = routing.retry_work(failed, now).select("correlation_id", F.lit("retry").alias("kind"), "attempt", F.col("last_error").alias("error"), "payload")
    dead = routing.dead_letters(failed, now).select(
        "original_work.correlation_id", F.lit("dead").alias("kind"), "original_work.attempt", F.col("final_error").alias("error"), "original_work.payload"
    )
    return again.unionAll(dead)


def _whole_text_model(frame):
    """Answers from the whole content of a request; every seventh answer is broken."""
    import hashlib
    import json

    out = []
    for run, content in zip(frame["correlation_id"], frame["content"]):
        broken = int(run.split("-")[1]) % 7 == 3
        out.append("not json" if broken else json.dumps({"tags": [hashlib.md5(content.encode()).hexdigest()]}))
    return out


@query(
    "enrich_outcome",
    """SELECT 'run-' || doc_id AS correlation_id, CASE WHEN doc_id % 7 = 3 THEN 'work.failed' ELSE 'enrichment.completed' END AS event_type,
      'agent:enricher' AS source, CASE WHEN doc_id % 7 = 3 THEN 'Invalid response' ELSE md5(text) END AS outcome,
      CASE WHEN doc_id % 7 = 3 THEN md5(text) END AS work_text FROM documents WHERE text <> ''""",
)
def enrich_outcome(spark, sf):
    """Requests to the model and its answers to events; a failure carries the whole work payload."""
    work = adapters.enrich_work(spark, sf).filter("text_content <> ''")
    requests = work.select(
        "subject_id", "work_type", "correlation_id", F.lit("ev").alias("triggered_by_event_id"), F.lit(1).alias("attempt"), F.lit(3).alias("max_attempts"),
        F.lit("2024-01-01T00:00:00Z").alias("created_at"), F.col("text_content").alias("payload"), F.col("text_content").alias("content"),
    )
    events = _events(routing.enrich_outcome(*enrich.run_model(requests, _whole_text_model, "whole")))
    message = F.from_json("p.work_message", schemas.WORK_MESSAGE)
    return events.select(
        "correlation_id", "event_type", "source", F.coalesce(F.col("p.tags")[0], "p.error").alias("outcome"), F.md5(message["payload"]).alias("work_text")
    )


@query(
    "publish_outcome",
    f"""WITH {S.BASE} SELECT 'link:' || user_id AS subject_id, 'run-' || event_id AS correlation_id, 'ev-' || event_id AS causation_id,
      'agent:publisher' AS source, 'publish.completed' AS event_type, '{{"published_at":"2024-02-01T00:00:00.000Z"}}' AS payload FROM base WHERE k % 2 = 0""",
)
def publish_outcome(spark, sf):
    kind = F.when(F.col("attempt") > 0, F.when(F.col("error").isNotNull(), "publish_link").otherwise("fetch_link"))
    work = _fetch_results(spark, sf).withColumn("work_type", kind)
    return routing.publish_outcome(work, F.lit("2024-02-01T00:00:00Z").cast("timestamp"))


@query(
    "retry_backoff",
    f"""WITH {_FAILED} SELECT 'ev-' || event_id AS id, CAST(1000 * pow(2, attempt - 1) AS BIGINT) AS wait_ms FROM failed WHERE attempt < 3""",
)
def retry_backoff(spark, sf):
    """Waiting time of each retry, from the attempt that failed."""
    from tidemark import schemas
    from tidemark.functions.payload import backoff_ms

    e = with_payload(adapters.work_failures(spark, sf)).withColumn("w", F.from_json("p.work_message", schemas.WORK_MESSAGE))
    return e.filter(F.col("w.attempt") < F.col("w.max_attempts")).select("id", backoff_ms("w.attempt").alias("wait_ms"))
