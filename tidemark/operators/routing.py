"""Routing of events to work messages, with retry and dead letter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions.payload import present
from tidemark.operators.skew import skew_join
from tidemark.sources.ledger import with_payload

WORK = tuple(field.split()[0] for field in schemas.WORK_MESSAGE.split(", "))
ROUTED_TYPES = ("link.added", "content.fetched", "enrichment.completed", "work.failed")


def _work(events: DataFrame, work_type: str, payload: Column, now: Column) -> DataFrame:
    """First-attempt work messages; the run id falls back to the event id."""
    return events.select(
        F.lit(schemas.WORK_TOPICS[work_type]).alias("topic"),
        "subject_id",
        F.lit(work_type).alias("work_type"),
        F.coalesce("correlation_id", "id").alias("correlation_id"),
        F.col("id").alias("triggered_by_event_id"),
        F.lit(1).alias("attempt"),
        F.lit(schemas.MAX_ATTEMPTS).alias("max_attempts"),
        now.alias("created_at"),
        F.lit(None).cast("string").alias("last_error"),
        payload.alias("payload"),
    )


def without(rows: DataFrame, done: DataFrame, salt_by: str = "subject_id") -> DataFrame:
    """Rows whose subject is not in `done`; the done side is one narrow column.

    Event rows of one subject are told apart by `salt_by`; tables with one row per
    subject need no salt.
    """
    done = done.select("subject_id")
    if salt_by == "subject_id":
        return rows.join(done, "subject_id", "left_anti")
    return skew_join(rows, done, ["subject_id"], "left_anti", salt_by=salt_by)


def fetched_subjects(content: DataFrame) -> DataFrame:
    return content.select("subject_id")


def enriched_subjects(metadata: DataFrame) -> DataFrame:
    return metadata.filter(F.size("tags") > 0).select("subject_id")


def published_subjects(publish_state: DataFrame) -> DataFrame:
    return publish_state.filter(
        (F.col("published_version") >= F.col("desired_version")) & ~F.col("dirty")
    ).select("subject_id")


def route_fetch(decoded: DataFrame, content: DataFrame, now: Column) -> DataFrame:
    rows = decoded.filter((F.col("event_type") == "link.added") & present("p.url"))
    return _work(without(rows, fetched_subjects(content), "id"), "fetch_link", F.to_json(F.struct("p.url")), now)


def route_enrich(decoded: DataFrame, metadata: DataFrame, now: Column) -> DataFrame:
    rows = decoded.filter(
        (F.col("event_type") == "content.fetched") & ~present("p.fetch_error") & present("p.text_content")
    )
    payload = F.to_json(F.struct("p.title", "p.text_content"))
    return _work(without(rows, enriched_subjects(metadata), "id"), "enrich_link", payload, now)


def route_publish(decoded: DataFrame, publish_state: DataFrame, now: Column) -> DataFrame:
    rows = decoded.filter(F.col("event_type") == "enrichment.completed")
    return _work(without(rows, published_subjects(publish_state), "id"), "publish_link", F.lit("{}"), now)


def failed_work(decoded: DataFrame) -> DataFrame:
    """work.failed events with their embedded work message; rows without one are dropped."""
    return (
        decoded.filter((F.col("event_type") == "work.failed") & F.col("p.work_message").isNotNull())
        .withColumn("w", F.from_json("p.work_message", schemas.WORK_MESSAGE))
        .select("w", F.col("p.error").alias("error"), F.col("p.agent").alias("agent"))
    )


def retry_work(failed: DataFrame, now: Column) -> DataFrame:
    """Same message, next attempt."""
    return failed.filter(F.col("w.attempt") < F.col("w.max_attempts")).select(
        F.concat(F.lit("work."), "w.work_type").alias("topic"),
        "w.subject_id",
        "w.work_type",
        "w.correlation_id",
        "w.triggered_by_event_id",
        (F.col("w.attempt") + 1).alias("attempt"),
        "w.max_attempts",
        now.alias("created_at"),
        F.col("error").alias("last_error"),
        "w.payload",
    )


def dead_letters(failed: DataFrame, now: Column) -> DataFrame:
    return failed.filter(~(F.col("w.attempt") < F.col("w.max_attempts"))).select(
        F.lit(schemas.DEAD_LETTER_TOPIC).alias("topic"),
        F.col("w").alias("original_work"),
        F.col("error").alias("final_error"),
        now.alias("failed_at"),
        "agent",
    )


def stages_done(rows: DataFrame) -> DataFrame:
    """Which stages each subject has behind it, from the wide link rows."""
    no = F.lit(False)
    return rows.select(
        "subject_id",
        F.col("fetched_at").isNotNull().alias("has_content"),
        F.coalesce(F.size("tags") > 0, no).alias("has_tags"),
        F.coalesce((F.col("published_version") >= F.col("desired_version")) & ~F.col("dirty"), no).alias("is_published"),
    )


def route_all(events: DataFrame, done: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(work, dead letters). `done` is the state as of the start of the batch, one row per
    subject (`stages_done`); repeats of one trigger inside the batch collapse.

    Every event meets the state once, and its type decides what it may start.
    """
    decoded = with_payload(events.filter(F.col("event_type").isin(*ROUTED_TYPES)))
    kind = F.col("event_type")
    starts = {
        "fetch_link": (kind == "link.added") & present("p.url"),
        "enrich_link": (kind == "content.fetched") & ~present("p.fetch_error") & present("p.text_content"),
        "publish_link": kind == "enrichment.completed",
    }
    behind = {"fetch_link": "has_content", "enrich_link": "has_tags", "publish_link": "is_published"}
    payloads = {"fetch_link": F.to_json(F.struct("p.url")), "enrich_link": F.to_json(F.struct("p.title", "p.text_content")), "publish_link": F.lit("{}")}

    def choose(values: dict[str, Column]) -> Column:
        first, second, third = (F.when(starts[w], values[w]) for w in starts)
        return F.coalesce(first, second, third)

    # The trigger is decided before the join, so only possible triggers are moved.
    work_type = choose({w: F.lit(w) for w in starts})
    triggers = decoded.select(
        "id", "subject_id", "correlation_id", work_type.alias("work_type"), choose(payloads).alias("payload")
    ).filter(F.col("work_type").isNotNull())
    met = skew_join(triggers, done, ["subject_id"], "left", salt_by="id")
    held = F.coalesce(*[F.when(F.col("work_type") == w, F.col(c)) for w, c in behind.items()], F.lit(False))
    work = met.filter(~held).select(
        F.concat(F.lit("work."), "work_type").alias("topic"),
        "subject_id",
        "work_type",
        F.coalesce("correlation_id", "id").alias("correlation_id"),
        F.col("id").alias("triggered_by_event_id"),
        F.lit(1).alias("attempt"),
        F.lit(schemas.MAX_ATTEMPTS).alias("max_attempts"),
        now.alias("created_at"),
        F.lit(None).cast("string").alias("last_error"),
        "payload",
    )
    failed = failed_work(decoded)
    work = work.dropDuplicates(["subject_id", "work_type", "triggered_by_event_id"]).unionByName(retry_work(failed, now))
    return work, dead_letters(failed, now)


def work_records(work: DataFrame) -> DataFrame:
    """Broker rows of work messages: topic, key, JSON value, headers."""
    body = [c for c in work.columns if c != "topic"]
    return work.select(
        "topic",
        F.col("subject_id").alias("key"),
        F.to_json(F.struct(*body)).alias("value"),
        _headers({"work_type": F.col("work_type"), "attempt": F.col("attempt").cast("string")}),
    )


def dead_letter_records(dead: DataFrame) -> DataFrame:
    return dead.select(
        "topic",
        F.col("original_work.subject_id").alias("key"),
        F.to_json(F.struct("original_work", "final_error", "failed_at", "agent")).alias("value"),
        _headers({"work_type": F.col("original_work.work_type"), "agent": F.col("agent")}),
    )


def _headers(values: dict[str, Column]) -> Column:
    return F.array(
        *[F.struct(F.lit(k).alias("key"), v.cast("binary").alias("value")) for k, v in values.items()]
    ).alias("headers")


def _message(rows: DataFrame) -> Column:
    """The whole work message of a row, payload and last error included."""
    return F.struct(*[F.col(c) for c in WORK if c in rows.columns])


def _failure(rows: DataFrame, error: Column, agent: str) -> Column:
    return F.to_json(F.struct(_message(rows).alias("work_message"), error.alias("error"), F.lit(agent).alias("agent")))


def _outcome(rows: DataFrame, agent: str, event_type: Column, payload: Column) -> DataFrame:
    return rows.select(
        "subject_id",
        "correlation_id",
        F.col("triggered_by_event_id").alias("causation_id"),
        F.lit(f"agent:{agent}").alias("source"),
        event_type.alias("event_type"),
        payload.alias("payload"),
    )


def fetch_outcome(results: DataFrame) -> DataFrame:
    """work.failed for an error without text, otherwise content.fetched.

    `results` has the work message columns plus final_url, title, text_content, error.
    """
    failed = present("error") & ~present("text_content")
    content = F.to_json(F.struct("final_url", "title", "text_content", F.col("error").alias("fetch_error")))
    return _outcome(
        results,
        "fetcher",
        F.when(failed, "work.failed").otherwise("content.fetched"),
        F.when(failed, _failure(results, F.col("error"), "fetcher")).otherwise(content),
    )


def enrich_outcome(enriched: DataFrame, failed: DataFrame) -> DataFrame:
    """enrichment.completed for a model's good rows, work.failed for the others.

    Both sides of `run_model`, each with the work message columns.
    """
    fields = [c for c in ("tags", "summary_short", "summary_long", "language", "model_version") if c in enriched.columns]
    done = _outcome(enriched, "enricher", F.lit("enrichment.completed"), F.to_json(F.struct(*fields)))
    return done.unionAll(_outcome(failed, "enricher", F.lit("work.failed"), _failure(failed, F.col("error"), "enricher")))


def publish_outcome(work: DataFrame, now: Column) -> DataFrame:
    """publish.completed for every publish work message."""
    stamp = F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    rows = work.filter(F.col("work_type") == "publish_link")
    return _outcome(rows, "publisher", F.lit("publish.completed"), F.to_json(F.struct(stamp.alias("published_at"))))
