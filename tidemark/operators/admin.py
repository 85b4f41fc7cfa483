"""Operator actions, each a set of events or a rewritten table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def retry_candidates(links: DataFrame, max_retries: int = 3, limit: int | None = None) -> DataFrame:
    rows = links.filter((F.col("status") == "error") & (F.col("retry_count") < max_retries)).orderBy(
        F.asc_nulls_first("last_error_at"), "subject_id"
    )
    return rows if limit is None else rows.limit(limit)


def exhausted_links(links: DataFrame, max_retries: int = 3, n: int = 10) -> DataFrame:
    return (
        links.filter((F.col("status") == "error") & (F.col("retry_count") >= max_retries))
        .orderBy(F.desc("retry_count"), "subject_id")
        .select("subject_id", "url", "retry_count")
        .limit(n)
    )


def _emitted(rows: DataFrame, source: str, event_type: str, payload: Column, now: Column) -> DataFrame:
    return rows.select(
        now.alias("occurred_at"),
        F.lit(source).alias("source"),
        F.lit("link").alias("subject"),
        "subject_id",
        F.lit(event_type).alias("event_type"),
        payload.alias("payload"),
    )


def retry_events(candidates: DataFrame, now: Column) -> DataFrame:
    payload = F.to_json(
        F.struct("url", "url_norm", F.lit("retry").alias("source"), F.col("source").alias("original_source"))
    )
    return _emitted(candidates, "retry-script", "link.added", payload, now)


def recovery_events(stuck: DataFrame, now: Column) -> DataFrame:
    payload = F.to_json(
        F.struct(
            "tags",
            "summary_short",
            "summary_long",
            "language",
            F.coalesce(F.nullif("model_version", F.lit("")), F.lit("recovery")).alias("model_version"),
        )
    )
    return _emitted(stuck, "admin:recovery", "enrichment.completed", payload, now)


def visibility_events(links: DataFrame, target: str, now: Column, status: str | None = None) -> DataFrame:
    """Change events for links not yet at the target value."""
    if target not in ("public", "private"):
        raise ValueError(f"visibility must be public or private, not {target!r}")
    rows = links if status is None else links.filter(F.col("status") == status)
    rows = rows.filter(F.col("visibility") != target)
    return _emitted(rows, "admin:set-visibility", "link.visibility_changed", F.lit(f'{{"visibility":"{target}"}}'), now)


def without_subjects(table: DataFrame, subjects: DataFrame) -> DataFrame:
    """Delete: the rows of a table that belong to none of the subjects."""
    return table.join(subjects.select("subject_id"), "subject_id", "left_anti")


def reset_links(links: DataFrame, subjects: DataFrame) -> DataFrame:
    """Status back to 'new' for the given subjects; the retry count stays."""
    hit = subjects.select("subject_id").distinct().withColumn("_hit", F.lit(True))
    return (
        links.join(hit, "subject_id", "left")
        .withColumn("status", F.when(F.col("_hit"), "new").otherwise(F.col("status")))
        .drop("_hit")
    )


def clean_link(
    links: DataFrame, content: DataFrame, metadata: DataFrame, subject_rows: DataFrame, targets: DataFrame, full: bool = False
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(links, content, metadata, subjects) after cleaning the target subjects."""
    kept = without_subjects(links, targets) if full else reset_links(links, targets)
    people = without_subjects(subject_rows, targets) if full else subject_rows
    return kept, without_subjects(content, targets), without_subjects(metadata, targets), people
