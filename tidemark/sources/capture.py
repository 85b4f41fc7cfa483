"""Capture endpoint: shared URLs become subjects, links and ledger events."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ids import sha256_short
from tidemark.functions.urls import is_url, normalize_url


@dataclass(frozen=True)
class Captured:
    subjects: DataFrame
    links: DataFrame
    events: DataFrame
    rejected: DataFrame


def capture_links(shares: DataFrame) -> Captured:
    """`shares` has url, source, id, occurred_at; id and clock come from upstream.

    A repeated share overwrites the link row (last write wins), so subjects and
    links are reduced per subject with a partial aggregation.
    """
    url = F.col("url")
    ok = F.coalesce(url != "", F.lit(False)) & is_url("url")
    valid = (
        shares.filter(ok)
        .withColumn("source", F.coalesce("source", F.lit("unknown")))
        .withColumn("url_norm", normalize_url("url"))
        .withColumn("subject_id", F.concat(F.lit("link:"), sha256_short("url_norm")))
    )
    reason = F.when(F.coalesce(url == "", F.lit(True)), "Missing or invalid 'url' field").otherwise(
        "Invalid URL format"
    )
    last = valid.groupBy("subject_id").agg(
        F.max(F.struct("occurred_at", "id", "url", "url_norm", "source")).alias("r")
    )
    subjects = last.select(
        F.lit("link").alias("subject"),
        "subject_id",
        F.col("r.occurred_at").alias("created_at"),
        F.lit("public").alias("visibility"),
        F.lit("{}").alias("meta"),
    )
    links = last.select(
        "subject_id",
        "r.url",
        "r.url_norm",
        F.col("r.occurred_at").alias("created_at"),
        "r.source",
        F.lit("new").alias("status"),
        F.lit("public").alias("visibility"),
        F.lit(False).alias("pinned"),
    )
    events = valid.select(
        "id",
        "occurred_at",
        F.col("occurred_at").alias("received_at"),
        "source",
        F.lit("link").alias("subject"),
        "subject_id",
        F.lit("link.added").alias("event_type"),
        F.lit(1).alias("schema_version"),
        F.to_json(F.struct("url", "url_norm", "source")).alias("payload"),
        F.lit(None).cast("string").alias("correlation_id"),
        F.lit(None).cast("string").alias("causation_id"),
    )
    return Captured(subjects, links, events, shares.filter(~ok).withColumn("error", reason))
