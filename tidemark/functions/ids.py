"""Stable subject identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.urls import normalize_url


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def sha256_short(text: Column | str) -> Column:
    return F.substring(F.sha2(_col(text), 256), 1, 16)


def link_subject_id(url: Column | str) -> Column:
    return F.concat(F.lit("link:"), sha256_short(normalize_url(url)))


def sensor_subject_id(location: Column | str) -> Column:
    return F.concat(F.lit("sensor:"), F.regexp_replace(F.lower(_col(location)), r"\s+", "_"))


def todo_subject_id(source: Column | str, external_id: Column | str) -> Column:
    return F.concat(_col(source), F.lit(":"), _col(external_id))


def annotation_subject_id(uuid: Column | str) -> Column:
    return F.concat(F.lit("anno:"), _col(uuid))


def calendar_subject_id(calendar_id: Column | str, event_id: Column | str) -> Column:
    return F.concat(F.lit("gcal:"), _col(calendar_id), F.lit(":"), _col(event_id))


def parse_subject_id(subject_id: Column | str) -> Column:
    """struct(type, id), split at the first colon; no colon gives type 'unknown'."""
    sid = _col(subject_id)
    at = F.instr(sid, ":")
    return F.struct(
        F.when(at > 0, F.substring_index(sid, ":", 1)).otherwise(F.lit("unknown")).alias("type"),
        F.when(at > 0, F.regexp_replace(sid, "^[^:]*:", "")).otherwise(sid).alias("id"),
    )


def parse_calendar_subject_id(subject_id: Column | str) -> Column:
    """struct(calendar_id, external_event_id) of 'gcal:{calendar}:{event}'."""
    parts = F.split(_col(subject_id), ":")
    return F.struct(
        F.get(parts, F.lit(1)).alias("calendar_id"),
        F.array_join(F.slice(parts, 3, 1 << 20), ":").alias("external_event_id"),
    )
