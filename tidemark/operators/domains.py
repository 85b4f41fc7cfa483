"""Calendar, voice and sensor context: the domains around links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions.ids import parse_calendar_subject_id
from tidemark.sources.ledger import with_payload


def calendar_events(events: DataFrame) -> DataFrame:
    """Each sync overwrites the row, absent fields included; creation time stays."""
    ev = with_payload(events.filter(F.col("event_type") == "calendar.event_synced"), schemas.CALENDAR_PAYLOAD)
    ids = parse_calendar_subject_id("subject_id")
    value = F.struct(
        "p.title",
        "p.description",
        F.try_to_timestamp("p.start_at").alias("start_at"),
        F.try_to_timestamp("p.end_at").alias("end_at"),
        "p.location",
        F.coalesce("p.attendees", F.array().cast("array<string>")).alias("attendees"),
    )
    return (
        ev.groupBy("subject_id")
        .agg(F.max_by(value, "ord").alias("v"), F.min_by("occurred_at", "ord").alias("created_at"))
        .select(
            "subject_id",
            ids["calendar_id"].alias("calendar_id"),
            ids["external_event_id"].alias("external_event_id"),
            "v.*",
            F.lit("confirmed").alias("status"),
            "created_at",
        )
    )


def transcript_parts(segments: DataFrame, turns_per_part: int = 500) -> DataFrame:
    """Transcripts in order, cut into parts of a fixed number of turns.

    A turn number is unique in its note, so a part never collects more than
    `turns_per_part` segments, however long the recording; the parts of a note
    in order are its whole text.
    """
    return (
        segments.withColumn("part", F.floor(F.col("turn") / turns_per_part))
        .groupBy("note_id", "part")
        .agg(
            F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("s"),
            F.count(F.lit(1)).alias("segments"),
        )
        .select("note_id", "part", F.array_join(F.transform("s", lambda x: x["text"]), " ").alias("transcription"), "segments")
    )


def voice_notes(events: DataFrame) -> DataFrame:
    """Recordings with their transcription, matched on causation_id = recorded id."""
    ev = with_payload(events, schemas.VOICE_PAYLOAD)
    recorded = ev.filter(F.col("event_type") == "voice.recorded").select(
        "id", "subject_id", F.col("occurred_at").alias("recorded_at"), "p.audio_storage_key",
        "p.duration_seconds", "p.activity", F.col("p.location.place_name").alias("place_name"),
    )
    transcribed = (
        ev.filter(F.col("event_type") == "voice.transcribed")
        .groupBy(F.col("causation_id").alias("id"))
        .agg(F.max_by(F.struct("p.transcription", "p.transcription_model", "p.language"), "ord").alias("t"))
    )
    return recorded.join(transcribed, "id", "left").select(*recorded.columns, "t.*")


def todos_without_calendar(todo_rows: DataFrame, created: DataFrame) -> DataFrame:
    """Todos with a due date that no calendar.event_created names yet, with a one hour slot."""
    from tidemark.functions.payload import add_hours

    done = with_payload(created.filter(F.col("event_type") == "calendar.event_created"), schemas.CALENDAR_PAYLOAD)
    return (
        todo_rows.filter(F.col("due_at").isNotNull())
        .join(done.select(F.col("p.todo_subject_id").alias("subject_id")).distinct(), "subject_id", "left_anti")
        .select("subject_id", "title", F.col("due_at").alias("start_at"), add_hours("due_at").alias("end_at"))
    )


def cross_stream_daily(links: DataFrame, meetings: DataFrame) -> DataFrame:
    """Links and meetings of one user on one day: counts of both and of their pairings.

    Both streams are counted per (user, day) in one exchange; the number of
    pairings is the product, so no pairing is ever materialized.
    """
    a = links.select("user_id", F.col("ts").alias("ts"), F.lit(1).alias("l"), F.lit(0).alias("m"))
    b = meetings.select("user_id", F.col("start_at").alias("ts"), F.lit(0).alias("l"), F.lit(1).alias("m"))
    return (
        a.unionByName(b)
        .groupBy("user_id", F.date_trunc("day", "ts").alias("day"))
        .agg(F.sum("l").alias("n_links"), F.sum("m").alias("n_meetings"))
        .filter((F.col("n_links") > 0) & (F.col("n_meetings") > 0))
        .withColumn("n_pairs", F.col("n_links") * F.col("n_meetings"))
    )


def reading_context_by_meeting(links: DataFrame, meetings: DataFrame) -> DataFrame:
    """How many (link, meeting) pairings of one user and day join each topic to each title.

    Both sides are reduced to vocabulary counts per (user, day) before the join.
    """
    a = links.groupBy("user_id", F.to_date("ts").alias("day"), "topic").agg(F.count(F.lit(1)).alias("nl"))
    b = meetings.groupBy("user_id", F.to_date("start_at").alias("day"), "title").agg(F.count(F.lit(1)).alias("nm"))
    return (
        a.join(b, ["user_id", "day"])
        .groupBy("topic", "title")
        .agg(F.sum(F.col("nl") * F.col("nm")).alias("n_pairs"), F.count(F.lit(1)).alias("n_days"))
    )
