"""Incremental state: micro-batches folded into mergeable partials, upserted by key.

Every table is a set of partial rows in plain Parquet, one row per key, kept by the keyed upsert
of `tidemark.streaming.upsert`: a batch is folded on top of the rows of its keys, and the hash
buckets it touches are rewritten.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tidemark.operators import folds
from tidemark.sources.ledger import with_payload
from tidemark.streaming.upsert import read_upserted, upsert


@dataclass(frozen=True)
class Table:
    name: str
    keys: tuple[str, ...]
    first: tuple[str, ...]


LINKS = Table("links", ("subject_id",), ("added",))
TODOS = Table("todos", ("subject_id",), ("first",))
READINGS = Table("readings", ("subject_id", "occurred_at"), ("v",))
SUBJECTS = Table("subjects", ("subject", "subject_id"), ("s",))
VISIBILITY = Table("visibility", ("subject_id",), ())
ANNOTATIONS = Table("annotations", ("annotation_id",), ("first",))
TABLES = ("links", "todos", "readings", "subjects", "annotations")


class StateTables:
    """The partial tables under one root on a shared path; `buckets` is fixed for its life."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64) -> None:
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        # A table without rows has no file that would tell its columns.
        self._schemas: dict[str, StructType] = {}

    def read(self, table: Table) -> DataFrame:
        rows = read_upserted(self.spark, f"{self.root}/{table.name}")
        return self.spark.createDataFrame([], self._schemas[table.name]) if rows is None else rows

    def apply(self, table: Table, batch: int, fold: Callable[[DataFrame | None], DataFrame], touched: DataFrame) -> None:
        """Fold a batch on top of the state of its touched keys and store the changed rows."""

        def merged(old: DataFrame | None) -> DataFrame:
            new = fold(old)
            rows = new if old is None else folds.merge_partials(old, new, table.keys, table.first)
            self._schemas[table.name] = rows.schema
            return rows

        upsert(self.spark, f"{self.root}/{table.name}", table.keys, touched, merged, batch, self.buckets)

    def links(self) -> DataFrame:
        return folds.links(self.read(LINKS)).drop("added_ord")

    def link_content(self) -> DataFrame:
        return folds.link_content(self.read(LINKS))

    def link_metadata(self) -> DataFrame:
        return folds.link_metadata(self.read(LINKS))

    def publish_state(self) -> DataFrame:
        return folds.publish_state(self.read(LINKS))

    def todos(self) -> DataFrame:
        return folds.todos_from(self.read(TODOS))

    def temperature_readings(self) -> DataFrame:
        return self.read(READINGS).select("subject_id", "occurred_at", "v.*")

    def temperature_latest(self) -> DataFrame:
        return folds.latest_of(self.temperature_readings())

    def subjects(self) -> DataFrame:
        return folds.subjects_from(self.read(SUBJECTS), self.read(VISIBILITY))

    def annotations(self) -> DataFrame:
        return folds.annotations_from(self.read(ANNOTATIONS))


def fold_batch(store: StateTables, batch: DataFrame, batch_id: int, tables: Sequence[str] = TABLES) -> None:
    """One micro-batch into the named tables. The batch is read once and kept while it is
    used. Annotations need the links table beside them."""
    rows = batch.persist()
    try:
        subjects = rows.select("subject_id").distinct()
        if "links" in tables:
            store.apply(LINKS, batch_id, lambda old: folds.link_partials(rows, known=old), subjects)
        if "todos" in tables:
            store.apply(TODOS, batch_id, lambda old: folds.todo_partials(rows), subjects)
        if "readings" in tables:
            times = rows.select("subject_id", "occurred_at").distinct()
            store.apply(READINGS, batch_id, lambda old: folds.reading_partials(rows), times)
        if "subjects" in tables:
            # Subject rows and visibility are keyed by parts of the event, so their keys come from the fold.
            fresh = folds.subject_partials(rows)
            store.apply(SUBJECTS, batch_id, lambda old: fresh, fresh.select(*SUBJECTS.keys))
            store.apply(VISIBILITY, batch_id, lambda old: folds.visibility_partials(rows), subjects)
        if "annotations" in tables:
            # A note needs its link's arrival, whichever batch brought it; only the links of
            # this batch's notes are read.
            named = with_payload(rows.filter(F.col("event_type") == "annotation.added"))
            named = named.select(F.col("p.link_subject_id").alias("subject_id")).filter("subject_id IS NOT NULL").distinct()
            linked = store.read(LINKS).join(named, "subject_id", "left_semi").select(
                F.col("subject_id").alias("link_subject_id"), F.col("added.ord").alias("parent_ord")
            )
            notes = folds.annotation_partials(rows, linked)
            store.apply(ANNOTATIONS, batch_id, lambda old: notes, notes.select(*ANNOTATIONS.keys))
    finally:
        rows.unpersist()


def start_materializer(
    events: DataFrame, store: StateTables, checkpoint: str, once: bool = True, interval: str = "30 seconds", tables: Sequence[str] = TABLES
) -> StreamingQuery:
    """Run the folds over a stream; `events` needs the envelope columns and `ord`."""
    writer = events.writeStream.foreachBatch(lambda batch, batch_id: fold_batch(store, batch, batch_id, tables)).option(
        "checkpointLocation", checkpoint
    )
    trigger = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)
    return trigger.start()
