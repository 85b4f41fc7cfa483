"""Event streams and stream sinks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark import schemas
from tidemark.sources.ledger import decode_events


def read_event_stream(
    spark: SparkSession,
    path: str | None = None,
    *,
    fmt: str = "parquet",
    schema: str = schemas.LEDGER,
    kafka: Mapping[str, str] | None = None,
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """Events as an unbounded table: a broker topic, or a directory for replay and tests.

    `kafka` holds the connector options (servers, security, subscribe); position
    columns come from the broker. Malformed values are in `read_malformed`, so a job that
    writes both streams loses nothing.
    """
    if kafka is not None:
        return decode_events(_broker_rows(spark, kafka, options))[0]
    if path is None:
        raise ValueError("either path or kafka is required")
    return spark.readStream.format(fmt).schema(schema).options(**(options or {})).load(path)


def _broker_rows(spark: SparkSession, kafka: Mapping[str, str], options: Mapping[str, str] | None) -> DataFrame:
    reader = spark.readStream.format("kafka").option("subscribe", "events.raw").options(**kafka)
    return broker_columns(reader.options(**(options or {})).load())


def broker_columns(raw: DataFrame) -> DataFrame:
    """Value as text with its position, from the columns the connector gives."""
    return raw.select(
        F.col("value").cast("string").alias("value"),
        F.col("topic").alias("kafka_topic"),
        F.col("partition").alias("kafka_partition"),
        F.col("offset").alias("kafka_offset"),
    )


def read_malformed(spark: SparkSession, kafka: Mapping[str, str], options: Mapping[str, str] | None = None) -> DataFrame:
    """The unreadable values of the same topic with their positions, for a quarantine table."""
    return decode_events(_broker_rows(spark, kafka, options))[1]


def with_event_time(events: DataFrame, delay: str = "5 minutes") -> DataFrame:
    return events.withWatermark("occurred_at", delay)


def dedupe_stream(events: DataFrame, delay: str = "5 minutes", key: str = "id") -> DataFrame:
    """Repeats of an event id inside the watermark are dropped; state stays bounded by time."""
    return with_event_time(events, delay).dropDuplicatesWithinWatermark([key])


def write_jdbc(rows: DataFrame, url: str, table: str, batch_rows: int = 200, **options: str) -> None:
    """Append a frame to a database table in batches; needs a driver on the class path.

    Spark's writer has no keyed upsert, so state tables are merged first
    (`tidemark.operators.merge`) and this fills a fresh version or a staging table.
    """
    rows.write.format("jdbc").option("url", url).option("dbtable", table).option("batchsize", batch_rows).options(
        **options
    ).mode("append").save()


def write_records(records: DataFrame, checkpoint: str, *, kafka: Mapping[str, str] | None = None, path: str | None = None) -> StreamingQuery:
    """Routed records to the broker (topic column), or to one folder per topic."""
    writer = records.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if kafka is not None:
        return writer.format("kafka").options(**kafka).start()
    return writer.format("parquet").partitionBy("topic").option("path", path).start()
