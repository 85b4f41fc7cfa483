"""The append-only event ledger: scan, decoding, outbox and broker records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions.payload import unwrap_payload


def read_ledger(
    spark: SparkSession,
    path: str,
    *,
    subject_id: str | None = None,
    event_type: str | None = None,
    source: str | None = None,
    id: str | None = None,
    correlation_id: str | None = None,
    fmt: str = "parquet",
) -> DataFrame:
    """Scan a ledger directory. The access paths become pushed-down filters; a ledger written by
    `write_ledger` is also pruned by date and type folder, by the subject range of each row group,
    and by Bloom filters on id, subject and run."""
    events = spark.read.format(fmt).schema(schemas.LEDGER).load(path)
    wanted_values = {"subject_id": subject_id, "event_type": event_type, "source": source, "id": id, "correlation_id": correlation_id}
    for name, wanted in wanted_values.items():
        if wanted is not None:
            events = events.filter(F.col(name) == wanted)
    return events


def read_ledger_jdbc(spark: SparkSession, url: str, table: str, partitions: int, lower: str, upper: str,
                     **options: str) -> DataFrame:
    """Partitioned JDBC scan by arrival time; needs a driver on the class path."""
    return (
        spark.read.format("jdbc")
        .option("url", url)
        .option("dbtable", table)
        .option("partitionColumn", "received_at")
        .option("lowerBound", lower)
        .option("upperBound", upper)
        .option("numPartitions", partitions)
        .options(**options)
        .load()
    )


#: Columns that single events, subjects and runs are looked up by.
LOOKUPS = ("id", "subject_id", "correlation_id")
#: Bytes of a row group, the unit that a lookup reads or skips, and distinct values of its filters.
ROW_GROUP = 16 << 20
GROUP_VALUES = 200_000


def write_ledger(events: DataFrame, path: str, mode: str = "append", *, row_group: int = ROW_GROUP, group_values: int = GROUP_VALUES) -> None:
    """Store by arrival date and type, sorted by subject, in small row groups with Bloom filters.

    A subject's events lie in few row groups of a folder, so its range tells most of them apart;
    ids and runs are spread over all subjects, and their Bloom filters do. The range exchange
    includes the arrival time, so neither one date nor one subject can end up in a single task.
    """
    filters = {f"parquet.bloom.filter.enabled#{c}": "true" for c in LOOKUPS} | {f"parquet.bloom.filter.expected.ndv#{c}": str(group_values) for c in LOOKUPS}
    (
        events.withColumn("event_date", F.to_date("received_at"))
        .repartitionByRange("event_date", "event_type", "subject_id", "received_at")
        .sortWithinPartitions("event_date", "event_type", "subject_id", "received_at")
        .write.mode(mode)
        .options(**filters, **{"parquet.block.size": str(row_group)})
        .partitionBy("event_date", "event_type")
        .parquet(path)
    )


def decode_events(raw: DataFrame, column: str = "value", schema: str = schemas.EVENT) -> tuple[DataFrame, DataFrame]:
    """(events, malformed): missing fields are NULL, unreadable rows are set aside.
    Other columns of `raw`, such as the broker position, stay with the event."""
    extra = [c for c in raw.columns if c != column]
    parsed = raw.withColumn(
        "_e", F.from_json(F.col(column), schema + ", _corrupt STRING", {"columnNameOfCorruptRecord": "_corrupt"})
    )
    good = parsed.filter(F.col("_e").isNotNull() & F.col("_e._corrupt").isNull()).select(*extra, "_e.*").drop("_corrupt")
    bad = parsed.filter(F.col("_e").isNull() | F.col("_e._corrupt").isNotNull()).drop("_e")
    return good, bad


def decode_events_strict(raw: DataFrame, column: str = "value", schema: str = schemas.EVENT) -> DataFrame:
    """Decoding that fails the job on the first malformed row."""
    return raw.select(F.from_json(F.col(column), schema, {"mode": "FAILFAST"}).alias("e")).select("e.*")


def with_payload(events: DataFrame, schema: str = schemas.PAYLOAD) -> DataFrame:
    """Decode the payload once into the struct column `p`."""
    return events.withColumn("p", F.from_json(unwrap_payload("payload"), schema))


def arrival_order(kind: str = "ledger") -> Column:
    """Total order of arrival: broker position, or arrival time with the id as tie-break."""
    if kind == "kafka":
        return F.struct("kafka_partition", "kafka_offset")
    return F.struct("received_at", "id")


def outbox_batch(ledger: DataFrame, limit: int = 50) -> DataFrame:
    """Oldest rows not yet sent (top-k, no full sort)."""
    return (
        ledger.filter(~F.coalesce(F.col("published_to_kafka"), F.lit(False)))
        .orderBy("received_at", "id")
        .limit(limit)
    )


def to_kafka_records(events: DataFrame) -> DataFrame:
    """key / value / headers rows for the broker, keyed by subject."""
    header = "array<struct<key: string, value: binary>>"
    return events.select(
        F.col("subject_id").alias("key"),
        F.to_json(F.struct(*[F.col(c) for c in events.columns])).alias("value"),
        F.array(
            F.struct(F.lit("event_type").alias("key"), F.col("event_type").cast("binary").alias("value")),
            F.struct(F.lit("source").alias("key"), F.col("source").cast("binary").alias("value")),
        )
        .cast(header)
        .alias("headers"),
    )


def mark_published(ledger: DataFrame, sent: DataFrame) -> DataFrame:
    """Set the flag for sent ids. `sent` holds ids; repeats are collapsed first."""
    flags = sent.select("id").distinct().withColumn("_sent", F.lit(True))
    return (
        ledger.join(flags, "id", "left")
        .withColumn(
            "published_to_kafka",
            F.coalesce(F.col("_sent"), F.col("published_to_kafka"), F.lit(False)),
        )
        .drop("_sent")
    )


def retention(rows: DataFrame, now: Column, days: int, column: str = "received_at") -> DataFrame:
    """Rows inside the retention period; `now` is passed in, never read from a clock."""
    return rows.filter(F.col(column) >= now - F.expr(f"INTERVAL {int(days)} DAYS"))


def as_of(events: DataFrame, moment: Column) -> DataFrame:
    """The ledger as it stood at a moment; folds over it give the state of that time."""
    return events.filter(F.col("received_at") <= moment)


def duplicates_removed(events: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key, the earliest arrival. The keys are ids, so groups stay tiny
    and copies collapse in the partial aggregation before the exchange."""
    others = [c for c in events.columns if c not in keys]
    return (
        events.groupBy(*keys)
        .agg(F.min(F.struct("ord", *[c for c in others if c != "ord"])).alias("_r"))
        .select(*keys, "_r.*")
        .select(*events.columns)
    )
