"""Keyed upsert on plain Parquet: one row per key, in partitions by a hash bucket of the key.

A batch of changes touches some buckets. Their rows are read, the changed keys merged, and only
these partitions are replaced by Spark's dynamic partition overwrite. Each row carries the batch
that last changed it. A bucket that already holds a row of this batch or a later one has been
written by it, so a repeated batch leaves it alone, also when an earlier try ended half way.

A bucket is one rewritten unit: choose their number so that one holds what a task may hold.
Spark replaces a partition by deleting and renaming; a driver that ends between the two needs the
bucket's rows from the source again.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.merge import merge_state

BUCKETS = 64
_OWN = ("_batch", "_bucket")


def _rows(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def read_upserted(spark: SparkSession, path: str) -> DataFrame | None:
    """The table's rows; None before its first row."""
    rows = _rows(spark, path)
    return None if rows is None else rows.drop(*_OWN)


def upsert(
    spark: SparkSession, path: str, keys: Sequence[str], changed: DataFrame, merge: Callable[[DataFrame | None], DataFrame], batch: int, buckets: int = BUCKETS
) -> None:
    """Replace the rows of `changed`, a frame of distinct keys, by merge(their rows so far).

    `merge` gets None while the table has no rows; it returns one row per key. Keys that it leaves
    out lose their row. Rows of other keys in the touched buckets are copied as they are.
    """
    keys = list(keys)
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    # At most `buckets` numbers.
    touched = {r[0] for r in changed.select(bucket).distinct().collect()}
    stored = _rows(spark, path)
    if stored is not None:
        newest = stored.filter(F.col("_bucket").isin(list(touched))).groupBy("_bucket").agg(F.max("_batch").alias("b"))
        touched -= {r["_bucket"] for r in newest.filter(F.col("b") >= batch).collect()}
    if not touched:
        return
    open_ = F.col("_bucket").isin(sorted(touched))
    here = None if stored is None else stored.filter(open_)
    old = None if here is None else here.drop(*_OWN).join(changed, keys, "left_semi")
    new = merge(old).withColumns({"_batch": F.lit(batch).cast("bigint"), "_bucket": bucket}).filter(open_)
    if here is not None:
        new = new.unionByName(here.join(changed, keys, "left_anti"))
    # One task a bucket and one file a bucket.
    new.repartition(len(touched), "_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(path)


def upsert_changes(spark: SparkSession, path: str, changes: DataFrame, keys: Sequence[str], rules: Mapping[str, str], batch: int, buckets: int = BUCKETS) -> None:
    """Merge change rows, one per key, by the rules of `merge_state`."""
    kept = changes.persist()
    try:
        merge = lambda old: kept if old is None else merge_state(old, kept, keys, rules).select(*kept.columns)
        upsert(spark, path, keys, kept.select(*keys), merge, batch, buckets)
    finally:
        kept.unpersist()


def upsert_sink(
    stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str], rules: Mapping[str, str], reduce: Callable[[DataFrame], DataFrame], *, buckets: int = BUCKETS, once: bool = True, interval: str = "30 seconds"
) -> StreamingQuery:
    """Keep a table by micro-batches; `reduce` makes one change row per key of a batch's rows."""

    def step(batch: DataFrame, number: int) -> None:
        upsert_changes(batch.sparkSession, path, reduce(batch), keys, rules, number, buckets)

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()
