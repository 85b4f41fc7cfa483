"""Rows that a lookup in a stored ledger reads, with and without sorted row groups and filters."""

from pyspark.sql import functions as F

from tidemark.sources.ledger import read_ledger, write_ledger


def scanned(df):
    """(rows found, rows that the scan gave to the filter, files of the scan)."""
    found = len(df.collect())
    scan = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return found, scan.metrics().apply("numOutputRows").value(), scan.metrics().apply("numFiles").value()


def test_lookups_skip_row_groups(spark, tmp_path):
    n = 120_000
    i = F.col("i")
    events = spark.range(n).withColumnRenamed("id", "i").select(
        F.sha2(i.cast("string"), 256).alias("id"), F.timestamp_seconds(1_704_067_200 + i % 80_000).alias("occurred_at"), F.timestamp_seconds(1_704_067_200 + i % 80_000).alias("received_at"),
        F.lit("s").alias("source"), F.concat(F.lit("link:"), F.md5((i % 3_000).cast("string"))).alias("subject_id"), F.lit("content.fetched").alias("event_type"),
        F.lit("{}").alias("payload"), F.sha2((i % 9_001).cast("string"), 224).alias("correlation_id"),
    )
    plain, good = str(tmp_path / "plain"), str(tmp_path / "good")
    events.withColumn("event_date", F.to_date("received_at")).repartition(4).write.partitionBy("event_date", "event_type").parquet(plain)
    write_ledger(events, good, row_group=1 << 20, group_values=10_000)
    probe = events.filter("received_at = timestamp_seconds(1704067200 + 777)").first()
    for name in ("id", "subject_id", "correlation_id"):
        before, after = (scanned(read_ledger(spark, path, **{name: probe[name]}).select("id", "subject_id")) for path in (plain, good))
        assert before[0] == after[0] == events.filter(F.col(name) == probe[name]).count() > 0
        assert before[1] >= 0.9 * n
        # A run's events lie in up to fourteen of many row groups.
        assert after[1] <= (0.9 if name == "correlation_id" else 0.35) * n, (name, after)
    assert scanned(read_ledger(spark, good, id="none"))[:2] == (0, 0)
