import pytest
from pyspark.sql import functions as F

from tests.test_folds import frame, random_rows
from tidemark.operators import folds, patterns, windows
from tidemark.plans.state import all_events
from tidemark.sources import adapters
from tidemark.streaming import windows as stream_windows
from tidemark.streaming.lifecycle import lifecycle_stream
from tidemark.streaming.materialize import StateTables, start_materializer
from tidemark.streaming.sources import dedupe_stream, read_event_stream, write_records

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted((tuple(str(v) for v in r) for r in df.select(sorted(df.columns)).collect()))


def split_files(df, path, order, parts):
    """One file per slice of the order, so each micro-batch takes the next slice."""
    n = df.count()
    df = df.withColumn("_r", F.row_number().over(__import__("pyspark").sql.Window.orderBy(order)) - 1)
    for i in range(parts):
        df.filter((F.col("_r") >= n * i // parts) & (F.col("_r") < n * (i + 1) // parts)).drop("_r").coalesce(1).write.mode(
            "append"
        ).parquet(str(path))


def test_materializer_equals_batch(spark, tmp_path):
    events = all_events(spark, SF).persist()
    split_files(events, tmp_path / "in", "ord", 4)
    schema = events.schema.simpleString()[len("struct<"):-1].replace(":", " ")
    stream = read_event_stream(spark, str(tmp_path / "in"), schema=schema, options={"maxFilesPerTrigger": "1"})
    store = StateTables(spark, str(tmp_path / "state"), buckets=8)
    query = start_materializer(stream, store, str(tmp_path / "cp"))
    query.awaitTermination(600)
    assert query.exception() is None
    p = folds.link_partials(events)
    assert rows_of(store.links()) == rows_of(folds.links(p).drop("added_ord"))
    assert rows_of(store.link_content()) == rows_of(folds.link_content(p))
    assert rows_of(store.link_metadata()) == rows_of(folds.link_metadata(p))
    assert rows_of(store.publish_state()) == rows_of(folds.publish_state(p))
    assert rows_of(store.todos()) == rows_of(folds.todos(events))
    assert rows_of(store.temperature_readings()) == rows_of(folds.temperature_readings(events))
    assert rows_of(store.temperature_latest()) == rows_of(folds.temperature_latest(events))
    assert rows_of(store.subjects()) == rows_of(folds.subjects(events))
    assert rows_of(store.annotations()) == rows_of(folds.annotations(events))
    events.unpersist()


def test_repeated_batch_is_harmless(spark, tmp_path):
    from tidemark.streaming.materialize import fold_batch

    events = frame(spark, random_rows(9, subjects=40))
    store = StateTables(spark, str(tmp_path), buckets=8)
    fold_batch(store, events.filter("ord <= 80"), 0)
    fold_batch(store, events.filter("ord > 80"), 1)
    before = rows_of(store.publish_state())
    fold_batch(store, events.filter("ord > 80"), 1)
    assert rows_of(store.publish_state()) == before == rows_of(folds.publish_state(folds.link_partials(events)))


def test_upsert_is_idempotent_and_rewrites_touched_buckets_only(spark, tmp_path):
    from tidemark.streaming.upsert import read_upserted, upsert_changes

    path, rules = str(tmp_path / "t"), {"n": "add", "v": "coalesce"}
    change = lambda rows: spark.createDataFrame(rows, "k long, n long, v string")
    files = lambda: {r[0] for r in spark.read.parquet(path).select(F.input_file_name()).distinct().collect()}
    upsert_changes(spark, path, change([(i, 1, None) for i in range(100)]), ["k"], rules, 0, 8)
    before = files()
    for _ in range(2):
        upsert_changes(spark, path, change([(3, 5, "x"), (500, 2, "y")]), ["k"], rules, 1, 8)
        got = {r.k: (r.n, r.v) for r in read_upserted(spark, path).collect()}
        assert got == {i: (1, None) for i in range(100)} | {3: (6, "x"), 500: (2, "y")}
    assert len(before) == 8 and len(before & files()) >= 6
    # A try that ended half way: only the bucket that lacks the batch takes it.
    upsert_changes(spark, path, change([(3, 1, None)]), ["k"], rules, 2, 8)
    upsert_changes(spark, path, change([(3, 1, None), (500, 1, None)]), ["k"], rules, 2, 8)
    bucket = {r.k: r["_bucket"] for r in spark.read.parquet(path).select("k", "_bucket").collect()}
    got = {r.k: r.n for r in read_upserted(spark, path).collect()}
    assert got[3] == 7 and got[500] == (2 if bucket[3] == bucket[500] else 3)
    assert read_upserted(spark, str(tmp_path / "none")) is None
    upsert_changes(spark, path, change([]), ["k"], rules, 3, 8)
    assert read_upserted(spark, path).count() == 101


def activity_stream(spark, tmp_path, parts=3):
    batch = adapters.activity(spark, SF)
    split_files(batch, tmp_path / "in", "event_id", parts)
    return batch, spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def run(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None
    return q


def test_tumbling_closed_windows(spark, tmp_path):
    batch, stream = activity_stream(spark, tmp_path)
    run(stream_windows.tumbling_counts(stream, ["user_id"], "ts", "1 hour", "5 minutes"), "tumbling")
    got = set(rows_of(spark.table("tumbling")))
    want = rows_of(windows.tumbling_count(batch, ["user_id"], "ts", "1 hour"))
    # The last window stays open until the watermark passes it.
    assert got <= set(want) and len(got) >= len(want) - 2


def test_sliding_closed_windows(spark, tmp_path):
    batch, stream = activity_stream(spark, tmp_path)
    run(stream_windows.sliding_counts(stream, ["topic"], "ts", "24 hours", "1 hour", "5 minutes"), "sliding")
    got = set(rows_of(spark.table("sliding")))
    want = set(rows_of(windows.sliding_count(batch, ["topic"], "ts", "24 hours", "1 hour")))
    assert got and got <= want and len(got) > 0.9 * len(want) - 7 * 25


def test_sessions_match_batch(spark, tmp_path):
    batch, stream = activity_stream(spark, tmp_path)
    run(stream_windows.session_counts(stream, ["user_id"], "ts", "30 minutes", "5 minutes"), "sessions")
    got = set(rows_of(spark.table("sessions")))
    want = set(rows_of(windows.sessions(batch, ["user_id"], "ts").select("user_id", "session_start", "session_end", "n")))
    assert got <= want and len(got) >= len(want) - 20


def test_dedupe_stream(spark, tmp_path):
    e = adapters.lifecycle_events(spark, SF)
    split_files(e.unionByName(e.filter("ord % 10 = 0")), tmp_path / "in", "ord", 2)
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    run(dedupe_stream(stream, "1 hour"), "deduped")
    assert spark.table("deduped").count() == e.count() == spark.table("deduped").select("id").distinct().count()


def test_lifecycle_stream_matches_batch(spark, tmp_path):
    e = adapters.lifecycle_events(spark, SF, runs=True)
    split_files(e, tmp_path / "in", "ord", 3)
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = lifecycle_stream(stream, 240 * 3600, "1 hour").writeStream.outputMode("append").format("memory").queryName("life")
    q = q.trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None
    us = [F.unix_micros(f"{n}_at").alias(f"{n}_us") for n in ("added", "fetched", "enriched")]
    last = e.filter("event_type <> 'publish.completed'").agg(F.max("occurred_at")).first()[0]
    want = patterns.lifecycle(e, 240 * 3600).filter(F.col("enriched_at") <= F.lit(last) - F.expr("INTERVAL 1 HOUR")).select("run_key", *us)
    assert rows_of(spark.table("life")) == rows_of(want)


def test_anomaly_stream_matches_batch_out_of_order(spark, tmp_path):
    import random

    from tidemark.streaming.processors import anomaly_stream

    rng = random.Random(1)
    rows = [(f"s{i % 3}", 1_700_000_000 + i * 97 + rng.randrange(-200, 200), i, 20 + rng.gauss(0, 1) + (30 if rng.random() < 0.02 else 0)) for i in range(400)]
    df = spark.createDataFrame([*rows, ("s0", 1_700_000_000, 1, None)], "k string, s long, i long, v double").withColumn("ts", F.timestamp_seconds("s"))
    split_files(df.select("i", "k", "ts", "v"), tmp_path / "in", "i", 3)
    stream = spark.readStream.schema("i long, k string, ts timestamp, v double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run(anomaly_stream(stream, "k", "ts", "v", delay="10 minutes"), "flagged")
    last = df.agg(F.max("ts")).first()[0]
    want = windows.anomalies(df.select("k", "ts", "v"), "k", "ts", "v")
    want = want.filter(F.col("window_start") + F.expr("INTERVAL 1 HOUR") <= F.lit(last) - F.expr("INTERVAL 10 MINUTES"))
    rounded = lambda d: rows_of(d.withColumns({c: F.round(c, 9) for c in ("mean", "sd")}))
    assert rounded(spark.table("flagged")) == rounded(want) and want.count() > 20


def test_lifecycle_orders_late_events():
    from tidemark.streaming.lifecycle import advance

    # fetched arrives first; added and enriched, both earlier than the watermark's reach, later.
    waiting, held, done = advance([(10, 2, 1)], [], 0, 300)
    assert (held, done) == ([], [])
    waiting, held, done = advance(waiting + [(20, 3, 2), (5, 1, 0)], held, 15, 300)
    assert (waiting, held, done) == ([(20, 3, 2)], [(5, 10)], [])
    waiting, held, done = advance(waiting, held, 30, 300)
    assert (waiting, held, done) == ([], [], [(5, 10, 20)])
    # Equal times follow the position; a match at the limit is none.
    assert advance([(7, 2, 1), (7, 1, 0), (9, 3, 2)], [], 50, 300)[2] == [(7, 7, 9)]
    assert advance([(0, 1, 0), (1, 2, 1), (300, 3, 2)], [], 400, 300)[2] == []


def test_malformed_broker_rows_are_kept(spark):
    from tidemark.sources.ledger import decode_events
    from tidemark.streaming.sources import broker_columns

    raw = spark.createDataFrame([('{"id": "a"}', "t", 0, 1), ("not json", "t", 0, 2)], "value string, topic string, partition int, offset long")
    good, bad = decode_events(broker_columns(raw))
    assert [(r.id, r.kafka_offset) for r in good.collect()] == [("a", 1)]
    assert [(r.value, r.kafka_offset) for r in bad.collect()] == [("not json", 2)]


def test_cross_stream_daily(spark, tmp_path):
    from tidemark.operators import domains

    links, meetings = adapters.activity(spark, SF), adapters.calendar(spark, SF)
    split_files(links, tmp_path / "l", "event_id", 2)
    split_files(meetings, tmp_path / "m", "start_at", 2)
    a = spark.readStream.schema(links.schema).parquet(str(tmp_path / "l"))
    b = spark.readStream.schema(meetings.schema).parquet(str(tmp_path / "m"))
    run(stream_windows.cross_stream_daily(a, b, "40 days"), "daily", "update")
    best = spark.table("daily").groupBy("user_id", "day").agg(F.max("n_pairs").alias("n_pairs"))
    want = domains.cross_stream_daily(links, meetings).select("user_id", "day", "n_pairs")
    assert rows_of(best) == rows_of(want)


def test_records_to_topic_folders(spark, tmp_path):
    from tidemark.operators import routing
    from tidemark.sources.ledger import with_payload

    e = adapters.work_failures(spark, SF)
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    now = F.lit("2024-02-01").cast("timestamp")
    work = routing.work_records(routing.retry_work(routing.failed_work(with_payload(stream)), now))
    q = write_records(work, str(tmp_path / "cp"), path=str(tmp_path / "out"))
    q.awaitTermination(300)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == routing.retry_work(routing.failed_work(with_payload(e)), now).count() > 0
    assert {r.topic for r in out.select("topic").distinct().collect()} <= {"work.fetch_link", "work.enrich_link", "work.publish_link"}


def test_kafka_needs_a_source(spark):
    with pytest.raises(ValueError):
        read_event_stream(spark)


def test_lifecycle_calls_the_state_little():
    from types import SimpleNamespace

    from tidemark.streaming.lifecycle import Lifecycle

    calls = []

    class State:
        def __init__(self, name):
            self.name, self.rows = name, []

        def exists(self):
            calls.append((self.name, "exists"))
            return bool(self.rows)

        def get(self):
            calls.append((self.name, "get"))
            return (self.rows[0] if self.rows else None) if self.name == "due" else iter(self.rows)

        def appendList(self, rows):
            calls.append((self.name, "append"))
            self.rows = self.rows + rows

        def put(self, rows):
            calls.append((self.name, "put"))
            self.rows = list(rows)

        def update(self, row):
            calls.append((self.name, "update"))
            self.rows = [row]

        def clear(self):
            calls.append((self.name, "clear"))
            self.rows = []

    timers = set()
    state = lambda name, schema: State(name)
    handle = SimpleNamespace(getListState=state, getValueState=state, registerTimer=timers.add, deleteTimer=timers.discard)
    run = Lifecycle(300_000)
    run.init(handle)
    mark = lambda ms: SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)
    assert not list(run.handleInputRows(("r",), iter([(2_000, 2, 1), (1_000, 1, 0), (90_000, 3, 2)]), mark(0))) and timers == {1}
    assert len(calls) == 3
    calls.clear()
    assert not list(run.handleExpiredTimer(("r",), mark(50), None)) and timers == {1, 90}
    assert run.waiting.rows == [(90_000, 3, 2)] and run.open.rows == [(1_000, 2_000)]
    calls.clear()
    assert [tuple(r) for r in run.handleExpiredTimer(("r",), mark(95), None)] == [("r", 1_000, 2_000, 90_000)]
    assert sorted(calls) == [("due", "clear"), ("open", "clear"), ("open", "get"), ("waiting", "clear"), ("waiting", "get")]
    # Nothing changes: nothing is written.
    run.handleInputRows(("r",), iter([(96_000, 4, 0)]), mark(95))
    run.handleExpiredTimer(("r",), mark(97), None)
    calls.clear()
    run.handleExpiredTimer(("r",), mark(98), None)
    assert sorted(calls) == [("due", "update"), ("open", "get"), ("waiting", "get")]
