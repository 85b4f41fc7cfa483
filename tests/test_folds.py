import random

import pytest
from pyspark.sql import functions as F

from tests.model import STAGES, State, dumps, random_payload
from tidemark.operators import folds, routing
from tidemark.sources.ledger import duplicates_removed, with_payload

SCHEMA = "ord long, id string, subject_id string, event_type string, payload string, occurred_at timestamp, source string"


def frame(spark, rows):
    """rows: (ord, subject, type, payload dict); the event time is the position in seconds."""
    data = [(o, f"e{o}", s, t, dumps(p), o, "src") for o, s, t, p in rows]
    df = spark.createDataFrame(data, SCHEMA.replace("occurred_at timestamp", "occurred_at long"))
    return df.withColumn("occurred_at", F.timestamp_seconds("occurred_at"))


def seconds(ts):
    return None if ts is None else int(ts.timestamp())


def by_key(df, key="subject_id"):
    return {r[key]: r.asDict() for r in df.collect()}


def check_against_model(spark, rows, partials):
    model = State()
    for o, s, t, p in rows:
        model.apply(s, t, p, o, "src")
    links, content = by_key(folds.links(partials)), by_key(folds.link_content(partials))
    meta, publish = by_key(folds.link_metadata(partials)), by_key(folds.publish_state(partials))
    assert set(links) == set(model.links) and set(content) == set(model.content)
    assert set(meta) == set(model.meta) and set(publish) == set(model.publish)
    for s, m in model.links.items():
        got = links[s]
        # The model clears nothing after an error, like the handlers.
        assert {k: got[k] for k in ("url", "source", "status", "visibility", "retry_count", "last_error")} == {
            k: m[k] for k in ("url", "source", "status", "visibility", "retry_count", "last_error")}, (s, got, m)
        assert (seconds(got["created_at"]), seconds(got["last_error_at"])) == (m["created_at"], m["last_error_at"])
    for s, m in model.content.items():
        got = content[s]
        assert all(got[k] == m[k] for k in m if k != "fetched_at") and seconds(got["fetched_at"]) == m["fetched_at"]
    for s, m in model.meta.items():
        assert all(meta[s][k] == m[k] for k in m)
    for s, m in model.publish.items():
        got = publish[s]
        assert all(got[k] == m[k] for k in ("desired_version", "published_version", "dirty")), (s, got, m)
        assert seconds(got["last_published_at"]) == m["last_published_at"]


def random_rows(seed, subjects=400, length=9):
    rng = random.Random(seed)
    rows = [(f"link:{s}", k) for s in range(subjects) for k in rng.choices(STAGES, k=rng.randrange(1, length))]
    rng.shuffle(rows)
    return [(i + 1, s, k, random_payload(rng, k)) for i, (s, k) in enumerate(rows)]


@pytest.mark.parametrize("seed", [1, 2])
def test_random_sequences(spark, seed):
    rows = random_rows(seed)
    check_against_model(spark, rows, folds.link_partials(frame(spark, rows)))


def test_batches_merge_to_the_whole(spark):
    rows = random_rows(3, subjects=200)
    events = frame(spark, rows)
    state, cuts = None, [0, 150, 151, 500, 10**6]
    for lo, hi in zip(cuts, cuts[1:]):
        part = events.filter((F.col("ord") > lo) & (F.col("ord") <= hi))
        new = folds.link_partials(part, known=state)
        state = new if state is None else folds.merge_partials(state, new)
        state = spark.createDataFrame(state.collect(), state.schema)
    check_against_model(spark, rows, state)


def test_repeated_events_change_nothing(spark):
    rows = random_rows(4, subjects=100)
    events = frame(spark, rows)
    again = events.filter("ord % 3 = 0").withColumn("ord", F.col("ord") + 100000)
    once = duplicates_removed(events.unionByName(again), ["id"])
    check_against_model(spark, rows, folds.link_partials(once))


A, C, E, P = "link.added", "content.fetched", "enrichment.completed", "publish.completed"
SEQUENCES = [
    ([(A, {"url": "u"}), (C, {}), (E, {}), (P, {})], "published", (1, 1, False)),
    ([(A, {"url": "u"}), (C, {"fetch_error": "E"}), (C, {})], "error", None),
    ([(A, {"url": "u"}), (E, {}), (C, {})], "enriched", (1, 0, True)),
    ([(A, {"url": "u"}), (E, {}), (P, {}), (E, {})], "published", (2, 1, True)),
    ([(C, {}), (A, {"url": "u"})], "new", None),
    ([(E, {}), (A, {"url": "u"}), (P, {})], "published", None),
    ([(A, {"url": "u"}), (E, {"tags": ["a"]}), (E, {"tags": []})], "enriched", (2, 0, True)),
]


@pytest.mark.parametrize("steps,status,versions", SEQUENCES)
def test_golden_sequences(spark, steps, status, versions):
    p = folds.link_partials(frame(spark, [(i, "link:1", t, d) for i, (t, d) in enumerate(steps)]))
    assert folds.links(p).first().status == status
    row = folds.publish_state(p).first()
    assert (None if row is None else (row.desired_version, row.published_version, row.dirty)) == versions


def test_readings(spark):
    rows = [(1, 2, 20.0), (2, 1, 10.0), (3, 2, 99.0)]
    df = spark.createDataFrame(
        [(o, "sensor:a", "temp.reading_recorded", dumps({"celsius": c}), t) for o, t, c in rows],
        "ord long, subject_id string, event_type string, payload string, t long",
    ).withColumn("occurred_at", F.timestamp_seconds("t"))
    assert sorted(r.celsius for r in folds.temperature_readings(df).collect()) == [10.0, 20.0]
    assert folds.temperature_latest(df).first().celsius == 20.0
    assert folds.temperature_latest(df, dialect="sql").first().celsius == 99.0


def test_todos(spark):
    rows = [
        (1, "t:1", "todo.created", {"title": "a", "labels": ["x"], "project": "p"}),
        (2, "t:1", "todo.created", {"title": "b"}),
        (3, "t:2", "todo.created", {"title": "a"}),
        (4, "t:2", "todo.completed", {}),
        (5, "t:2", "todo.created", {"title": "c"}),
        (6, "t:3", "todo.completed", {}),
        (7, "t:3", "todo.created", {"title": "z"}),
        (8, "t:4", "todo.created", {"title": ""}),
    ]
    got = by_key(folds.todos(frame(spark, rows)))
    assert (got["t:1"]["title"], got["t:1"]["labels"], got["t:1"]["project"]) == ("b", [], "p")
    assert (got["t:2"]["status"], got["t:2"]["title"]) == ("done", "c")
    assert got["t:3"]["status"] == "open" and "t:4" not in got


def test_subject_survives_null_celsius(spark):
    rows = [
        (1, "sensor:a", "temp.reading_recorded", {"celsius": None}),
        (2, "sensor:b", "temp.reading_recorded", {}),
        (3, "link:1", "link.added", {"url": "u"}),
        (4, "link:1", "link.visibility_changed", {"visibility": "private"}),
        (5, "link:1", "link.visibility_changed", {"visibility": "bogus"}),
    ]
    got = by_key(folds.subjects(frame(spark, rows)))
    assert set(got) == {"sensor:a", "link:1"} and got["link:1"]["visibility"] == "private"


def test_annotation_needs_its_link(spark):
    note = {"annotation_id": "n", "link_subject_id": "link:1"}
    rows = [
        (1, "anno:n", "annotation.added", {**note, "quote": "lost"}),
        (2, "link:1", "link.added", {"url": "u"}),
        (3, "anno:n", "annotation.added", {**note, "note": "kept", "selector": {"page": 1}}),
    ]
    row = folds.annotations(frame(spark, rows)).first()
    assert (row.quote, row.note, row.selector, row.updated_at) == (None, "kept", '{"page":1}', None)


@pytest.mark.parametrize("attempt,retried", [(2, True), (3, False)])
def test_retry_or_dead_letter(spark, attempt, retried):
    work = {"subject_id": "link:1", "work_type": "fetch_link", "correlation_id": "c", "triggered_by_event_id": "e", "attempt": attempt,
            "max_attempts": 3, "created_at": "2024-01-01T00:00:00Z", "payload": {"url": "u"}}
    events = frame(spark, [(1, "link:1", "work.failed", {"work_message": work, "error": "E", "agent": "fetcher"})])
    failed = routing.failed_work(with_payload(events))
    now = F.lit("2024-01-02").cast("timestamp")
    retry, dead = routing.retry_work(failed, now).collect(), routing.dead_letters(failed, now).collect()
    assert (len(retry), len(dead)) == ((1, 0) if retried else (0, 1))
    if retried:
        assert (retry[0].attempt, retry[0].last_error, retry[0].payload) == (3, "E", '{"url":"u"}')
