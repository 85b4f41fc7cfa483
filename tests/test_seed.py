"""A fixed event set of all domains and the state it folds to."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tests.model import dumps
from tidemark.operators import folds

START = datetime(2024, 1, 1)
STAGES = ["link.added", "content.fetched", "enrichment.completed", "publish.completed"]
# How many links reach how many stages.
REACH = [4] * 3 + [3] * 3 + [2] * 2 + [1] * 2


def seed_events(spark):
    rows = []

    def add(sid, subject, kind, payload):
        n = len(rows)
        rows.append((n, f"e{n}", START + timedelta(minutes=n), "seed", subject, sid, kind, dumps(payload)))

    for i, reach in enumerate(REACH):
        body = [{"url": f"https://example.com/{i}"}, {"title": f"t{i}"}, {"tags": ["a", f"b{i}"], "summary": f"s{i}"}, {}]
        for stage in range(reach):
            add(f"link:{i}", "link", STAGES[stage], body[stage])
    for i in range(25):
        for room in ("office", "bedroom"):
            add(f"sensor:{room}", "sensor", "temp.reading_recorded", {"celsius": 20 + i / 10, "humidity": 40})
    for i in range(10):
        add(f"todoist:{i}", "todo", "todo.created", {"title": f"todo {i}", "labels": ["x"]})
    for i in range(4):
        add(f"todoist:{i}", "todo", "todo.completed", {})
    return spark.createDataFrame(
        rows, "ord long, id string, occurred_at timestamp, source string, subject string, subject_id string, event_type string, payload string"
    )


def test_seed_state(spark):
    e = seed_events(spark)
    p = folds.link_partials(e)
    assert e.count() == 91
    status = {r.status: r.n for r in folds.links(p).groupBy("status").agg(F.count("*").alias("n")).collect()}
    assert status == {"published": 3, "enriched": 3, "fetched": 2, "new": 2}
    assert (folds.link_content(p).count(), folds.link_metadata(p).count()) == (8, 6)
    assert (folds.temperature_readings(e).count(), folds.temperature_latest(e).count()) == (50, 2)
    todos = folds.todos(e)
    assert (todos.count(), todos.filter("status = 'done'").count()) == (10, 4)
    assert folds.subjects(e).count() == 22
    meta = folds.link_metadata(p).filter("subject_id = 'link:0'").first()
    assert (meta.tags, meta.summary_short) == (["a", "b0"], "s0")
