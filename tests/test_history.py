"""Interval history of link states against folds of prefixes."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import folds, history
from tidemark.sources import ledger

EVENTS = "ord long, id string, subject_id string, event_type string, payload string, occurred_at timestamp, received_at timestamp, source string"
START = datetime(2024, 1, 30, 20)


def events(rng, n=900):
    rows, now = [], START
    for i in range(n):
        now += timedelta(minutes=rng.choice((0, 7, 60, 400)))
        kind = rng.choice(folds.LINK_TYPES + folds.LINK_TYPES[1:] * 2)
        body = {
            "link.added": {"url": rng.choice(("https://e.com/a", None))}, "content.fetched": {"title": "t", "fetch_error": rng.choice((None, f"HTTP {i}"))},
            "link.visibility_changed": {"visibility": rng.choice(("public", "private", "odd"))},
        }.get(kind, {})
        subject = "link:hot" if rng.random() < 0.4 else f"link:{rng.randrange(30)}"
        rows.append((i, f"e{i}", subject, kind, json.dumps({k: v for k, v in body.items() if v is not None}), now - timedelta(days=1), now, "s"))
    return rows


@pytest.mark.parametrize("chunk", [7, 1_000_000])
def test_history_is_the_fold_of_every_prefix(spark, tmp_path, chunk):
    rows = events(random.Random(chunk))
    df = spark.createDataFrame(rows, EVENTS)
    path = f"{tmp_path}/history"
    history.write_history(history.link_history(df, chunk), path)
    last = rows[-1][6]
    moments = [START, rows[3][6], rows[200][6], START + (last - START) / 2 + timedelta(seconds=1), datetime(2024, 2, 1), rows[700][6], last, last + timedelta(days=90)]
    states = {}
    for m in moments:
        got = {tuple(r[c] for c in ("subject_id", *history.STATE)) for r in history.read_as_of(spark, path, m).collect()}
        partials = folds.link_partials(ledger.as_of(df, F.lit(m).cast("timestamp")))
        want = {tuple(r) for r in folds.links(partials).select("subject_id", *history.STATE).collect()}
        assert got == want
        states[m] = {r[0]: r[1:] for r in want}
    a, b = moments[2], moments[5]
    changed = {r.subject_id for r in history.changes_between(spark, path, a, b).collect()}
    assert changed == {s for s in states[a].keys() | states[b].keys() if states[a].get(s) != states[b].get(s)} and changed


def test_a_moment_is_one_pruned_scan(spark, tmp_path):
    path = f"{tmp_path}/history"
    history.write_history(history.link_history(spark.createDataFrame(events(random.Random(3)), EVENTS)), path)
    periods = spark.read.parquet(path).select("period").distinct().count()
    read = history.read_as_of(spark, path, datetime(2024, 3, 3))
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert periods >= 3 and plan.count("Scan parquet") == 1 and "Aggregate" not in plan and "Join" not in plan and "Exchange" not in plan
    assert len({f.split("period=")[1][:10] for f in read.select(F.input_file_name()).distinct().toPandas().iloc[:, 0]}) == 1
    assert history.read_as_of(spark, path, datetime(2023, 1, 1)).count() == 0


def test_empty_ledger(spark):
    assert history.link_history(spark.createDataFrame([], EVENTS)).count() == 0
