"""Hot keys: a third or more of all rows on one key, against brute force."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import admin, catalog, domains, extract, patterns, reads, scans, windows
from tidemark.sources.ledger import decode_events, mark_published, outbox_batch, to_kafka_records, write_ledger, read_ledger


def hot_rows(n=900, seed=5):
    rng = random.Random(seed)
    return [("hot" if rng.random() < 0.6 else f"k{rng.randrange(6)}", i, rng.randrange(4), rng.choice([None, rng.randrange(50)])) for i in range(n)]


def test_positions(spark):
    import hashlib

    rows = hot_rows()
    df = spark.createDataFrame([(k, f"id{i}", t) for k, i, t, _ in rows], "k string, id string, t int")
    got = {r.id: (r.position, r.total) for r in scans.positions(df, ["k"], "t", "id", chunk_rows=10).collect()}
    want = {}
    for key in {r[0] for r in rows}:
        mine = sorted((t, hashlib.md5(f"id{i}".encode()).hexdigest(), f"id{i}") for k, i, t, _ in rows if k == key)
        want.update({m[2]: (p + 1, len(mine)) for p, m in enumerate(mine)})
    assert got == want
    beside = {r.id: (r.b, r.a) for r in scans.positions(df, ["k"], "t", "id", before="b", after="a", chunk_rows=10).collect()}
    order = sorted(want, key=lambda x: (next(k for k, i, _, _ in rows if f"id{i}" == x), want[x][0]))
    for x, y in zip(order, order[1:]):
        if want[y][0] == want[x][0] + 1:
            assert (beside[x][1], beside[y][0]) == (y, x)


@pytest.mark.parametrize("include", [False, True])
def test_carried_last(spark, include):
    rows = hot_rows()
    df = spark.createDataFrame([(k, i, v) for k, i, _, v in rows], "k string, i long, v int")
    out = scans.carried_last(df, ["k"], F.floor(F.col("i") / 40), ["i"], F.col("v"), "c", include_current=include)
    got = {r.i: r.c for r in out.collect()}
    last, want = {}, {}
    for k, i, _, v in rows:
        if include and v is not None:
            last[k] = v
        want[i] = last.get(k)
        if v is not None:
            last[k] = v
    assert got == want


def test_running_max(spark):
    rows = [r for r in hot_rows() if r[3] is not None]
    df = spark.createDataFrame([(k, i, v) for k, i, _, v in rows], "k string, i long, v int")
    got = {r.i: r.m for r in scans.running_max(df, ["k"], scans.position_chunk("i", 50), ["i"], "v", "m").collect()}
    best, want = {}, {}
    for k, i, _, v in rows:
        want[i] = best.get(k)
        best[k] = max(v, best.get(k, v))
    assert got == want


def test_fetch_schedule_spacing(spark):
    rng = random.Random(1)
    t0 = 1704067200000
    rows = [("hot.example" if rng.random() < 0.7 else f"h{rng.randrange(3)}", f"w{i}", t0 + rng.choice([0, 0, 300, 5000, 7_200_000])) for i in range(300)]
    df = spark.createDataFrame(rows, "host string, id string, ms long").withColumn("at", F.timestamp_millis("ms"))
    out = patterns.fetch_schedule(df, "host", "at", "id").select("host", "id", "ms", F.unix_millis("start_at").alias("s")).collect()
    assert len(out) == 300
    for host in {r.host for r in out}:
        mine = sorted((r for r in out if r.host == host), key=lambda r: r.s)
        slot = None
        for r in mine:
            assert r.s >= r.ms and (slot is None or r.s - slot >= 1000)
            # No idle time: a start later than its arrival follows the one before directly.
            assert r.s == r.ms or r.s == slot + 1000
            slot = r.s


def test_sessions_break_only_after_the_gap(spark):
    t0 = datetime(2024, 1, 1)
    minutes = [0, 30, 60, 91, 200]
    df = spark.createDataFrame([("u", t0 + timedelta(minutes=m)) for m in minutes], "u string, ts timestamp")
    got = sorted((r.n for r in windows.sessions(df, ["u"], "ts").collect()))
    assert got == [1, 1, 3]
    theirs = df.groupBy("u", F.session_window("ts", "30 minutes")).count().select("count").collect()
    assert sorted(r["count"] for r in theirs) == got


def test_lifecycle_limit_is_strict(spark):
    def events(*steps):
        return [(i, f"e{i}", t, datetime(2024, 1, 1) + timedelta(seconds=s), r) for i, (r, t, s) in enumerate(steps)]

    a, c, e = "link.added", "content.fetched", "enrichment.completed"
    rows = events(("r1", a, 290), ("r1", c, 310), ("r1", e, 589), ("r2", a, 0), ("r2", c, 1), ("r2", e, 300), ("r3", a, 0), ("r3", e, 1), ("r3", c, 2))
    df = spark.createDataFrame(rows, "ord long, id string, event_type string, occurred_at timestamp, correlation_id string")
    assert [r.run_key for r in patterns.lifecycle(df).collect()] == ["r1"]


def test_deep_dive_blocks(spark):
    """Small blocks force several tasks per slice; the result equals brute force."""
    import numpy as np

    rng = np.random.default_rng(3)
    vecs = rng.normal(size=(120, 4))
    t0 = datetime(2024, 1, 1)
    # Half of all vectors fall into one minute.
    at = [t0 + timedelta(seconds=(i if i < 60 else i * 300)) for i in range(120)]
    df = spark.createDataFrame([(i, at[i], [float(x) for x in vecs[i]]) for i in range(120)], "vec_id long, ts timestamp, embedding array<float>")
    for slices in (1, 3):
        got = {r.vec_id: r.n_related for r in patterns.deep_dive(df, 0.7, slices=slices, block_rows=16).collect()}
        unit = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
        want = {}
        for i in range(120):
            n = sum(1 for j in range(120) if 0 < (at[j] - at[i]).total_seconds() < 7200 and unit[i] @ unit[j] > 0.7)
            if n:
                want[i] = n
        assert got == want


def test_transcripts_are_whole(spark):
    df = spark.createDataFrame([("n", i, f"w{i}") for i in range(25)], "note_id string, turn long, text string")
    parts = sorted(domains.transcript_parts(df, 10).collect(), key=lambda r: r.part)
    assert " ".join(p.transcription for p in parts) == " ".join(f"w{i}" for i in range(25))
    assert [p.segments for p in parts] == [10, 10, 5]


def test_article_text():
    html = "<html><head><title>T</title><style>x</style></head><body><nav>menu</nav><article><h1>A &amp; B</h1><p>one\n two<!-- no --></p><script>var t='</p>'</script></article><p>out</p></body></html>"
    assert extract.article_text(html) == "A & B\none\ntwo"
    assert extract.article_text("<p>only body</p>") == "only body"
    # An open head, an open menu and end tags of nothing lose no text.
    assert extract.article_text("<html><head><title>T</title><body><p>text</p>") == "text"
    assert extract.article_text("<head><meta charset=x><p>text</p>") == "text"
    assert extract.article_text("<body><nav><a>menu</a><article><p>text</p></article>") == "text"
    assert extract.article_text("<article></nav></div><p>a</p><nav>x</nav>b</article>") == "a\nb"
    assert extract.article_text("<article><p>a &lt;b&gt; &#8212; c<!-- <p>no</p> --></article>") == "a <b> — c"
    assert extract.article_text("<script>x</script>") is None and extract.article_text(None) is None


def test_extract_article_error(spark):
    df = spark.createDataFrame([(1, "<title>T &amp; U</title><script>1</script>"), (2, "<title>U</title><article>x</article>")], "page_id int, html string")
    got = {r.page_id: (r.title, r.text_content, r.error) for r in extract.extract_article(df).collect()}
    assert got == {1: ("T & U", None, extract.NO_ARTICLE), 2: ("U", "x", None)}


def test_model_failures_become_rows(spark):
    from tidemark.operators.enrich import constant_model, run_model

    df = spark.createDataFrame([("a",), ("b",)], "subject_id string")
    good, bad = run_model(df, constant_model(["x"]), "v1")
    assert [r.tags for r in good.collect()] == [["x"], ["x"]] and bad.count() == 0

    def broken(frame):
        raise RuntimeError("no model")

    good, bad = run_model(df, broken, "v1")
    assert good.count() == 0 and {r.error for r in bad.collect()} == {"no model"}


def test_catalog_order_and_prompt_limit(spark):
    df = spark.createDataFrame([(i, [f"t{i}", "t0"]) for i in range(150)], "ord long, tags array<string>")
    known = catalog.prompt_tags(catalog.tag_catalog(df)).first().known
    assert known == [f"t{i}" for i in range(100)]


def test_compact_drops_tombstones(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("b", 1, "y"), ("b", 2, "z")], "k string, ord long, value string")
    assert [(r.k, r.value) for r in catalog.compact(df, ["k"]).collect()] == [("b", "z")]


def test_lookup_tiers(spark):
    links = spark.createDataFrame([("link:1", "https://a/x", "https://a/x"), ("link:2", "https://b/RAW", "https://b/n")], "subject_id string, url string, url_norm string")
    content = spark.createDataFrame([("link:2", "https://final/2")], "subject_id string, final_url string")
    got = {r.search: (r.tier, r.subject_id) for r in reads.link_lookup(["link:2", "a/x", "final", "RAW", "zzz"], links, content).collect()}
    assert got == {"link:2": (0, "link:2"), "a/x": (1, "link:1"), "final": (2, "link:2"), "RAW": (3, "link:2")}


def test_visibility_target_is_checked(spark):
    with pytest.raises(ValueError):
        admin.visibility_events(spark.range(1), "unlisted", F.current_timestamp())


def test_ledger_round_trip_and_outbox(spark, tmp_path):
    e = spark.createDataFrame(
        [(f"e{i}", datetime(2024, 1, 1 + i % 3, i % 24), "s", "link", f"link:{i % 4}", "link.added", "{}", i % 2 == 0) for i in range(40)],
        "id string, occurred_at timestamp, source string, subject string, subject_id string, event_type string, payload string, published_to_kafka boolean",
    ).withColumn("received_at", F.col("occurred_at"))
    write_ledger(e, str(tmp_path / "ledger"))
    back = read_ledger(spark, str(tmp_path / "ledger"), subject_id="link:1", event_type="link.added")
    assert back.count() == 10
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(subject_id,link:1)" in plan
    batch = outbox_batch(e, 5)
    assert batch.count() == 5
    assert mark_published(e, batch).filter("published_to_kafka").count() == 25
    good, bad = decode_events(to_kafka_records(e).select("value"))
    assert (good.count(), bad.count()) == (40, 0)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_skew_join_equals_plain_join(spark, how):
    from tidemark.operators.skew import hot_keys, skew_join

    rows = hot_rows()
    many = spark.createDataFrame([(k, i) for k, i, _, _ in rows], "k string, i long")
    one = spark.createDataFrame([("hot", 1), ("k1", 2), ("zz", 3)], "k string, v int")
    counts = many.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    assert [r.k for r in hot_keys(counts, ["k"], target=200).collect()] == ["hot"]
    # A low target salts every key, tied counts included.
    got = skew_join(many, one, ["k"], how, salt_by="i", target=2)
    assert hot_keys(counts, ["k"], target=2).count() > 1
    want = many.join(one, "k", how)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_anomalies_at_a_large_mean(spark):
    """Deviations of a thousandth beside values of a billion are not cancelled."""
    import datetime as dt
    import statistics

    base = dt.datetime(2024, 1, 1)
    values = [1e9 + (i % 7) * 0.001 for i in range(31)]
    rows = [("s", base + dt.timedelta(minutes=i), v) for i, v in enumerate(values)] + [("s", base + dt.timedelta(minutes=31), 1e9 + 0.5)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, v double")
    got = windows.anomalies(df, "k", "ts", "v", "1 hour", "1 hour").collect()
    assert [(r.v, round(r.sd, 5)) for r in got] == [(1e9 + 0.5, round(statistics.stdev(v for _, _, v in rows), 5))]


def test_spike_after_silence_and_fall_to_zero(spark):
    import datetime as dt

    day = dt.datetime(2024, 3, 1)
    rows = [("a", day - dt.timedelta(days=40))] + [("a", day)] * 4 + [("b", day)]
    df = spark.createDataFrame(rows, "topic string, ts timestamp")
    assert [(r.n, float(r.mean_before)) for r in windows.topic_spikes(df, "ts", "topic").collect()] == [(4, 0.0)]
    got = {(r.topic, r.period.month): (r.n, r.n_before) for r in windows.period_change(df, "ts", ["topic"]).collect()}
    assert got == {("a", 1): (1, 0), ("a", 2): (0, 1), ("a", 3): (4, 0), ("b", 3): (1, 0)}


def test_salted_path_through_a_query(spark, monkeypatch):
    from tidemark.operators import skew
    from tidemark.plans import registry

    registry.load_all()
    for name in ("session_assignment", "causation_edges", "state_publish_state"):
        want = sorted(map(str, registry.QUERIES[name](spark, "/root/testdata/sf0.001").collect()))
        with monkeypatch.context() as m:
            m.setattr(skew, "TARGET_ROWS", 1)
            m.setattr(skew, "SHARES", 1000)
            assert sorted(map(str, registry.QUERIES[name](spark, "/root/testdata/sf0.001").collect())) == want


def test_one_failing_row_does_not_fail_its_batch(spark):
    from tidemark.operators.enrich import constant_model, run_model

    def picky(frame):
        if (frame["subject_id"] == "s3").any():
            raise ValueError("no answer for s3")
        return constant_model(["x"])(frame)

    df = spark.createDataFrame([(f"s{i}", "text") for i in range(8)], "subject_id string, content string").coalesce(1)
    good, bad = run_model(df, picky, "v1")
    assert {r.subject_id for r in good.collect()} == {f"s{i}" for i in range(8)} - {"s3"}
    assert [(r.subject_id, r.error) for r in bad.collect()] == [("s3", "no answer for s3")]
