"""Roll-ups merged hour, day, month against the raw rows."""

import random
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import rollups


def test_merged_rollups_keep_spread_and_percentiles(spark):
    rng = random.Random(5)
    start = datetime(2024, 1, 30)
    # A large common value, a hot sensor, nulls and repeated values.
    rows = [(rng.choice(("a", "a", "a", f"s{i % 4}")), start + timedelta(seconds=rng.randrange(4 * 86_400)), 1e6 + round(rng.gauss(0, 3), 2)) for i in range(30_000)]
    df = spark.createDataFrame([*rows, ("a", start, None), ("a", None, 1.0)], "key string, ts timestamp, v double").repartition(7)
    days = rollups.merge_rollups(rollups.rollup(df, "key", "ts", "v"), "key", "day")
    for period, merged in (("day", days), ("month", rollups.merge_rollups(days, "key", "month"))):
        raw = {}
        for key, ts, v in rows:
            raw.setdefault((key, ts.replace(hour=0, minute=0, second=0) if period == "day" else ts.replace(day=1, hour=0, minute=0, second=0)), []).append(v)
        got = {(r.key, r.period): r for r in rollups.rollup_stats(merged, "key", {"p5": 0.05, "p50": 0.5, "p95": 0.95}).collect()}
        assert got.keys() == raw.keys()
        outside = 0
        for k, values in raw.items():
            x, r = np.sort(values), got[k]
            assert r.n == len(x) and r.min == x[0] and r.max == x[-1] and abs(r.mean - x.mean()) < 1e-6
            assert abs(r.stddev - x.std(ddof=1)) < 1e-7 * x.std(ddof=1) + 1e-9
            assert abs(r.n_distinct - len(set(values))) <= 0.05 * len(set(values)) + 1
            for q, p in (("p5", 0.05), ("p50", 0.5), ("p95", 0.95)):
                low, high = np.searchsorted(x, r[q], "left") / len(x), np.searchsorted(x, r[q], "right") / len(x)
                outside += not (low - rollups.RANK_ERROR <= p <= high + rollups.RANK_ERROR)
        assert outside <= 0.1 * 3 * len(raw)
    exact = rollups.rollup_stats(rollups.rollup(df.filter(F.col("key") != "a"), "key", "ts", "v", "day", k=8192), "key", {"p50": 0.5})
    some = {}
    for key, ts, v in rows:
        if key != "a":
            some.setdefault((key, ts.date()), []).append(v)
    assert {(r.key, r.period.date()): r.p50 for r in exact.collect()} == {k: sorted(v)[(len(v) + 1) // 2 - 1] for k, v in some.items()}
    assert rollups.rollup_stats(rollups.rollup(df.limit(0), "key", "ts", "v"), "key").count() == 0
