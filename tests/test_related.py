"""Related items, causation graphs and clusters against brute force, with hot keys."""

import itertools
import math
import random
from collections import Counter
from datetime import datetime, timedelta

import pytest

from tidemark.operators import causation, clusters, groups, similar


@pytest.mark.parametrize("percent, k, block", [(50, 3, 2_000), (30, 5, 4), (100, 2, 2), (1, 4, 7)])
def test_similar_items(spark, percent, k, block):
    rng = random.Random(percent)
    # One tag that most items hold, many equal sets, rare tags, ties, and items without tags.
    rows = [(i, ["hot"] * (rng.random() < 0.8) + rng.sample([f"t{j}" for j in range(12)], rng.randrange(0, 5)) + [f"r{i % 17}"] * (rng.random() < 0.3)) for i in range(120)]
    rows += [(200 + i, ["hot"]) for i in range(20)] + [(300, None), (301, []), (302, [None, "hot", "hot"]), (303, ["alone"])]
    df = spark.createDataFrame(rows, "subject_id long, tags array<string>")
    got = {}
    for r in similar.similar_items(df, percent=percent, k=k, block=block).collect():
        got.setdefault(r.subject_id, {})[r.rank] = (r.partner, r.overlap, r.similarity)
    sets = {i: set(t or ()) - {None} for i, t in rows}
    want = {}
    for i, s in sets.items():
        near = [(-len(s & u) / len(s | u), j, len(s & u)) for j, u in sets.items() if i != j and s and u and 100 * len(s & u) >= percent * len(s | u)]
        if near:
            want[i] = {r + 1: (j, o, -x) for r, (x, j, o) in enumerate(sorted(near)[:k])}
    assert got == want and len(want) > 20
    assert similar.similar_items(df.limit(0)).count() == 0


@pytest.mark.parametrize("small, block", [(0, 3), (3, 3), (4, 2_000), (9, 2)])
def test_similar_items_of_small_and_large_sets(spark, small, block):
    rng = random.Random(small)
    rows = [(i, rng.sample([f"t{j}" for j in range(11)], rng.randrange(1, 8))) for i in range(90)]
    df = spark.createDataFrame(rows, "subject_id long, tags array<string>")
    got = {(r.subject_id, r.rank): (r.partner, r.overlap) for r in similar.similar_items(df, percent=40, k=3, block=block, small=small).collect()}
    want = {}
    for i, t in rows:
        near = [(-len(s & u) / len(s | u), j, len(s & u)) for j, x in rows if j != i and (s := set(t)) and (u := set(x)) and 100 * len(s & u) >= 40 * len(s | u)]
        want |= {(i, r + 1): (j, o) for r, (_, j, o) in enumerate(sorted(near)[:3])}
    assert got == want and len(want) > 100


def test_small_sets_form_no_pairs(spark):
    sets = spark.createDataFrame([(["hot", f"a{i}", f"b{i % 7}"],) for i in range(60)], "set array<string>")
    assert similar._similar_sets(sets, 10, 2_000, 3).count() == 0
    assert similar._similar_sets(sets, 10, 2_000, 2).count() == 60 * 59 // 2


def plain_forest(cause):
    kids, out = {}, {}
    for i, c in cause.items():
        kids.setdefault(c, []).append(i)
    for i, c in cause.items():
        path = [i]
        while cause.get(path[-1]) in cause and len(path) <= len(cause):
            path.append(cause[path[-1]])
        if len(path) > len(cause):
            out[i] = ("cycle", None, None, None, None)
            continue
        below, todo = 0, [i]
        while todo:
            more = kids.get(todo.pop(), [])
            below += len(more)
            todo += more
        mark = "root" if c is None else "caused" if c in cause else "orphan"
        out[i] = (mark, path[-1], path[-2] if len(path) > 1 else None, len(path) - 1, below)
    return out


def forest(df, **options):
    return {r.id: (r.mark, r.root, r.head, r.depth, r.n_below) for r in causation.causation_forest(df, **options).collect()}


@pytest.mark.parametrize("salts", [None, 3])
def test_causation_forest(spark, salts):
    rng = random.Random(1)
    cause = {0: None, 1: 99_999}
    for i in range(2, 150):
        cause[i] = rng.choice((None, 99_999, 0, 0, rng.randrange(i), i - 1, i - 1))
    cause |= {500: 502, 501: 500, 502: 501, 503: 502, 504: 503, 505: 505}
    df = spark.createDataFrame([*cause.items(), (None, 3)], "id long, causation_id long")
    assert forest(df, salts=salts) == plain_forest(cause)
    assert forest(df.limit(0)) == {}


def test_a_chain_needs_few_rounds(spark, monkeypatch):
    rounds = []
    doubled = causation._doubled
    monkeypatch.setattr(causation, "_doubled", lambda *a: rounds.append(1) or doubled(*a))
    n = 1000
    got = forest(spark.createDataFrame([(i, i - 1 if i else None) for i in range(n)], "id long, causation_id long"))
    assert got == {i: ("caused" if i else "root", 0, 1 if i else None, i, n - 1 - i) for i in range(n)}
    assert len(rounds) <= 11


def plain_clusters(items, rounds=5):
    out = set()
    for week in sorted({w for _, w, _ in items}):
        mine = [sorted(set(t or ()) - {None}) for _, w, t in items if w == week]
        n = Counter(t for s in mine for t in s)
        w = Counter((a, b) for s in mine for a in s for b in s if a != b)
        label = {t: t for t in n}
        for _ in range(rounds):
            new = {}
            for t in n:
                votes = Counter({label[t]: n[t]})
                for (a, b), m in w.items():
                    if a == t:
                        votes[label[b]] += 2 * m
                new[t] = min(votes, key=lambda x: (-votes[x], x))
            label = new
        uses = Counter()
        for t, m in n.items():
            uses[label[t]] += m
        held = Counter()
        for s in mine:
            votes = Counter(label[t] for t in s)
            held[min(votes, key=lambda x: (-votes[x], -uses[x], x)) if votes else None] += 1
        for c in uses:
            tags = sorted((t for t in n if label[t] == c), key=lambda t: (-n[t], t))
            out.add((week, c, ", ".join(tags[:3]), len(tags), held[c]))
        if held[None]:
            out.add((week, None, None, 0, held[None]))
    return out


def test_weekly_clusters(spark):
    rng = random.Random(7)
    topics = [[f"{name}{j}" for j in range(6)] for name in ("stream", "home", "notes")]
    start = datetime(2024, 1, 4)
    items = []
    for i in range(400):
        topic = topics[rng.choice((0, 0, 0, 1, 2))]
        tags = rng.sample(topic, rng.randrange(0, 4)) + ["all"] * (rng.random() < 0.4) + [rng.choice(rng.choice(topics))] * (rng.random() < 0.1)
        items.append((i, start + timedelta(days=7 * (i % 3)), rng.choice((tags, tags, tags, None))))
    df = spark.createDataFrame([(i, w + timedelta(hours=i % 160), t) for i, w, t in items] + [(999, None, ["x"])], "id long, ts timestamp, tags array<string>")
    got = clusters.weekly_clusters(df, "id", "ts", "tags").collect()
    assert {(r.week, r.cluster, r.name, r.n_tags, r.n_items) for r in got} == plain_clusters(items)
    per_week = Counter(w for _, w, _ in items)
    assert all(sum(r.n_items for r in got if r.week == w) == n for w, n in per_week.items()) and 1 < len({r.cluster for r in got}) < 19
    assert math.isfinite(len(got)) and clusters.weekly_clusters(df.limit(0), "id", "ts", "tags").count() == 0


def test_recurring_groups(spark):
    rng = random.Random(3)
    start = datetime(2024, 1, 1, 9)
    team, pair = ["ann", "bob", "cat", "dan"], ["ann", "zoe"]
    rows = [(i, start + timedelta(days=7 * i), team + rng.sample(["eve", "fay"], rng.randrange(3))) for i in range(12)]
    rows += [(100 + i, start + timedelta(days=i), pair + ([None, "zoe"] if i % 3 else [])) for i in range(30)]
    rows += [(200 + i, start + timedelta(hours=rng.randrange(900)), rng.sample([*team, *pair, "eve", "fay"], rng.randrange(0, 5))) for i in range(40)]
    rows += [(300, None, ["ann", "bob"]), (301, start, None), (302, start, [])]
    sets, times = {}, {}
    for i, at, who in rows:
        for k in range(1, 7):
            for g in itertools.combinations(sorted(set(who or ()) - {None}), k):
                sets[g] = sets.get(g, 0) + 1
                times.setdefault(g, []).append((at, i)) if at else None
    want = {}
    for g, n in sets.items():
        if 2 <= len(g) <= 5 and n >= 3 and not any(m == n and len(h) == len(g) + 1 and set(g) < set(h) for h, m in sets.items()):
            order = sorted(times[g])
            gaps = Counter((b[0] - a[0]).days for a, b in itertools.pairwise(order))
            best = min(gaps, key=lambda d: (-gaps[d], d))
            want[g] = (n, best, gaps[best] / sum(gaps.values()))
    df = spark.createDataFrame(rows, "id long, start timestamp, who array<string>")
    got = {tuple(r.attendees): (r.n, r.period_days, r.regularity) for r in groups.recurring_groups(df, "id", "who", "start").collect()}
    assert got == want and want[tuple(team)][1] == 7 and len({len(g) for g in want}) == 4
    assert groups.recurring_groups(df.limit(0), "id", "who", "start").count() == 0


def test_equal_lists_and_moments_are_one_row(spark):
    start = datetime(2024, 1, 1, 9)
    rows = [(i, start + timedelta(days=i % 20 // 10), [["ann", "bob"], ["bob", "ann", None], ["ann", "zoe", f"once{i}"]][i % 3]) for i in range(300)]
    df = spark.createDataFrame(rows + [(999, start, None)], "id long, start timestamp, who array<string>")
    often, lists, moments = groups._lists(df, "id", "who", "start", 50)
    assert sorted((r["name"], r.n) for r in often.collect()) == [("ann", 300), ("bob", 200), ("zoe", 100)]
    assert sorted(r.n for r in lists.collect()) == [100, 200] and moments.count() == 4
    got = {tuple(r.attendees): (r.n, r.period_days, r.regularity) for r in groups.recurring_groups(df, "id", "who", "start", least=50).collect()}
    assert got == {("ann", "bob"): (200, 0, 198 / 199), ("ann", "zoe"): (100, 0, 98 / 99)}
