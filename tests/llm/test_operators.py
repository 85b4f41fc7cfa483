"""Dealt operators against brute force on small hand-made rows."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import common, embedding_dedup, hilbert_shards, html_blocks, minhash_dedup, packing, passage_dedup, phrase_index
from tidemark.llm.components import components

DOCS = "doc_id long, text string, id string, n long"


def words(rng, n, size=400):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def corpus(seed=3):
    """Copies, near copies, shared passages, blanks, short texts, repeated rows, clashing columns."""
    rng = random.Random(seed)
    base = words(rng, 90)
    passage = words(rng, 60)
    rows = [(1, " ".join(base))]
    for i in range(2, 14):
        near = list(base)
        for _ in range(rng.randrange(0, 5)):
            near[rng.randrange(len(near))] = f"x{rng.randrange(9)}"
        rows.append((i, " ".join(near)))
    rows += [(20 + i, " ".join(words(rng, 30) + passage + words(rng, 20 + i))) for i in range(4)]
    rows += [(30, " ".join(passage[:51])), (31, " ".join(passage[:50])), (32, "One TWO three"), (33, "one two  three"), (34, ""), (35, None), (36, " \n\t "), (37, "é ß 中文 ñ é ß")]
    rows += [(40 + i, " ".join(words(rng, 70))) for i in range(4)] + [(40, rows[0][1]), (None, rows[0][1])]
    rows += [(50, " ".join(["again"] * 200)), (51, " ".join(["again"] * 199))]
    return [(i, t, "clash", 7) for i, t in rows]


def split(text):
    return (text or "").encode().lower().split()


def shingles(text):
    w = split(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def groups(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_words_match_python():
    rng = random.Random(1)
    texts = ["".join(rng.choice("aB z\t\n\x0b.é中\x1c-9") for _ in range(rng.randrange(40))) for _ in range(200)] + ["", None]
    column = pa.array([t if t is None else t.encode() for t in texts], pa.binary())
    alnum = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for rule, cut in ((common.BLANK, split), (common.ALNUM, lambda t: alnum.findall((t or "").encode().lower()))):
        seen, hashed = {}, {}
        for low, high, found in common.steps(column, rule, 64):
            for i in range(low, high):
                want = cut(texts[i])
                got = found.hashes[found.at[i - low] : found.at[i - low + 1]].tolist()
                assert len(want) == len(got)
                for w, h in zip(want, got):
                    assert seen.setdefault(w, h) == h and hashed.setdefault(h, w) == w


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(20)] + [(5, 5)]
    edges = spark.createDataFrame([*links, (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components(edges, "a", "b").collect()}
    want = groups({x for p in links for x in p}, links)
    assert got == {n: c for n, c in want.items() if any(n in p and p[0] != p[1] for p in links)}
    assert components(edges.limit(0), "a", "b").count() == 0


@pytest.mark.parametrize("chunk", [minhash_dedup.CHUNK_SHINGLES, 100])
def test_near_duplicates(spark, chunk):
    rows = corpus()
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, DOCS), chunk=chunk).collect()
    sets = [(i, shingles(t)) for i, t, _, _ in rows if i is not None]
    links = [(a, b) for (a, x), (b, y) in itertools.combinations(sets, 2) if x and y and 100 * len(x & y) >= 75 * len(x | y)]
    want = groups({i for i, _ in sets}, links)
    assert len(got) == len(rows)
    for r in got:
        assert (r.component_id, r.kept) == ((None, True) if r.doc_id is None else (want[r.doc_id], want[r.doc_id] == r.doc_id))
    assert sorted((r.doc_id or -1, r.n_shingles) for r in got) == sorted((i or -1, len(shingles(t))) for i, t, _, _ in rows)
    assert minhash_dedup.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_cross_links_are_exact():
    """The exact pass finds what the first leader of a bucket misses."""
    rng = np.random.default_rng(0)
    core = rng.integers(1, 1 << 62, 300, dtype=np.uint64)
    sets = [np.unique(np.concatenate([core[k * 30 : k * 30 + 200], rng.integers(1, 1 << 62, 5, dtype=np.uint64)])) for k in range(4)] * 2
    ids, comps = np.arange(len(sets)), np.arange(len(sets))
    got = {tuple(sorted(x)) for x in minhash_dedup._cross_links(ids, comps, sets, 75)}
    want = {(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 75 * len(np.union1d(sets[a], sets[b]))}
    assert got == want and want


def brute_passages(rows, n=51):
    where = {}
    for i, t, _, _ in rows:
        w = split(t)
        if i is not None:
            for s in range(len(w) - n + 1):
                where.setdefault(tuple(w[s : s + n]), set()).add((i, t))
    held, later = {}, {}
    for i, t, _, _ in rows:
        w = split(t)
        for s in range(len(w) - n + 1) if i is not None else ():
            others = where[tuple(w[s : s + n])]
            if len({x for _, x in others}) > 1 or len({x for x, _ in others}) > 1:
                held.setdefault(i, set()).update(range(s, s + n))
                if min(x for x, _ in others) != i:
                    later.setdefault(i, set()).update(range(s, s + n))
    return held, later


def test_repeated_passages(spark):
    rows = [r for r in corpus() if r[:2] != (40, corpus()[0][1])]
    df = spark.createDataFrame(rows, DOCS)
    got = passage_dedup.repeated_passages(df)
    held, later = {}, {}
    for r in got.filter("exact").collect():
        held.setdefault(r.doc_id, set()).update(range(r.first_word, r.last_word + 1))
        if not r.is_first:
            later.setdefault(r.doc_id, set()).update(range(r.first_word, r.last_word + 1))
        assert r.n_words >= 51 and r.passage_id <= r.doc_id
    assert (held, later) == brute_passages(rows)
    kept = {r.doc_id: r for r in passage_dedup.without_repeats(df, got).collect()}
    for i, t, _, _ in rows:
        if i is not None and i not in later and not got.filter((F.col("doc_id") == i) & ~F.col("is_first")).count():
            assert kept[i].text == t and kept[i].id == "clash"
    after = [(i, r.text, "", 0) for i, r in kept.items()]
    assert not brute_passages(after)[1]
    assert passage_dedup.repeated_passages(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("options", [{}, {"chunk": 3}])
def test_near_passages_beside_a_line_that_all_share(spark, options):
    """Edited copies hold a line that many unrelated texts hold too; each near window is found."""
    rng = random.Random(11)
    line = words(rng, 20, 10_000)
    rows = [(i, " ".join(words(rng, 20, 10_000) + line + words(rng, 30, 10_000)), "", 0) for i in range(900, 940)]
    for group in range(12):
        body = words(rng, 40, 10_000) + line + words(rng, 40, 10_000)
        for copy, edits in enumerate(((), (25, 75), (30, 78))):
            rows.append((300 * (group % 2) + 10 * group + copy, " ".join(f"x{copy}.{at}" if at in edits else w for at, w in enumerate(body)), "", 0))
    got = {}
    for r in passage_dedup.repeated_passages(spark.createDataFrame(rows, DOCS), **options).collect():
        assert r.passage_id // 10 == r.doc_id // 10 and r.is_first == (r.passage_id == r.doc_id)
        got.setdefault((r.doc_id, r.is_first), set()).update(range(r.first_word, r.last_word - 49))
    cuts = {i: [{tuple(split(t)[s + j : s + j + 5]) for j in range(47)} for s in range(len(split(t)) - 50)] for i, t, _, _ in rows}
    least = {}
    for i, j in itertools.permutations(cuts, 2):
        for s, (x, y) in enumerate(zip(cuts[i], cuts[j])):
            if 100 * len(x & y) >= 75 * len(x | y):
                least[i, s] = min(i, j, least.get((i, s), j))
    found = {(i, s) for (i, is_first), starts in got.items() for s in starts if is_first == (least.get((i, s)) == i)}
    assert len(least) > 1000 and found <= set(least) and len(found) >= 0.97 * len(least)
    assert {i for i, _ in found} == {i for i, _, _, _ in rows if i < 900}


def test_windows_are_the_cartesian_tree():
    rng = np.random.default_rng(4)
    for n, t in ((200, 7), (60, 60), (5, 6)):
        h = rng.integers(1, 1 << 62, n, dtype=np.uint64)
        l, c, r = passage_dedup.cartesian_windows(h, np.array([0]), np.array([n - 1]), t)
        for a, m, b in zip(l, c, r):
            assert b - a + 1 >= t and h[m] == h[a : b + 1].min() and (a == 0 or h[a - 1] < h[m]) and (b == n - 1 or h[b + 1] < h[m])
        starts = sorted(s for a, m, b in zip(l, c, r) for s in range(max(a, m - t + 1), min(m, b - t + 1) + 1))
        assert starts == list(range(n - t + 1))


def test_window_minima_of_several_ranges():
    rng = np.random.default_rng(5)
    h = rng.integers(1, 40, 400, dtype=np.uint64) << np.uint64(50)
    first, last = np.array([0, 90, 100, 180, 395]), np.array([99, 92, 190, 394, 399])
    got = list(zip(*passage_dedup.cartesian_windows(h, first, last, 9)))
    assert all((h[l : r + 1] >= h[c]).all() for l, c, r in got)
    for a, b in ((0, 99), (100, 190), (180, 394)):
        starts = sorted(s for l, c, r in got if a <= l and r <= b for s in range(max(l, c - 8), min(c, r - 8) + 1))
        assert set(starts) >= set(range(a, b - 7))
    assert sum(min(c, r - 8) - max(l, c - 8) + 1 for l, c, r in got) == 92 + 83 + 207
    words = rng.integers(0, 1 << 63, 90, dtype=np.uint64)
    for n in (1, 2, 5, 51, 90):
        total = np.zeros(91 - n, dtype=np.uint64)
        for j in range(n):
            total = total * np.uint64(0xD6E8FEB86659FD93) + words[j : 91 - n + j]
        assert (common.shingle_hashes(words, n) == common.mix(total + np.uint64(n))).all()


def test_near_windows_are_those_of_all_pairs(monkeypatch):
    """Every window's smallest near id; windows that agree place by place are not sorted."""
    rng, window = np.random.default_rng(6), 9
    base = [rng.integers(0, r, 40, dtype=np.uint32) for r in (1 << 30, 12, 1 << 30)]
    group, ids, c1, c2, rows = [], [], [], [], []
    for i in range(90):
        g, n = i // 30, int(rng.integers(window, 16))
        a = int(rng.integers(20 - n + 1, 18))
        row = base[g][a : a + n].copy()
        row[rng.random(n) < 0.1] = rng.integers(0, 1 << 30)
        group.append(g), ids.append(i // 2), c1.append(18 - a), c2.append(19 - a + int(rng.random() < 0.2)), rows.append(row)
    sorted_ = []
    met = passage_dedup._windows_met
    monkeypatch.setattr(passage_dedup, "_windows_met", lambda x, y, *rest: sorted_.append((x, y)) or met(x, y, *rest))
    arrays = [np.array(x) for x in (group, ids, c1, c2)]
    s0 = np.arange(90) * 100
    lengths = np.array([len(r) for r in rows])
    one, low, high, least = passage_dedup.near_windows(*arrays, s0, np.concatenate(rows), lengths, window, 75)
    got = {s: b for _, lo, hi, b in zip(one, low, high, least) for s in range(lo, hi + 1)}
    want = {}
    for m, x in enumerate(rows):
        for o, y in enumerate(rows):
            for move in {c1[o] - c1[m], c2[o] - c2[m]} if group[m] == group[o] and ids[m] != ids[o] else ():
                for i in range(max(0, -move), min(len(x), len(y) - move) - window + 1):
                    a, b = set(x[i : i + window].tolist()), set(y[i + move : i + move + window].tolist())
                    if 100 * len(a & b) >= 75 * len(a | b):
                        s = 100 * m + i
                        want[s] = min(want.get(s, ids[m]), ids[o])
    assert got == want and len(want) > 100
    assert not any((x == y).all(axis=1).any() for x, y in sorted_)


def test_nodes_are_made_once(spark, monkeypatch):
    plans, stored = {}, common.stored
    monkeypatch.setattr(common, "stored", lambda frame, name: plans.setdefault(name, frame._jdf.queryExecution().executedPlan().toString()) and stored(frame, name))
    passage_dedup.repeated_passages(spark.createDataFrame([(1, "a b c", "en", 0)], DOCS))
    assert plans["nodes"].split("== Initial Plan ==")[-1].count("MapInArrow") == 1


def brute_hits(doc, items, n=13):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = lambda t: word.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    w = lower(doc)
    hit, found = set(), set()
    for i, text in items:
        x = lower(text)
        for k in range(max(1, len(x) - n + 1)) if x else ():
            part = x[k : k + n]
            for s in range(len(w) - len(part) + 1):
                if w[s : s + len(part)] == part:
                    hit.update(range(s, s + len(part)))
                    found.add(i)
    return len(w), len(hit), sorted(map(str, found))


@pytest.mark.parametrize("slice_words", [phrase_index.SLICE_WORDS, 20])
def test_decontamination(spark, monkeypatch, slice_words):
    monkeypatch.setattr(phrase_index, "SLICE_WORDS", slice_words)
    monkeypatch.setattr(phrase_index, "SEGMENT_BYTES", 900)
    rng = random.Random(5)
    items = [(i, " ".join(words(rng, 10 + i, 8))) for i in range(12)] + [(20, "Only, three-words!"), (21, ""), (22, None), (23, " ".join(words(rng, 20, 8)))]
    docs = [(i, " ".join(words(rng, 40, 8) + (items[i % 12][1].split() if i % 3 else []) + words(rng, 30 * (i % 4), 8))) for i in range(30)]
    docs += [(50, "x only THREE words"), (51, None), (52, ""), (53, "only three"), (0, docs[0][1]), (54, " ".join(["a"] * 3000)), (None, items[5][1])]
    got = phrase_index.decontamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    mine = sorted((r.doc_id or -1, r.n_words, r.n_hit, r.item_ids, r.contaminated) for r in got)
    want = []
    for i, t in docs:
        n, hit, found = brute_hits(t, items)
        want.append((i or -1, n, hit, found, hit > 0 and 20 * hit >= n))
    assert mine == sorted(want)


def test_proximity_matches(spark):
    docs = spark.createDataFrame([(1, "alpha x beta gamma"), (2, "alpha beta gamma"), (3, "alpha x x x beta x gamma"), (4, "gamma beta")], "doc_id long, text string")
    items = spark.createDataFrame([(9, "alpha beta gamma")], "item_id long, text string")
    index = phrase_index.build_index(docs)
    near = {(r.segment, r.ordinal) for r in phrase_index.matches(index, items, slack=1).collect()}
    exact = {(r.segment, r.ordinal) for r in phrase_index.matches(index, items).collect()}
    assert len(exact) == 1 and len(near) == 2


def test_encoder_equals_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as file:
        encode = packing.Encoder(file.read())
    whole = Tokenizer.from_file(path)
    rng = random.Random(6)
    letters = "abcXYZ019 .,'!?-_<|>%éÀßüÿñ×÷²µª\n\t\r\x0b\x1c\x85 　́ﬁ中가İΣς'sT'Re"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(3000)]
    texts += ["a <|endoftext|> b", "<|startoftext|>x", "It's don't WE'LL 3rd", "", " \n"]
    for t in texts:
        assert encode(t) == np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), repr(t)


def test_plan_holds_every_piece_once():
    rng = random.Random(7)
    for capacity, hist in ((2048, {rng.randrange(1, 2049): rng.randrange(1, 90) for _ in range(300)}), (10, {10: 3, 7: 4, 3: 9, 1: 2}), (50, {}), (50, {1: 1000})):
        runs = packing.plan_runs(hist, capacity)
        used = {}
        for lengths, n in runs:
            assert sum(lengths) <= capacity and n > 0
            for x in lengths:
                used[x] = used.get(x, 0) + n
        assert used == hist
        total = sum(k * n for k, n in hist.items())
        if capacity == 2048:
            assert sum(n for _, n in runs) <= 1.02 * total / capacity + 2
        places = packing.places(runs)
        assert sorted(places[:, 0].tolist()) == places[:, 0].tolist()


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    rng = random.Random(8)
    rows = [(i, " ".join(words(rng, rng.choice([1, 5, 60, 300])))) for i in range(80)] + [(90, None), (91, ""), (92, " ".join(words(rng, 1500))), (3, "twice"), (3, "twice"), (None, "x")]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), path, chunk_pieces=5, with_ids=True).collect()
    model = Tokenizer.from_file(path)
    want = sorted((i or -1, tuple(model.encode(t or "", add_special_tokens=False).ids + [0])) for i, t in rows)
    whole = {}
    for r in sorted(got, key=lambda r: r.piece):
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length <= 2048 and zlib.crc32(r.ids) == r.ids_crc32
        if r.piece == 0:
            whole.setdefault(r.doc_id or -1, []).append(ids)
        else:
            assert len(whole[r.doc_id][0]) == r.start
            whole[r.doc_id][0] += ids
    assert sorted((i, tuple(x)) for i, xs in whole.items() for x in xs) == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), path).count() == 0


def test_hilbert_curve_is_a_path():
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        points = sorted(itertools.product(range(1 << bits), repeat=dims), key=lambda p: hilbert_shards.hilbert_index(p, bits))
        assert sorted(hilbert_shards.hilbert_index(p, bits) for p in points) == list(range(1 << bits * dims))
        assert all(sum(abs(a - b) for a, b in zip(p, q)) == 1 for p, q in zip(points, points[1:]))


def test_shards(spark):
    rng = random.Random(9)
    rows = [(i, None if i % 17 == 0 else "é" * rng.randrange(50), rng.choice(["en", "de", None]), f"src{min(rng.randrange(30), 9)}", 1) for i in range(500)]
    rows += [rows[4], rows[4], (None, "x", None, None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size int")
    got = hilbert_shards.hilbert_shards(df, chunk_rows=20).collect()
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in got) == sorted((i or -1, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    shards = {}
    for r in got:
        shards.setdefault(r.shard, []).append((r.slot, r.cell))
    assert set(shards) == set(range(24)) and max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    cells = []
    for k in range(24):
        part = sorted(shards[k])
        assert [s for s, _ in part] == list(range(len(part)))
        cells += [c for _, c in part]
    # Rows follow the curve, and a cell is one run.
    runs = [c for c, _ in itertools.groupby(cells)]
    assert len(runs) == len(set(runs))
    assert hilbert_shards.hilbert_shards(df.limit(0)).count() == 0
    few = hilbert_shards.hilbert_shards(df.limit(3)).collect()
    assert len(few) == 3 and {r.slot for r in few} == {0}


def test_names_are_told_apart_whole(spark):
    names = [f"https://site-{i % 16:02d}.example" if i % 3 else None for i in range(480)]
    df = spark.createDataFrame([(n,) for n in names], "source string")
    cuts = [i / 8 for i in range(1, 8)]
    ordered = sorted(names, key=lambda n: (n is not None, n))
    want = sorted({ordered[-(-len(names) * i // 8) - 1] for i in range(1, 8)} - {None})
    for chunk_rows in (2, 1000):
        assert hilbert_shards.name_edges(df, cuts, chunk_rows) == want
    assert hilbert_shards.name_edges(df.limit(0), cuts) == []
    rows = spark.createDataFrame([(i, "same", n) for i, n in enumerate(names)], "doc_id long, text string, source string")
    placed = hilbert_shards.hilbert_shards(rows, name_cols=["source"]).join(rows, "doc_id")
    assert placed.filter("source is not null").agg(F.countDistinct("cell")).first()[0] > 8 * 4


@pytest.mark.parametrize(("cell_rows", "block_rows"), [(512, 1024), (12, 5)])
def test_vectors(spark, cell_rows, block_rows):
    rng = np.random.default_rng(10)
    center = rng.normal(size=8)
    rows = [(i, [float(x) for x in (center + rng.normal(size=8) * 0.12 if i % 3 else rng.normal(size=8))], i % 2) for i in range(160)]
    rows += [(200, rows[1][1], 1), (201, rows[1][1], 1), (202, rows[1][1], 0), (203, rows[1][1], None), (204, None, 1), (205, [0.0] * 8, 1), (206, [float("nan")] + [1.0] * 7, 1)]
    rows += [(207, [None] + [1.0] * 7, 1), (208, [float("inf")] + [1.0] * 7, 1), (209, [], 1), (210, [1.0], 1), (211, [2.0], 1), (1, rows[1][1], 1), (None, rows[1][1], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicate_vectors(df, cell_rows=cell_rows, block_rows=block_rows).collect()}
    good = {i: (np.array(v, float), y) for i, v, y in rows if i is not None and v and y is not None and None not in v and np.isfinite(v).all() and any(v)}
    links = [
        (a, b)
        for a, b in itertools.combinations(sorted(good), 2)
        if good[a][1] == good[b][1] and len(good[a][0]) == len(good[b][0]) and good[a][0] @ good[b][0] / np.linalg.norm(good[a][0]) / np.linalg.norm(good[b][0]) >= 0.98
    ]
    comp = groups({i for i, *_ in rows if i is not None}, links)
    want = {(i, sum(i in p for p in links), comp[i], comp[i] == i) for i in comp} | {(None, 0, None, True)}
    assert got == want and len(links) > 100


def test_cells_follow_the_size_of_a_label(spark, monkeypatch):
    """Cells are split again while they are large, over small samples and several tasks a cell."""
    for name, value in {"FAN_OUT": 4, "SAMPLE_ROWS": 200, "SALT_ROWS": 70}.items():
        monkeypatch.setattr(embedding_dedup, name, value)
    rng = np.random.default_rng(4)
    heads = rng.normal(size=(60, 6))
    x = [heads[i % 60] + rng.normal(size=6) * 0.08 for i in range(900)]
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    u = np.stack(x) / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.98
    np.fill_diagonal(near, False)
    comp = groups(range(900), list(zip(*np.nonzero(near))))
    got = {(r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.near_duplicate_vectors(df, cell_rows=20, block_rows=16).collect()}
    assert got == {(i, int(near[i].sum()), comp[i]) for i in range(900)}
    units = spark.createDataFrame([("6:0", "", i, 1, v.tobytes()) for i, v in enumerate(u)], "part string, path string, id long, w long, x binary")
    cells = embedding_dedup._cells(units, 0.1, 20).groupBy("path").agg(F.count("id").alias("n")).collect()
    assert max(r.path.count(".") for r in cells) >= 2 and len(cells) > 16


def test_vectors_that_no_split_can_part(spark):
    x = np.ones(8) + np.random.default_rng(5).normal(size=(300, 8)) * 1e-3
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = embedding_dedup.near_duplicate_vectors(df, cell_rows=20, block_rows=64).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(299, 0)}


PAGES = {
    "semantic": ('<html><head><title>T</title><body><nav><a href=/>Home</a></nav><main><article><h1>Great title</h1><p>First para text here, with some words.'
                 "<p>Second &amp; last<br>paragraph &#8212; goes on for a while here.</article><section id=comments><div class=comment><p>I liked this article a lot, thanks.</p></div></section></main>"
                 "<footer>Copyright</footer>", "Great title\n\nFirst para text here, with some words.\n\nSecond & last paragraph — goes on for a while here."),
    "named": ('<div class="cookie-banner">We use cookies.</div><div class="menu"><ul><li><a href=x>Home</a><li><a href=y>About</a></ul></div><div id="content"><h1>Title</h1>'
              "<p>Text one is here for you to read today.</p><p>Text  two\nfollows it.</p></div><div class=sidebar><h3>Popular</h3><p>Another story here.</p></div>"
              "<script>var a='<p>no</p>'</script>", "Title\n\nText one is here for you to read today.\n\nText two follows it."),
    "null": (None, ""),
    "empty": ("", ""),
    "menu": ("<nav><a>Home</a><a>News</a></nav>", ""),
}


def test_main_text(spark):
    df = spark.createDataFrame([(i, k, h) for i, (k, (h, _)) in enumerate(PAGES.items())] + [(0, "semantic", PAGES["semantic"][0])], "page_id long, url string, html string")
    got = html_blocks.main_text(df).collect()
    assert len(got) == len(PAGES) + 1
    for r in got:
        assert r.text == PAGES[r.url][1], r.url
    wide = html_blocks.main_text(df, with_blocks=True).filter("page_id = 0").first()
    assert len(wide.blocks) == len(wide.scores) == 6
    assert html_blocks.main_text(df.limit(0)).count() == 0


def test_blocks_survive_broken_markup():
    for page in ("<p>a<p>b", "<div><p>a</div>b", "<ul><li>a<li>b", "<nav>a</nav></div>b", "a<!-- x -->\n\n<br><h2>b", "<table><tr><td>a<td>b", "a < b".replace("a < b", "<p>a</p>b")):
        assert [t for _, t, _ in html_blocks.blocks(page)] == ["a", "b"], page
    assert [t for _, t, _ in html_blocks.blocks("1 < 2 &lt; 3 <b")] == ["1 < 2 < 3 <b"]


def test_unclosed_and_embedded_elements_lose_no_text():
    article = "<article><p>first words</p><p>last words</p></article>"
    for tag in "button object svg select canvas audio video noscript template math".split():
        got = [t for _, t, _ in html_blocks.blocks(f"<header><{tag}>open</header>{article}")]
        assert got == ["open", "first words", "last words"], tag
        got = html_blocks.blocks(f"<article><p>before <{tag}>inside</{tag}> after</p></article>")
        assert " ".join(t for _, t, _ in got) == "before inside after" and got[-1][0] == (("<article",), ("<p",)), tag
    for tag in "script style title iframe textarea".split():
        assert [t for _, t, _ in html_blocks.blocks(f"<p>a</p><{tag}>cut<p>b</p>")] == ["a"], tag
    late, early = (html_blocks.Vectors().page([((("<p",),), text, 0.0)])[0, -5] for text in ("w" * 100 + "7" * 100, "7" * 100 + "w" * 100))
    assert late == early == 0.5


def test_gradient_of_the_network():
    net = html_blocks.BiLstm(5, hidden=3)
    rng = np.random.default_rng(0)
    x, mask, y = html_blocks.padded([rng.normal(size=(n, 5)).astype(np.float32) for n in (4, 2)], [np.array([1, 0, 1, 0]), np.array([0, 1])])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}

    def loss():
        p = 1 / (1 + np.exp(-net.forward(x, mask)[0]))
        return float(-((y * np.log(p) + (1 - y) * np.log(1 - p)) * mask).sum() / mask.sum())

    grads = net.gradient(x, mask, y)
    for k, g in grads.items():
        at = tuple(0 for _ in g.shape)
        kept = net.p[k][at]
        net.p[k][at] = kept + 1e-3
        high = loss()
        net.p[k][at] = kept - 1e-3
        low = loss()
        net.p[k][at] = kept
        assert abs((high - low) / 2e-3 - g[at]) < 2e-3, k


def test_digest_of_ids():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
