"""Learned operators: held-out accuracy, calibration and defined results for odd rows."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import common, crf_language, quality_bayes, queries, toxicity

SF = "/root/testdata/sf0.01"


def labelled(spark, name, column):
    got = queries.QUERIES[name](spark, SF).toPandas()
    return got.merge(spark.read.parquet(f"{SF}/{column[0]}.parquet").select("doc_id", column[1]).toPandas(), on="doc_id")


def test_language_accuracy(spark):
    got = labelled(spark, "op4_crf_language", ("documents", "lang"))
    held = got[got.held_out]
    assert len(held) > 100 and (held.lang_pred == held.lang).mean() > 0.97
    assert got.score.between(0, 1).all() and len(got) == 1000


def test_language_of_odd_rows(spark):
    rows = [(1, "der die das und nicht ist ein eine", "de"), (2, "the and of to in is that it", "en"), (3, None, "en"), (4, "12 34 !!", "de"), (5, "", None), (6, "der und die the das", None)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = crf_language.train(docs, F.lit(True))
    got = {r.doc_id: (r.lang_pred, r.score) for r in crf_language.predict(docs, model, [F.col("doc_id")]).collect()}
    assert (got[1][0], got[2][0]) == ("de", "en") and got[3] == got[4] == got[5] == ("und", 0.0) and got[6][0] == "de"
    none = crf_language.train(docs.limit(0), F.lit(True))
    assert {r.lang_pred for r in crf_language.predict(docs, none, [F.col("doc_id")]).collect()} == {"und"}
    one = crf_language.train(docs.filter("lang = 'en'"), F.lit(True))
    assert {r.lang_pred for r in crf_language.predict(docs.filter("doc_id < 3"), one, [F.col("doc_id")]).collect()} == {"en"}


def test_forward_backward_sums_all_paths():
    rng = np.random.default_rng(0)
    lengths, k = np.array([3, 1, 4]), 3
    scores, moves, start = rng.normal(size=(8, k)), rng.normal(size=(k, k)), rng.normal(size=k)
    posterior, likelihood, pairs = crf_language.forward_backward(scores, lengths, moves, start)
    at, moved = 0, np.zeros((k, k))
    for i, n in enumerate(lengths):
        paths = list(itertools.product(range(k), repeat=int(n)))
        weight = np.array([np.exp(start[p[0]] + sum(scores[at + t, y] for t, y in enumerate(p)) + sum(moves[a, b] for a, b in zip(p, p[1:]))) for p in paths])
        assert np.isclose(likelihood[i], np.log(weight.sum()))
        for t in range(n):
            for y in range(k):
                assert np.isclose(posterior[at + t, y], sum(w for p, w in zip(paths, weight) if p[t] == y) / weight.sum())
        for p, w in zip(paths, weight):
            for a, b in zip(p, p[1:]):
                moved[a, b] += w / weight.sum()
        at += n
    assert np.allclose(pairs, moved)


def test_toxicity_accuracy(spark):
    got = labelled(spark, "op3_toxicity", ("labels", "toxic"))
    rank = got.score.rank()
    toxic = got.toxic == 1
    auc = (rank[toxic].sum() - toxic.sum() * (toxic.sum() + 1) / 2) / (toxic.sum() * (~toxic).sum())
    assert auc > 0.9 and (got.predicted == (got.score >= 0.5)).all()
    assert ((got.predicted == 1) & ~toxic).sum() <= 0.02 * (~toxic).sum()


def test_toxicity_of_odd_rows(spark):
    rows = [(i, "you worthless idiot scum" if i % 2 else "a kind and quiet morning", i % 2) for i in range(200)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, ""), (902, "You 1d10t"), (903, "word " * 50_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(900, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, F.lit(True))
    got = {r.doc_id: r.score for r in toxicity.score(docs, model, [F.col("doc_id")]).collect()}
    assert got[1] > 0.9 and got[2] < 0.1 and all(0 <= s <= 1 for s in got.values())
    empty = toxicity.train(docs, labels.limit(0), F.lit(True))
    assert {r.score for r in toxicity.score(docs, empty, [F.col("doc_id")]).collect()} == {0.0}


def test_isotonic_is_monotone_and_calibrated():
    rng = np.random.default_rng(1)
    s = rng.normal(size=4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-2 * s))).astype(float)
    x, p = toxicity.isotonic(s, y, np.ones(4000))
    assert (np.diff(p) >= 0).all() and (np.diff(x) >= 0).all()
    assert abs(np.interp(0.5, x, p) - 1 / (1 + np.exp(-1))) < 0.1


def test_quality_accuracy(spark):
    got = labelled(spark, "op9_quality_bayes", ("labels", "quality"))
    held = got[got.held_out]
    assert ((held.score >= 0.5) == (held.quality == 1)).mean() > 0.9
    assert (got.kept == (got.score >= 0.5)).all()


def test_sparse_sites_shrink(spark):
    docs = spark.createDataFrame([(i, "same text", "big" if i < 400 else f"small{i}", "p") for i in range(440)] + [(900, None, None, None)], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, int(i % 10 == 0) if i < 400 else i % 2) for i in range(440)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_bayes.quality(docs, labels, F.lit(True), F.col("source"), F.concat_ws("/", "source", "lang")).collect()}
    whole = np.mean([got[i].doc_score for i in range(440)])
    assert abs(got[0].host_score - 0.1) < 0.05
    # One document moves its site from the whole's mean, not to its own label.
    assert 0 < abs(got[401].host_score - whole) < abs(1 - whole)
    assert len(got) == 441 and got[900].score is not None
    assert quality_bayes.quality(docs.limit(0), labels.limit(0), F.lit(True), F.col("source"), F.col("lang")).count() == 0


def test_strength():
    assert quality_bayes.strength(0.5, 10, 1000.0, 100_000.0, 2.0) == 1e4
    assert quality_bayes.strength(0.5, 10, 1000.0, 100_000.0, 200.0) < 2


def test_shared_folder_is_the_named_one():
    class Conf:
        def __init__(self, named):
            self.named = named

        def get(self, key, default):
            assert key == "spark.checkpoint.dir"
            return self.named or default

    session = lambda named: type("Session", (), {"conf": Conf(named)})()
    assert common.shared_root(session("hdfs://x/y/")) == "hdfs://x/y"
    assert common.shared_root(session(None)) == common.shared_root(session(None))
