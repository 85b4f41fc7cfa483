"""Clashing column names in every stage and operator, very long texts, and sampling of huge tables."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import common, crf_language, minhash_dedup, passage_dedup, phrase_index, quality_bayes, toxicity

SF = "/root/testdata/sf0.001"
CLASH = ("score", "lang_pred", "_id", "_cut", "_text", "id", "fp", "n", "length", "bands", "segment", "chunk", "k", "Score")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 60")


def test_stages_keep_clashing_columns(spark, docs):
    clashed = docs.withColumns({c: F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")) for c in CLASH if c != "Score"})
    for name, stage in corpus_pipeline.STAGES:
        plain, extra = (common.stored(stage(spark, d, SF), name) for d in (docs, clashed))
        if name == "packing":
            assert extra.count() == plain.count()
            continue
        assert extra.columns == clashed.columns
        assert {tuple(r) for r in extra.select(docs.columns).collect()} == {tuple(r) for r in plain.collect()}
        assert extra.filter(" OR ".join(f"`{c}` <> '{c}:' || doc_id" for c in CLASH if c != "Score")).count() == 0


def test_operators_beside_clashing_columns(spark, docs):
    clashed = docs.withColumns({c: F.lit(1) for c in CLASH if c != "Score"})
    model = crf_language.train(clashed, F.lit(True))
    a = crf_language.predict(docs, model, [F.col("doc_id")]).collect()
    b = crf_language.predict(clashed, model, [F.col("doc_id"), F.col("score"), F.col("lang_pred"), F.col("_text")]).collect()
    assert {(r.doc_id, r.lang_pred, r.score) for r in a} == {(r.doc_id, r["lang_pred_"], r["score_"]) for r in b} and {r.score for r in b} == {1}
    labels = spark.read.parquet(f"{SF}/labels.parquet").withColumns({c: F.lit(2) for c in ("id", "y", "n", "half")})
    scorer = toxicity.train(clashed, labels, F.lit(True))
    a, b = toxicity.score(docs, scorer, [F.col("doc_id")]).collect(), toxicity.score(clashed, scorer, [F.col("doc_id"), F.col("Score")]).collect()
    assert sorted(map(tuple, a)) == sorted((r[0], r[2]) for r in b)
    source = quality_bayes.quality(clashed, labels, F.lit(True), F.col("source"), F.concat_ws("/", "source", "lang"))
    assert source.count() == clashed.count()
    assert phrase_index.decontamination(clashed, spark.read.parquet(f"{SF}/benchmark.parquet").withColumns({"n": F.lit(1), "doc_id": F.lit(2)})).count() == clashed.count()


def test_empty_documents(spark, docs):
    none = docs.limit(0)
    labels, items = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("labels", "benchmark"))
    assert crf_language.predict(none, crf_language.train(none, F.lit(True)), [F.col("doc_id")]).count() == 0
    assert toxicity.score(none, toxicity.train(docs, labels.limit(0), F.lit(True)), [F.col("doc_id")]).count() == 0
    assert phrase_index.decontamination(none, items).count() == 0
    assert {(r.n_hit, r.contaminated) for r in phrase_index.decontamination(docs, items.limit(0)).collect()} == {(0, False)}


def test_very_long_texts(spark, docs):
    """Texts of more words than a root of a tree holds: copies, near copies and a shared passage."""
    rng = random.Random(2)
    words = [f"w{rng.randrange(5000)}" for _ in range(70_000)]
    near = [w if rng.random() > 0.01 else "x" for w in words]
    other = [f"v{rng.randrange(5000)}" for _ in range(40_000)]
    other[39_000:39_100] = words[69_000:69_100]
    rows = [(1, " ".join(words)), (2, " ".join(words)), (3, " ".join(near)), (4, " ".join(other)), (5, "y" * 300_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(df).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}
    held = {}
    for r in passage_dedup.repeated_passages(df).filter("not is_first").collect():
        held.setdefault(r.doc_id, set()).update(range(r.first_word, r.last_word + 1))
    assert held[2] == set(range(70_000)) and set(range(39_000, 39_100)) <= held[4] and len(held[4]) < 250 and len(held[3]) > 60_000 and 5 not in held
    model = crf_language.train(docs, F.lit(True))
    assert crf_language.predict(df, model, [F.col("doc_id")]).count() == 5


def test_samples_of_huge_tables_are_not_empty(spark):
    digests = spark.range(200_000).select(F.xxhash64("id").alias("d"))
    for wanted, rows, low, high in ((600, 200_000, 500, 700), (5, 4, 200_000, 200_000), (1, 10**18, 0, 0)):
        n = digests.filter(common.drawn(F.col("d"), wanted, rows)).count()
        assert low <= n <= high
    # A share far below a millionth is a threshold of its own, not zero.
    assert spark.range(1).filter(common.drawn(F.lit((1 << 63) // 10**9), 600, 7 * 10**8)).count() == 1
    assert spark.range(1).filter(common.drawn(F.lit(0).cast("long"), 1, 1 << 62)).count() == 1
