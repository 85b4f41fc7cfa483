"""Registered queries against their SQL, and the pipeline stage by stage."""

import glob
import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
import corpus_pipeline
from tests.llm.test_operators import brute_hits, brute_passages, groups, shingles
from tidemark.llm import queries

SF = "/root/testdata/sf0.001"


def test_registered():
    numbers = [int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES]
    assert sorted(numbers) == list(range(1, 14))
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry_module.queries())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "passages", "benchmark", "packing"]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = queries.QUERIES[name](spark, SF)
    cur = con.execute(queries.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(map(repr, cur.fetchall()))
    assert sorted(repr(tuple(r[c] for c in names)) for r in df.collect()) == want and want


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    blank = spark.createDataFrame([(10_001, None, "en", "s", 0), (10_002, "123 !!", "en", "s", 7), (None, "the and of to in is", "en", None, 19)], docs.schema)
    docs = docs.unionAll(blank)
    rows = lambda df: [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    stages = dict(corpus_pipeline.STAGES)

    def run(name, df):
        out = corpus_pipeline.common.stored(stages[name](spark, df, SF), name)
        if name != "packing":
            assert out.schema == docs.schema or out.columns == docs.columns
        return out

    a = run("language", docs)
    kept = {i for i, _ in rows(a)}
    assert not {10_001, 10_002} & kept and len(kept) >= 0.98 * docs.count() - 3

    b = run("near_duplicates", a)
    sets = [(i, shingles(t)) for i, t in rows(a) if i is not None]
    links = [(x, y) for n, (x, s) in enumerate(sets) for y, u in sets[:n] if s and u and 100 * len(s & u) >= 75 * len(s | u)]
    comp = groups({i for i, _ in sets}, links)
    assert {i for i, _ in rows(b)} == {i for i, c in comp.items() if i == c} | {None}

    c = run("passages", b)
    before, after = dict(rows(b)), dict(rows(c))
    assert not brute_passages([(i, t, "", 0) for i, t in after.items()])[1]
    later = brute_passages([(i, t, "", 0) for i, t in before.items()])[1]
    assert all(after[i] == t for i, t in before.items() if i not in later and i in after and len(after[i]) == len(t))
    assert {r.n for r in c.select((F.col("n_chars") - F.length("text")).alias("n")).collect()} == {0}

    d = run("benchmark", c)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = set()
    for i, t in after.items():
        n, hit, _ = brute_hits(t, items)
        if i is None or not (hit and 20 * hit >= n):
            clean.add(i)
    assert {i for i, _ in rows(d)} == clean

    e = run("packing", d)
    assert {r.doc_id for r in e.select("doc_id").distinct().collect()} == clean
    assert e.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0


def test_language_keeps_mixed_and_short_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    some = {r.lang: r.text.split()[:30] for r in docs.filter("length(text) > 400").orderBy(F.desc("doc_id")).collect()}
    langs = sorted(some)
    texts = [" ".join(w for lang in (a, b, c) for w in some[lang]) for a, b, c in zip(langs, langs[1:] + langs[:1], langs[2:] + langs[:2])]
    texts += [" ".join(some[a] + some[b]) for a, b in zip(langs, langs[1:])] + [w for lang in langs for w in some[lang] if w.isalpha()]
    mixed = spark.createDataFrame([(20_000 + i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(10_001, "12 !!", "en", "s", 5), (10_002, None, "en", "s", 0)], docs.schema)
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["language"](spark, docs.unionAll(mixed), SF).select("doc_id").collect()}
    assert len(langs) >= 3 and {20_000 + i for i in range(len(texts))} <= kept and not {10_001, 10_002} & kept
    letters = {r.doc_id for r in docs.filter(F.col("text").rlike("\\p{L}")).select("doc_id").collect()}
    assert letters <= kept


def test_pipeline_of_an_empty_table(spark, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
