"""A training corpus from raw documents in five stages.

Each stage takes (spark, docs, sf_dir) and returns a frame; the next stage reads it back from
Parquet. All but the last return the columns of documents.

1. language: the word-level random field is fitted on the documents that reach it (labels of the
   `lang` column); only texts without a letter go. A text of several languages stays, however
   small the share of its first language is.
2. near_duplicates: one document of every component of near copies stays, the smallest id.
3. passages: passages of 51 words or more that repeat across documents stay in the document of
   smallest id only; a document that is nothing but such passages goes. `n_chars` follows the text.
4. benchmark: contaminated documents (a twentieth of the words inside benchmark phrases) go.
5. packing: what is left is packed into sequences of 2048 tokens.

Null ids: such rows are never copies or repeats of others and stay. Empty tables pass through.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common
from tidemark.llm.crf_language import predict, train
from tidemark.llm.minhash_dedup import near_duplicates
from tidemark.llm.packing import pack
from tidemark.llm.passage_dedup import repeated_passages, without_repeats
from tidemark.llm.phrase_index import contaminated_rows

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Tables that the last stage stored for itself.
_stored: list[str] = []


def stage(run_stage: Stage) -> Stage:
    """A stage that first removes what the one before it stored for itself: a stage is only
    called with the written result of its predecessor."""

    @functools.wraps(run_stage)
    def wrapped(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        done, _stored[:] = list(_stored), []
        common.remove(spark, done)
        with common.scope(_stored):
            return run_stage(spark, docs, sf_dir)

    return wrapped


@stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.configure(spark)
    judged = predict(docs, train(docs, F.lit(True)), [F.col(c) for c in docs.columns], carry_text=True)
    return judged.filter(F.col(common.free_name("lang_pred", docs.columns)) != "und").select(*docs.columns)


@stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = near_duplicates(docs).filter(~F.col("kept")).select("doc_id").distinct()
    return common.without_ids(docs, common.stored(gone, "copies"), "doc_id")


@stage
def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_repeats(docs, repeated_passages(docs)).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


@stage
def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = contaminated_rows(docs, common.table(spark, sf_dir, "benchmark"))
    return common.without_ids(docs, common.stored(gone, "contaminated"), "doc_id")


@stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("near_duplicates", near_copies),
    ("passages", passages),
    ("benchmark", benchmark),
    ("packing", packing),
]

#: SQL cannot fit the random field or pack; the tests run each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, run_stage in STAGES:
        docs = common.stored(run_stage(spark, docs, sf_dir), name)
    return docs
