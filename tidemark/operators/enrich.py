"""Enrichment of fetched text: a pluggable model and a deterministic default."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark import schemas

# A model takes a batch of request rows and returns one JSON text per row.
Model = Callable[[pd.DataFrame], list[str | None]]


def keyword_tags(rows: DataFrame, key: str, text: str, top: int = 5, min_length: int = 5) -> DataFrame:
    """Default tags: the words used most often in a text, ties by the word.

    Words are counted per (row, word) with a partial aggregation; the ranking keeps
    only `top` words before its exchange.
    """
    words = rows.select(key, F.explode(F.split(F.lower(text), r"[^\p{L}\p{N}]+")).alias("word")).filter(
        F.length("word") >= min_length
    )
    counts = words.groupBy(key, "word").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(key).orderBy(F.desc("n"), "word")
    best = counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
    # At most `top` words per row are collected.
    picked = best.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "word"))).alias("b"))
    return picked.select(key, F.transform("b", lambda x: x["word"]).alias("tags"))


def enrich_default(work: DataFrame, key: str = "subject_id") -> DataFrame:
    """Tags, summaries and language without a model.

    The long summary is the longest line of the text and the short one its shortest line,
    blank lines aside; of equally long lines the first in the alphabet.
    """
    lines = F.filter(F.transform(F.split("text_content", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    sized = F.transform(lines, lambda x: F.struct(F.length(x).alias("n"), x.alias("line")))
    longest = F.array_min(F.transform(lines, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("line"))))["line"]
    tags = keyword_tags(work, key, "text_content")
    return work.join(tags, key, "left").select(
        *[c for c in work.columns if c not in ("text_content", "title", "lang")],
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
        F.array_min(sized)["line"].alias("summary_short"),
        longest.alias("summary_long"),
        F.col("lang").alias("language"),
        F.lit("keywords").alias("model_version"),
    )


def run_model(requests: DataFrame, model: Model, version: str) -> tuple[DataFrame, DataFrame]:
    """(enriched, failed) rows of a model applied batch by batch.

    A response that is no valid JSON object, or an error the model raises for a row,
    turns into a failed row with its reason. After an error in a batch its rows are asked
    one by one, so which rows fail does not depend on the size of a batch.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema)

    def apply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            try:
                answers, errors = model(frame), [None] * len(frame)
            except Exception:  # the rows are asked one by one, so only those at fault fail
                answers, errors = [], []
                for i in range(len(frame)):
                    try:
                        answer, error = model(frame.iloc[i : i + 1])[0], None
                    except Exception as exc:
                        answer, error = None, str(exc) or type(exc).__name__
                    answers.append(answer)
                    errors.append(error)
            yield frame.assign(_response=answers, _error=errors)

    answered = requests.mapInPandas(apply, schema + ", _response string, _error string")
    parsed = answered.withColumn("r", F.from_json("_response", schemas.ENRICHMENT_RESPONSE)).withColumn(
        "_bad", F.col("r.tags").isNull()
    )
    keep = requests.columns
    enriched = parsed.filter(~F.col("_bad")).select(*keep, "r.*", F.lit(version).alias("model_version"))
    failed = parsed.filter(F.col("_bad")).select(
        *keep, F.coalesce("_error", F.when(F.col("_response").isNull(), "Empty response").otherwise("Invalid response")).alias("error")
    )
    return enriched, failed


def constant_model(tags: list[str]) -> Model:
    """Tiny stand-in used by tests."""
    answer = json.dumps({"tags": tags, "summary_short": "s", "summary_long": "l", "language": "en"})
    return lambda frame: [answer] * len(frame)
