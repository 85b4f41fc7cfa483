"""Tag catalog and compacted topics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions.payload import tag_prompt_list
from tidemark.operators.skew import skew_join


def compact(records: DataFrame, keys: Sequence[str], value: str = "value", order: str = "ord") -> DataFrame:
    """Latest value per key; a NULL value is a tombstone and removes the key."""
    return (
        records.groupBy(*keys)
        .agg(F.max_by(F.struct(F.col(value).alias("v"), F.col(order).alias("o")), order).alias("r"))
        .filter(F.col("r.v").isNotNull())
        .select(*keys, F.col("r.v").alias(value), F.col("r.o").alias(order))
    )


def tag_catalog(enrichments: DataFrame) -> DataFrame:
    """Known tags with their first position: one row per tag, `enrichments` has ord and tags."""
    return (
        enrichments.select("ord", F.posexplode("tags").alias("pos", "tag"))
        .groupBy("tag")
        .agg(F.min(F.struct("ord", "pos")).alias("f"), F.count(F.lit(1)).alias("uses"))
        .select("tag", F.col("f.ord").alias("first_ord"), F.col("f.pos").alias("first_pos"), "uses")
    )


def prompt_tags(catalog: DataFrame, limit: int = schemas.MAX_TAGS_IN_PROMPT) -> DataFrame:
    """The one-row list of the first known tags; at most `limit` tags by definition."""
    first = catalog.orderBy("first_ord", "first_pos").limit(limit)
    ordered = F.array_sort(F.collect_list(F.struct("first_ord", "first_pos", "tag")))
    return first.agg(F.transform(ordered, lambda t: t["tag"]).alias("known"))


def unknown_tags(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """Tags of new rows that the catalog lacks: (key columns..., tag), one row each."""
    keys = [c for c in rows.columns if c != "tags"]
    tagged = rows.select(*keys, F.explode(F.array_distinct("tags")).alias("tag"))
    return skew_join(tagged, catalog.select("tag"), ["tag"], "left_anti", salt_by=keys[0]).select(*keys, "tag")


def with_prompt_tags(work: DataFrame, catalog: DataFrame, limit: int = schemas.MAX_TAGS_IN_PROMPT) -> DataFrame:
    """Work rows with the catalog's prompt list, a scalar of at most `limit` tags, and the
    number of known tags that the prompt leaves out."""
    known = F.coalesce(prompt_tags(catalog, limit).scalar(), F.array().cast("array<string>"))
    total = catalog.agg(F.count(F.lit(1))).scalar()
    return work.withColumn("known", known).withColumn("n_left_out", total - F.size("known"))


def enrichment_requests(
    work: DataFrame, catalog: DataFrame, max_chars: int = schemas.MAX_CONTENT_CHARS, max_tags: int = schemas.MAX_TAGS_IN_PROMPT
) -> DataFrame:
    """Model input: title, the known tags as text, and the text in numbered parts.

    A text longer than `max_chars` gives one request per part (`part` of `n_parts`), so
    the model sees all of it; `merge_answers` joins the answers.
    """
    n_parts = F.ceil(F.length("text_content") / F.lit(max_chars)).cast("int")
    return (
        with_prompt_tags(work.filter(F.coalesce(F.col("text_content") != "", F.lit(False))), catalog, max_tags)
        .withColumn("tag_list", tag_prompt_list("known", max_tags))
        .withColumn("n_parts", n_parts)
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)))
        .withColumn("content", F.substring(F.col("text_content"), F.col("part") * max_chars + 1, F.lit(max_chars)))
        .drop("known", "text_content")
    )


def merge_answers(enriched: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per text from the answers to its parts: all tags, in order of part and place,
    and the other fields of the first part that has them. An answer is a short list, and a
    text has few parts, so the collected tags stay small."""
    first = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("part"))).alias(c) for c in ("summary_short", "summary_long", "language", "model_version")]
    ordered = F.array_sort(F.collect_list(F.struct("part", "tags")))
    tags = F.array_distinct(F.flatten(F.transform(ordered, lambda x: x["tags"])))
    return enriched.groupBy(*keys).agg(tags.alias("tags"), F.count(F.lit(1)).cast("int").alias("n_answers"), *first)


def tag_quality(rows: DataFrame) -> DataFrame:
    """Rows with their number of tags, of well-formed tags, and whether both rules hold."""
    good = F.size(F.filter("tags", lambda t: F.regexp_like(t, F.lit("^[a-z0-9]+(-[a-z0-9]+)*$"))))
    return (
        rows.withColumn("n_tags", F.size("tags"))
        .withColumn("n_valid", good)
        .withColumn("ok", (F.col("n_tags") == F.col("n_valid")) & F.col("n_tags").between(3, 7))
    )
