"""Relational reads over the state tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.payload import display_date, display_title
from tidemark.operators.skew import skew_join


def _tags() -> Column:
    return F.coalesce("tags", F.array().cast("array<string>")).alias("tags")


def published_stream(rows: DataFrame) -> DataFrame:
    """Public published links with their content, metadata and publication time.

    `rows` has every column of a link: `folds.link_rows` of one fold, or `link_detail` of
    stored tables.
    """
    return rows.filter((F.col("status") == "published") & (F.col("visibility") == "public")).select(
        "subject_id", "url", "created_at", "source", "title", _tags(), "summary_short", F.col("last_published_at").alias("published_at")
    )


def page_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.desc_nulls_last("published_at"), F.desc("created_at"), "subject_id")


def stream_page(stream: DataFrame) -> DataFrame:
    """The stream with the labels the page shows."""
    return stream.select(
        "subject_id",
        "url",
        display_title("title", "url").alias("display_title"),
        display_date("published_at", "created_at").alias("display_date"),
        "tags",
        "summary_short",
        "published_at",
        "created_at",
    )


def recent_links(rows: DataFrame, n: int = 10) -> DataFrame:
    """Newest links (top-k, no full sort)."""
    return rows.select("subject_id", "url", "status", "created_at", "title", "tags").orderBy(F.desc("created_at"), "subject_id").limit(n)


def link_detail(links: DataFrame, content: DataFrame, metadata: DataFrame, publish: DataFrame) -> DataFrame:
    """Everything known about each link from its stored tables, as `folds.link_rows` gives
    it from a fold; filter by subject_id for one."""
    return (
        links.join(content, "subject_id", "left").join(metadata, "subject_id", "left").join(publish, "subject_id", "left")
    )


def stuck_links(rows: DataFrame, events: DataFrame) -> DataFrame:
    """Enriched links for which no publish.completed event exists."""
    done = events.filter(F.col("event_type") == "publish.completed").select("subject_id").distinct()
    return (
        rows.filter(F.col("status") == "enriched")
        .select("subject_id", "url", "status", "created_at", _tags(), "summary_short", "summary_long", "language", "model_version")
        .join(done, "subject_id", "left_anti")
    )


def with_parent(children: DataFrame, links: DataFrame, key: str = "subject_id", salt_by: str | None = None) -> DataFrame:
    """Child rows whose link exists. Children that are many to one link, such as
    annotations, name the column that tells them apart in `salt_by`."""
    parents = links.select(F.col("subject_id").alias(key)).distinct()
    if salt_by is None:
        return children.join(parents, key, "left_semi")
    return skew_join(children, parents, [key], "left_semi", salt_by=salt_by)


def public_only(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("visibility") == "public")


def public_children(children: DataFrame, links: DataFrame, key: str = "subject_id", salt_by: str | None = None) -> DataFrame:
    """Child rows whose link is public."""
    return with_parent(children, public_only(links), key, salt_by)


def causation_edges(events: DataFrame) -> DataFrame:
    """Each event with the event that caused it. Ids are unique, but one event may
    have caused a large part of the ledger, so the children are salted."""
    parent = events.select(
        F.col("id").alias("causation_id"), F.col("event_type").alias("parent_type"), F.col("occurred_at").alias("parent_at")
    )
    children = events.filter(F.col("causation_id").isNotNull()).select("id", "event_type", "occurred_at", "causation_id")
    return skew_join(children, parent, ["causation_id"], salt_by="id")


def links_by_tag(stream: DataFrame, tag: str) -> DataFrame:
    return stream.filter(F.array_contains("tags", tag))


def tag_index(stream: DataFrame) -> DataFrame:
    """(tag, subject) rows; store it partitioned by a hash of both for tag pages."""
    return stream.select(F.explode(F.array_distinct("tags")).alias("tag"), "subject_id", "published_at")


def tag_counts(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def feed(posts: DataFrame) -> DataFrame:
    """Published posts as feed items, newest first."""
    return (
        posts.filter(F.col("status") == "published")
        .select("title", F.col("date").alias("pub_date"), F.concat(F.lit("/posts/"), "slug", F.lit("/")).alias("link"))
        .orderBy(F.desc("pub_date"), "link")
    )


def recent_per_subject(events: DataFrame, n: int = 10) -> DataFrame:
    """The n newest events of every subject; the rank limit is applied before the exchange."""
    w = Window.partitionBy("subject_id").orderBy(F.desc("received_at"), F.desc("ord"))
    return events.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def recent_events(events: DataFrame, subject_id: str, n: int = 10) -> DataFrame:
    return events.filter(F.col("subject_id") == subject_id).orderBy(F.desc("received_at"), F.desc("ord")).limit(n)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, frame in tables.items():
        row = frame.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def ingest_health(events: DataFrame, recent: int = 5) -> DataFrame:
    """Unpublished count, greatest offsets and newest events as (section, item, value) rows."""
    unpublished = events.filter(~F.col("published_to_kafka")).agg(F.count(F.lit(1)).cast("string").alias("value"))
    offsets = events.orderBy(F.desc("kafka_offset")).limit(recent).select(
        F.lit("offset").alias("section"), F.concat_ws("/", "kafka_topic", "kafka_partition").alias("item"),
        F.col("kafka_offset").cast("string").alias("value"),
    )
    newest = events.orderBy(F.desc("received_at"), F.desc("ord")).limit(recent).select(
        F.lit("event").alias("section"), F.col("id").alias("item"), F.col("event_type").alias("value")
    )
    return (
        unpublished.select(F.lit("unpublished").alias("section"), F.lit("events").alias("item"), "value")
        .unionByName(offsets)
        .unionByName(newest)
    )


def shared_tag_weight(items: DataFrame, others: DataFrame, key: str = "subject_id") -> DataFrame:
    """Per item and other domain: how many taggings of that domain share one of its tags.

    The other side is first counted per (tag, domain), so the join is many-to-one and
    the pairs of a popular tag are never listed.
    """
    weights = (
        others.select("domain", F.explode(F.array_distinct("tags")).alias("tag"))
        .groupBy("tag", "domain")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("tag")
        .agg(F.collect_list(F.struct("domain", "n")).alias("per_domain"))
    )
    tagged = items.select(key, F.explode(F.array_distinct("tags")).alias("tag"))
    return (
        skew_join(tagged, weights, ["tag"], salt_by=key)
        .select(key, "tag", F.explode("per_domain").alias("d"))
        .groupBy(key, F.col("d.domain").alias("other_domain"))
        .agg(F.count(F.lit(1)).alias("shared_tags"), F.sum("d.n").alias("related"))
    )


def related_items(items: DataFrame, tags: Sequence[str], n: int = 10) -> DataFrame:
    """Items of all domains that share tags with one given item: overlap first, top n."""
    probe = F.array(*[F.lit(t) for t in tags])
    return (
        items.withColumn("overlap", F.size(F.array_intersect("tags", probe)))
        .filter(F.col("overlap") > 0)
        .orderBy(F.desc("overlap"), "domain", "subject_id")
        .limit(n)
    )


def surface_relevant(items: DataFrame, recent_topics: Sequence[str], now: Column, half_life_days: float = 7.0, n: int = 10) -> DataFrame:
    """Items ranked by topic overlap, halved for every half life of age; a top-n report."""
    probe = F.array(*[F.lit(t) for t in recent_topics])
    age_days = (F.unix_micros(now) - F.unix_micros("at")) / F.lit(86_400_000_000.0)
    score = F.size(F.array_intersect("tags", probe)) * F.pow(F.lit(0.5), age_days / F.lit(half_life_days))
    return (
        items.withColumn("score", score)
        .filter(F.col("score") > 0)
        .orderBy(F.desc("score"), "subject_id")
        .limit(n)
    )


def link_lookup(searches: Sequence[str], links: DataFrame, content: DataFrame) -> DataFrame:
    """Subject id of each search text: an id itself, then exact URL or partial
    `url_norm`, then final URL, then partial URL; the first tier that hits wins,
    lowest id first.

    Searches are the few texts an operator types, so they are literals that every
    link row is tested against in one scan.
    """
    urls = links.select("subject_id", "url", "url_norm").join(
        content.select("subject_id", "final_url"), "subject_id", "left"
    )

    def tier(search: Column) -> Column:
        return (
            F.when(search.startswith("link:"), F.when(F.col("subject_id") == search, 0))
            .when((F.col("url") == search) | F.contains("url_norm", search), 1)
            .when(F.contains("final_url", search), 2)
            .when(F.contains("url", search), 3)
        )

    tested = F.transform(
        F.array(*[F.lit(t) for t in searches]), lambda t: F.struct(t.alias("search"), tier(t).alias("tier"))
    )
    return (
        urls.select("subject_id", F.explode(F.filter(tested, lambda h: h["tier"].isNotNull())).alias("h"))
        .groupBy("h.search")
        .agg(F.min(F.struct("h.tier", "subject_id")).alias("m"))
        .select("search", "m.tier", "m.subject_id")
    )
