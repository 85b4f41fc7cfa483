"""Page reads, reports and operator actions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import admin, folds, reads, windows
from tidemark.plans import sqltext as S
from tidemark.plans.ingest import NOW, now
from tidemark.plans.registry import flat, ntz, query
from tidemark.plans.state import TODO_STATE, all_events
from tidemark.plans.tables import link_rows, link_tables, public_stream
from tidemark.sources import adapters

STREAM = f"""{S.AFTER},
stream AS (
  SELECT l.subject_id, l.url, l.created_at, l.source, c.title, coalesce(m.tags, '') AS tags, m.summary_short,
    p.last_published_at AS published_at
  FROM links l LEFT JOIN link_content c USING (subject_id) LEFT JOIN link_metadata m USING (subject_id)
    LEFT JOIN publish_state p USING (subject_id)
  WHERE l.status = 'published' AND l.visibility = 'public')"""


@query("published_stream", f"WITH {STREAM} SELECT * FROM stream")
def published_stream(spark, sf):
    return flat(reads.page_order(public_stream(spark, sf)))


@query("published_stream_folded", f"WITH {STREAM} SELECT * FROM stream")
def published_stream_folded(spark, sf):
    """The same rows from the four stored tables."""
    t = link_tables(spark, sf)
    return flat(reads.published_stream(reads.link_detail(t.links, t.content, t.metadata, t.publish)))


_PAGE_SQL = f"""WITH {STREAM} SELECT subject_id, url, coalesce(nullif(title, ''), url) AS display_title,
  strftime(coalesce(published_at, created_at), '%b %-d, %Y') AS display_date, tags, summary_short, published_at, created_at
FROM stream"""


@query("stream_page", _PAGE_SQL)
def stream_page(spark, sf):
    return flat(reads.page_order(reads.stream_page(public_stream(spark, sf))))


@query(
    "recent_links",
    f"""WITH {S.AFTER}, newest AS (SELECT * FROM links ORDER BY created_at DESC, subject_id LIMIT 10)
    SELECT n.subject_id, url, status, created_at, title, tags
    FROM newest n LEFT JOIN link_content USING (subject_id) LEFT JOIN link_metadata USING (subject_id)""",
)
def recent_links(spark, sf):
    return flat(reads.recent_links(link_rows(spark, sf)))


@query(
    "link_detail",
    f"""WITH {S.AFTER} SELECT l.*, c.* EXCLUDE (subject_id), m.* EXCLUDE (subject_id), p.* EXCLUDE (subject_id)
    FROM links l LEFT JOIN link_content c USING (subject_id) LEFT JOIN link_metadata m USING (subject_id)
      LEFT JOIN publish_state p USING (subject_id)""",
)
def link_detail(spark, sf):
    return flat(link_rows(spark, sf))


_STUCK = f"""{S.AFTER},
stuck AS (
  SELECT l.subject_id, url, status, created_at, coalesce(tags, '') AS tags, summary_short, summary_long, language, model_version
  FROM links l LEFT JOIN link_metadata m USING (subject_id)
  WHERE status = 'enriched' AND NOT EXISTS (
    SELECT 1 FROM life e WHERE e.subject_id = l.subject_id AND e.kind = 'publish.completed'))"""


@query("stuck_links", f"WITH {_STUCK} SELECT * FROM stuck")
def stuck_links(spark, sf):
    return flat(reads.stuck_links(link_rows(spark, sf), adapters.lifecycle_events(spark, sf)))


@query(
    "recovery_events",
    f"""WITH {_STUCK} SELECT subject_id, 'enrichment.completed' AS event_type, 'admin:recovery' AS source,
      TIMESTAMP '{NOW}' AS occurred_at, tags, coalesce(model_version, 'recovery') AS model_version FROM stuck""",
)
def recovery_events(spark, sf):
    e = admin.recovery_events(reads.stuck_links(link_rows(spark, sf), adapters.lifecycle_events(spark, sf)), now())
    tags = F.array_join(F.from_json(F.get_json_object("payload", "$.tags"), "array<string>"), ",")
    return e.select(
        "subject_id", "event_type", "source", ntz("occurred_at"), tags.alias("tags"),
        F.get_json_object("payload", "$.model_version").alias("model_version"),
    )


@query("links_by_tag", f"WITH {STREAM} SELECT subject_id, url FROM stream WHERE ',' || tags || ',' LIKE '%,tag-2,%'")
def links_by_tag(spark, sf):
    return reads.links_by_tag(public_stream(spark, sf), "tag-2").select("subject_id", "url")


@query(
    "link_tag_index",
    f"""WITH {STREAM} SELECT DISTINCT tag, subject_id, published_at
    FROM (SELECT subject_id, published_at, unnest(string_split(tags, ',')) AS tag FROM stream) WHERE tag <> ''""",
)
def link_tag_index(spark, sf):
    return flat(reads.tag_index(public_stream(spark, sf)))


@query(
    "latest_enriched",
    f"""WITH {S.AFTER} SELECT subject_id, tags, updated_at FROM link_metadata ORDER BY updated_at DESC, subject_id LIMIT 20""",
)
def latest_enriched(spark, sf):
    m = folds.link_metadata(folds.link_partials(adapters.lifecycle_events(spark, sf)))
    return flat(m.select("subject_id", "tags", "updated_at").orderBy(F.desc("updated_at"), "subject_id").limit(20))


@query(
    "ingest_health",
    """SELECT 'unpublished' AS section, 'events' AS item, CAST(count(*) AS VARCHAR) AS value FROM events WHERE event_id % 10 >= 7
    UNION ALL SELECT 'offset', 'events.raw/' || (user_id % 3), CAST(event_id AS VARCHAR)
      FROM (SELECT * FROM events ORDER BY event_id DESC LIMIT 5)
    UNION ALL SELECT 'event', 'ev-' || event_id, CASE event_type WHEN 'signup' THEN 'link.added' WHEN 'view' THEN 'content.fetched'
      WHEN 'error' THEN 'content.fetched' WHEN 'click' THEN 'enrichment.completed' ELSE 'publish.completed' END
      FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 5)""",
)
def ingest_health(spark, sf):
    return reads.ingest_health(adapters.lifecycle_events(spark, sf))


@query(
    "retry_candidates",
    f"""WITH {S.AFTER} SELECT subject_id, url, retry_count, last_error_at, last_error FROM links
    WHERE status = 'error' AND retry_count < 3""",
)
def retry_candidates(spark, sf):
    rows = admin.retry_candidates(link_tables(spark, sf).links)
    return flat(rows.select("subject_id", "url", "retry_count", "last_error_at", "last_error"))


@query(
    "retry_candidates_first",
    f"""WITH {S.AFTER} SELECT subject_id, last_error_at FROM links WHERE status = 'error' AND retry_count < 3
    ORDER BY last_error_at NULLS FIRST, subject_id LIMIT 7""",
)
def retry_candidates_first(spark, sf):
    return flat(admin.retry_candidates(link_tables(spark, sf).links, limit=7).select("subject_id", "last_error_at"))


@query(
    "retry_events",
    f"""WITH {S.AFTER} SELECT subject_id, 'link.added' AS event_type, 'retry-script' AS source, url, url_norm,
      'retry' AS payload_source, source AS original_source FROM links WHERE status = 'error' AND retry_count < 3""",
)
def retry_events(spark, sf):
    e = admin.retry_events(admin.retry_candidates(link_tables(spark, sf).links), now())
    return e.select(
        "subject_id", "event_type", "source",
        *[F.get_json_object("payload", f"$.{c}").alias(c) for c in ("url", "url_norm", "original_source")],
        F.get_json_object("payload", "$.source").alias("payload_source"),
    )


@query(
    "retry_reset_state",
    f"""WITH {S.AFTER}, hit AS (SELECT subject_id FROM links WHERE status = 'error' AND retry_count < 3)
    SELECT l.subject_id, CASE WHEN h.subject_id IS NULL THEN status ELSE 'new' END AS status, retry_count,
      c.subject_id IS NOT NULL AND h.subject_id IS NULL AS has_content
    FROM links l LEFT JOIN hit h USING (subject_id) LEFT JOIN link_content c USING (subject_id)""",
)
def retry_reset_state(spark, sf):
    t = link_tables(spark, sf)
    targets = admin.retry_candidates(t.links)
    links, content, _, _ = admin.clean_link(t.links, t.content, t.metadata, t.links, targets)
    have = content.select("subject_id", F.lit(True).alias("has_content"))
    return links.join(have, "subject_id", "left").select(
        "subject_id", "status", "retry_count", F.coalesce("has_content", F.lit(False)).alias("has_content")
    )


@query(
    "exhausted_links",
    f"""WITH {S.AFTER} SELECT subject_id, url, retry_count FROM links WHERE status = 'error' AND retry_count >= 3
    ORDER BY retry_count DESC, subject_id LIMIT 10""",
)
def exhausted_links(spark, sf):
    return admin.exhausted_links(link_tables(spark, sf).links)


_VIS_LINKS = f"""{S.LIFE},
vis AS (
  SELECT subject_id, max_by(v, o) AS v FROM (
    SELECT 'link:' || (user_id * 10 + k % 10) AS subject_id, event_id * 2 + 1 AS o,
      CASE WHEN k % 5 = 0 THEN 'private' ELSE 'public' END AS v
    FROM base WHERE event_type = 'purchase' AND k % 5 <> 1) c
  WHERE EXISTS (SELECT 1 FROM life a WHERE a.kind = 'link.added' AND a.subject_id = c.subject_id AND c.o > a.ord * 2)
  GROUP BY subject_id),
seen AS (SELECT DISTINCT subject_id FROM life WHERE kind = 'link.added')"""


@query(
    "visibility_change_events",
    f"""WITH {_VIS_LINKS} SELECT subject_id, 'admin:set-visibility' AS source, '{{"visibility":"private"}}' AS payload
    FROM seen LEFT JOIN vis USING (subject_id) WHERE coalesce(v, 'public') <> 'private'""",
)
def visibility_change_events(spark, sf):
    t = link_tables(spark, sf, visibility=True)
    return admin.visibility_events(t.links, "private", now()).select("subject_id", "source", "payload")


@query(
    "public_rows",
    f"WITH {_VIS_LINKS} SELECT subject_id FROM seen LEFT JOIN vis USING (subject_id) WHERE coalesce(v, 'public') = 'public'",
)
def public_rows(spark, sf):
    return reads.public_only(link_tables(spark, sf, visibility=True).links).select("subject_id")


@query(
    "clean_link_full",
    f"""WITH {S.AFTER} SELECT l.subject_id, l.status, c.subject_id IS NOT NULL AS has_content
    FROM links l LEFT JOIN link_content c USING (subject_id) WHERE l.status <> 'error'""",
)
def clean_link_full(spark, sf):
    t = link_tables(spark, sf)
    targets = t.links.filter("status = 'error'")
    links, content, _, _ = admin.clean_link(t.links, t.content, t.metadata, t.links, targets, full=True)
    have = content.select("subject_id", F.lit(True).alias("has_content"))
    return links.join(have, "subject_id", "left").select(
        "subject_id", "status", F.coalesce("has_content", F.lit(False)).alias("has_content")
    )


_SEARCHES = ("link:17", "https://site3.example.com/4", "site5.example", "final.example.com/12", "nowhere")


@query(
    "link_lookup",
    f"""WITH {S.AFTER}, s AS (SELECT unnest(['link:17', 'https://site3.example.com/4', 'site5.example', 'final.example.com/12', 'nowhere']) AS search),
    u AS (SELECT l.subject_id, url, url_norm, final_url FROM links l LEFT JOIN link_content c USING (subject_id)),
    h AS (SELECT search, subject_id, CASE WHEN search LIKE 'link:%' THEN CASE WHEN subject_id = search THEN 0 END
        WHEN url = search OR contains(url_norm, search) THEN 1 WHEN contains(final_url, search) THEN 2
        WHEN contains(url, search) THEN 3 END AS tier FROM u, s)
    SELECT search, tier, subject_id FROM (
      SELECT *, row_number() OVER (PARTITION BY search ORDER BY tier, subject_id) AS rn FROM h WHERE tier IS NOT NULL)
    WHERE rn = 1""",
)
def link_lookup(spark, sf):
    t = link_tables(spark, sf)
    return reads.link_lookup(_SEARCHES, t.links, t.content)


ITEMS = f"""{S.AFTER}, {S.CALENDAR}, {TODO_STATE},
items AS (
  SELECT 'link' AS domain, subject_id, tags, updated_at AS at_time FROM link_metadata
  UNION ALL SELECT 'calendar', 'gcal:' || event_id, tag, start_at FROM calendar
  UNION ALL SELECT 'note', 'voice:' || conv_id, 'tag-' || (conv_id % 7), TIMESTAMP '2024-01-15' FROM conversations GROUP BY conv_id)"""


def tagged_items(spark, sf):
    meta = folds.link_metadata(folds.link_partials(adapters.lifecycle_events(spark, sf)))
    cal = adapters.calendar(spark, sf)
    notes = adapters.table(spark, sf, "conversations").select("conv_id").distinct()
    links = meta.select(F.lit("link").alias("domain"), "subject_id", "tags", F.col("updated_at").alias("at"))
    meetings = cal.select(
        F.lit("calendar").alias("domain"), F.concat(F.lit("gcal:"), "event_id").alias("subject_id"),
        F.array("tag").alias("tags"), F.col("start_at").alias("at"),
    )
    voice = notes.select(
        F.lit("note").alias("domain"), F.concat(F.lit("voice:"), "conv_id").alias("subject_id"),
        F.array(F.concat(F.lit("tag-"), F.col("conv_id") % 7)).alias("tags"), F.lit("2024-01-15").cast("timestamp").alias("at"),
    )
    return links.unionByName(meetings).unionByName(voice)


@query(
    "cross_domain_by_tag",
    f"WITH {ITEMS} SELECT domain, subject_id FROM items WHERE ',' || tags || ',' LIKE '%,tag-3,%'",
)
def cross_domain_by_tag(spark, sf):
    return reads.links_by_tag(tagged_items(spark, sf), "tag-3").select("domain", "subject_id")


@query(
    "related_by_tag",
    f"""WITH {ITEMS},
    t AS (SELECT DISTINCT domain, subject_id, tag FROM (SELECT domain, subject_id, unnest(string_split(tags, ',')) AS tag FROM items)
      WHERE tag <> ''),
    w AS (SELECT domain AS other_domain, tag, count(*) AS n FROM t WHERE domain <> 'link' GROUP BY ALL)
    SELECT subject_id, other_domain, count(*) AS shared_tags, CAST(sum(n) AS BIGINT) AS related
    FROM t JOIN w USING (tag) WHERE domain = 'link' GROUP BY ALL""",
)
def related_by_tag(spark, sf):
    items = tagged_items(spark, sf)
    return reads.shared_tag_weight(items.filter("domain = 'link'"), items.filter("domain <> 'link'"))


@query(
    "related_items",
    f"""WITH {ITEMS},
    o AS (SELECT domain, subject_id, CAST(len(list_intersect(list_distinct(string_split(tags, ',')), ['tag-1', 'tag-4', 'tag-6'])) AS INTEGER) AS overlap
      FROM items)
    SELECT * FROM o WHERE overlap > 0 ORDER BY overlap DESC, domain, subject_id LIMIT 10""",
)
def related_items(spark, sf):
    return reads.related_items(tagged_items(spark, sf), ["tag-1", "tag-4", "tag-6"]).select("domain", "subject_id", "overlap")


@query(
    "surface_relevant",
    f"""WITH {ITEMS},
    o AS (SELECT subject_id, domain, len(list_intersect(list_distinct(string_split(tags, ',')), ['tag-1', 'tag-2']))
        * pow(0.5, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(at_time)) / 86400000000.0 / 7.0) AS score FROM items)
    SELECT subject_id, domain, round(score, 6) AS score FROM o WHERE score > 0 ORDER BY o.score DESC, subject_id LIMIT 10""",
)
def surface_relevant(spark, sf):
    rows = reads.surface_relevant(tagged_items(spark, sf), ["tag-1", "tag-2"], now())
    return rows.select("subject_id", "domain", F.round("score", 6).alias("score"))


@query(
    "retention_rollup",
    f"""WITH {S.SENSOR}, s AS (SELECT * FROM sensor WHERE celsius IS NOT NULL)
    SELECT 'raw' AS kind, subject_id, occurred_at AS at_time, CAST(1 AS BIGINT) AS n, round(celsius, 6) AS mean FROM s
      WHERE occurred_at >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY
    UNION ALL
    SELECT 'hour', subject_id, date_trunc('hour', occurred_at), count(*), round(avg(celsius), 6) FROM s
      WHERE occurred_at < TIMESTAMP '{NOW}' - INTERVAL 7 DAY GROUP BY subject_id, date_trunc('hour', occurred_at)""",
)
def retention_rollup(spark, sf):
    r = folds.temperature_readings(adapters.sensor_events(spark, sf))
    raw, hourly = windows.raw_or_rollup(r, now(), 7, "subject_id", "occurred_at", "celsius")
    a = raw.select(F.lit("raw").alias("kind"), "subject_id", ntz("occurred_at", "at_time"), F.lit(1).cast("bigint").alias("n"),
                   F.round("celsius", 6).alias("mean"))
    b = hourly.select(F.lit("hour").alias("kind"), "subject_id", ntz("hour", "at_time"), "n", F.round("mean", 6).alias("mean"))
    return a.unionByName(b)


@query(
    "recent_events",
    f"""WITH {S.LIFE} SELECT id, kind AS event_type, ts AS received_at FROM life WHERE subject_id = 'link:17'
    ORDER BY ts DESC LIMIT 10""",
)
def recent_events(spark, sf):
    rows = reads.recent_events(adapters.lifecycle_events(spark, sf), "link:17")
    return flat(rows.select("id", "event_type", "received_at"))


@query(
    "recent_per_subject",
    f"""WITH {S.LIFE}, r AS (SELECT id, subject_id, CAST(row_number() OVER (PARTITION BY subject_id ORDER BY ts DESC) AS INTEGER) AS rank FROM life)
    SELECT * FROM r WHERE rank <= 10""",
)
def recent_per_subject(spark, sf):
    return reads.recent_per_subject(adapters.lifecycle_events(spark, sf)).select("id", "subject_id", "rank")


@query("feed", f"WITH {S.POSTS} SELECT title, date AS pub_date, '/posts/' || slug || '/' AS link FROM posts WHERE status = 'published'")
def feed(spark, sf):
    return reads.feed(adapters.posts(spark, sf))


@query(
    "posts_by_tag",
    f"""WITH {S.POSTS} SELECT slug, date FROM posts WHERE status = 'published' AND list_contains(tags, 'kind-2')""",
)
def posts_by_tag(spark, sf):
    live = adapters.posts(spark, sf).filter("status = 'published'")
    return reads.links_by_tag(live, "kind-2").select("slug", "date").orderBy(F.desc("date"), "slug")
