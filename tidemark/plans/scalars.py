"""Scalar functions over whole driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import ids, payload, urls
from tidemark.plans import sqltext as S
from tidemark.plans.registry import ntz, query
from tidemark.sources import adapters


@query("normalize_url", f"WITH {S.PAGE} SELECT page_id, url_norm, subject_id FROM page_links")
def normalize_url(spark, sf):
    return adapters.page_links(spark, sf).select("page_id", "url_norm", "subject_id")


@query(
    "normalize_url_drop_tracking",
    """SELECT page_id,
      regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '\\?utm_source=[^&]*$', ''), '(.[^/])/$', '\\1') AS url_norm
    FROM pages""",
)
def normalize_url_drop_tracking(spark, sf):
    return adapters.table(spark, sf, "pages").select(
        "page_id", urls.normalize_url("url", ["utm_source"]).alias("url_norm")
    )


@query(
    "host_forms",
    """WITH r AS (SELECT event_id, (event_id * 2654435761) % 4294967296 AS n, event_id % 5 AS k FROM events),
    d AS (SELECT *, (n >> 24) || '.' || ((n >> 16) & 255) || '.' || ((n >> 8) & 255) || '.' || (n & 255) AS dotted FROM r)
    SELECT event_id, CASE k WHEN 3 THEN 'http://xn--bcher-kva.s' || n || '.de/' WHEN 4 THEN 'http://[2001:db8::' || CASE WHEN n >> 16 = 0 THEN '' ELSE printf('%x', n >> 16) || ':' END || printf('%x', n & 65535) || ']/'
      ELSE 'http://' || dotted || '/' END AS url_norm FROM d""",
)
def host_forms(spark, sf):
    """Addresses written as decimal, hexadecimal and octal numbers, IPv6 with zeros, and an IDN name."""
    n = (F.col("event_id") * 2654435761) % 4294967296
    k = F.col("event_id") % 5
    part = lambda v: F.lpad(F.hex(v), 4, "0")
    six = F.concat(F.lit("[2001:0DB8:0:0:0:0:"), part(F.shiftright(n, 16)), F.lit(":"), part(n % 65536), F.lit("]"))
    host = F.when(k == 0, n.cast("string")).when(k == 1, F.concat(F.lit("0X"), F.hex(n))).when(k == 2, F.concat(F.lit("0"), F.conv(n.cast("string"), 10, 8)))
    host = host.when(k == 3, F.concat(F.lit("BÜCHER.s"), n.cast("string"), F.lit(".de"))).otherwise(six)
    rows = adapters.table(spark, sf, "events").select("event_id", F.concat(F.lit("http://"), host).alias("url"))
    return rows.select("event_id", urls.normalize_url("url").alias("url_norm"))


@query(
    "sha256_short",
    "SELECT doc_id, substr(sha256(text), 1, 16) AS digest FROM documents",
)
def sha256_short(spark, sf):
    return adapters.table(spark, sf, "documents").select("doc_id", ids.sha256_short("text").alias("digest"))


@query(
    "subject_ids",
    """SELECT o_orderkey,
      'sensor:' || regexp_replace(lower(o_orderpriority || '  ' || o_orderstatus), '\\s+', '_', 'g') AS sensor_id,
      'todoist:' || o_orderkey AS todo_id, 'anno:' || o_custkey AS annotation_id,
      'gcal:' || o_custkey || ':' || o_orderkey || ':x' AS calendar_id,
      'gcal' AS parsed_type, o_custkey || ':' || o_orderkey || ':x' AS parsed_id,
      CAST(o_custkey AS VARCHAR) AS parsed_calendar, o_orderkey || ':x' AS parsed_event,
      'unknown' AS bare_type, CAST(o_orderkey AS VARCHAR) AS bare_id
    FROM orders""",
)
def subject_ids(spark, sf):
    key = F.col("o_orderkey").cast("string")
    cal = ids.calendar_subject_id(F.col("o_custkey").cast("string"), F.concat(key, F.lit(":x")))
    return (
        adapters.table(spark, sf, "orders")
        .select(
            "o_orderkey",
            ids.sensor_subject_id(F.concat("o_orderpriority", F.lit("  "), "o_orderstatus")).alias("sensor_id"),
            ids.todo_subject_id(F.lit("todoist"), key).alias("todo_id"),
            ids.annotation_subject_id(F.col("o_custkey").cast("string")).alias("annotation_id"),
            cal.alias("calendar_id"),
            ids.parse_subject_id(cal).alias("p"),
            ids.parse_calendar_subject_id(cal).alias("c"),
            ids.parse_subject_id(key).alias("b"),
        )
        .select(
            "o_orderkey", "sensor_id", "todo_id", "annotation_id", "calendar_id",
            F.col("p.type").alias("parsed_type"), F.col("p.id").alias("parsed_id"),
            F.col("c.calendar_id").alias("parsed_calendar"), F.col("c.external_event_id").alias("parsed_event"),
            F.col("b.type").alias("bare_type"), F.col("b.id").alias("bare_id"),
        )
    )


@query(
    "extract_url",
    """SELECT page_id, nullif(regexp_extract('see ' || url || ' "now"', 'https?://[^\\s<>"{}|\\\\^`\\[\\]]+', 0), '') AS found,
      nullif(regexp_extract(html, '(?i)https?://[^\\s<>"{}|\\\\^`\\[\\]]+', 0), '') AS in_page
    FROM pages""",
)
def extract_url(spark, sf):
    return adapters.table(spark, sf, "pages").select(
        "page_id",
        urls.extract_url(F.concat(F.lit("see "), "url", F.lit(' "now"'))).alias("found"),
        urls.extract_url("html").alias("in_page"),
    )


@query(
    "truncate_url",
    """SELECT page_id, CASE WHEN length(url) > 45 THEN left(url, 45) || '...' ELSE url END AS phone,
      CASE WHEN length(url) > 60 THEN left(url, 60) || '...' ELSE url END AS admin FROM pages""",
)
def truncate_url(spark, sf):
    return adapters.table(spark, sf, "pages").select(
        "page_id", urls.truncate_url("url", 45).alias("phone"), urls.truncate_url("url", 60).alias("admin")
    )


@query(
    "domain",
    """SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, 'unknown' AS bare FROM pages""",
)
def domain(spark, sf):
    return adapters.table(spark, sf, "pages").select(
        "page_id", urls.domain("url").alias("host"), urls.domain(F.concat(F.lit("page "), "page_id")).alias("bare")
    )


@query(
    "truncate_content",
    "SELECT doc_id, CAST(length(left(text, 32000)) AS INTEGER) AS kept, md5(left(text, 32000)) AS digest FROM documents",
)
def truncate_content(spark, sf):
    cut = payload.truncate_content("text", schemas.MAX_CONTENT_CHARS)
    return adapters.table(spark, sf, "documents").select(
        "doc_id", F.length(cut).alias("kept"), F.md5(cut).alias("digest")
    )


@query(
    "json_tags",
    f"""WITH {S.BASE} SELECT event_id,
      CASE k % 4 WHEN 0 THEN 'a' || k || ',b' WHEN 1 THEN NULL ELSE '' END AS tags FROM base""",
)
def json_tags(spark, sf):
    k = F.col("k")
    text = (
        F.when(k % 4 == 0, F.concat(F.lit('["a'), k, F.lit('","b"]')))
        .when(k % 4 == 1, "[]")
        .when(k % 4 == 2, "null")
    )
    return adapters.base_events(spark, sf).select("event_id", joined_tags(payload.json_tags(text)))


def joined_tags(column):
    return F.array_join(column, ",").alias("tags")


@query(
    "nonempty_or_keep",
    f"""WITH {S.BASE} SELECT event_id,
      CASE WHEN k % 3 = 0 THEN 'n' || k WHEN k % 2 = 0 THEN 'o' || k ELSE '' END AS tags FROM base""",
)
def nonempty_or_keep(spark, sf):
    k = F.col("k")
    none = F.array().cast("array<string>")
    new = F.when(k % 3 == 0, F.array(F.concat(F.lit("n"), k))).otherwise(none)
    old = F.when(k % 2 == 0, F.array(F.concat(F.lit("o"), k))).otherwise(none)
    return adapters.base_events(spark, sf).select("event_id", joined_tags(payload.nonempty_or_keep(new, old)))


@query(
    "meta_json",
    """SELECT o_orderkey, '{"source":"' || o_orderpriority || '"}' AS meta,
      '{"source":"say \\"' || o_orderstatus || '\\""}' AS quoted FROM orders""",
)
def meta_json(spark, sf):
    """The serializer form, which escapes quotes."""
    return adapters.table(spark, sf, "orders").select(
        "o_orderkey",
        payload.meta_json("o_orderpriority").alias("meta"),
        payload.meta_json(F.concat(F.lit('say "'), "o_orderstatus", F.lit('"'))).alias("quoted"),
    )


@query(
    "parse_iso_ts",
    "SELECT o_orderkey, o_orderdate AS parsed, CAST(NULL AS TIMESTAMP) AS broken FROM orders",
)
def parse_iso_ts(spark, sf):
    iso = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return adapters.table(spark, sf, "orders").select(
        "o_orderkey",
        ntz(payload.parse_iso_ts(iso), "parsed"),
        ntz(payload.parse_iso_ts(F.concat(F.lit("due "), iso)), "broken"),
    )


@query(
    "backoff_ms",
    f"""WITH {S.BASE} SELECT event_id, CAST(1000 * pow(2, k % 8) AS BIGINT) AS free,
      CAST(least(1000 * pow(2, k % 8), 30000) AS BIGINT) AS capped FROM base""",
)
def backoff_ms(spark, sf):
    attempt = F.col("k") % 8 + 1
    return adapters.base_events(spark, sf).select(
        "event_id", payload.backoff_ms(attempt).alias("free"), payload.backoff_ms(attempt, cap=30000).alias("capped")
    )


@query(
    "display_fields",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'https://x/' || o_orderkey ELSE o_orderpriority END AS title,
      strftime(CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate ELSE o_orderdate + INTERVAL 40 DAY END, '%b %-d, %Y') AS shown
    FROM orders""",
)
def display_fields(spark, sf):
    key = F.col("o_orderkey")
    title = F.when(key % 6 == 0, F.lit(None)).when(key % 3 == 0, F.lit("")).otherwise(F.col("o_orderpriority"))
    published = F.when(key % 2 == 0, F.col("o_orderdate"))
    return adapters.table(spark, sf, "orders").select(
        "o_orderkey",
        payload.display_title(title, F.concat(F.lit("https://x/"), key)).alias("title"),
        payload.display_date(published, F.timestamp_add("DAY", F.lit(40), "o_orderdate")).alias("shown"),
    )


@query(
    "tag_sets",
    f"""WITH {S.BASE} SELECT event_id,
      CASE WHEN k % 7 IN (1, 2) THEN '' ELSE 'tag-' || (k % 7) END AS fresh,
      CASE WHEN k % 7 IN (1, 2) THEN 'tag-1,tag-2' ELSE 'tag-1,tag-2,tag-' || (k % 7) END AS merged,
      CASE WHEN k % 2 = 0 THEN 'tag-1, tag-2' ELSE '(none yet)' END AS prompt,
      k % 3 <> 0 AS valid FROM base""",
)
def tag_sets(spark, sf):
    k = F.col("k")
    tags = F.array(F.concat(F.lit("tag-"), k % 7))
    known = F.array(F.lit("tag-1"), F.lit("tag-2"))
    listed = F.when(k % 2 == 0, known).otherwise(F.array().cast("array<string>"))
    name = F.when(k % 3 == 0, F.concat(F.lit("Bad Tag "), k)).otherwise(F.concat(F.lit("ok-"), k))
    return adapters.base_events(spark, sf).select(
        "event_id",
        F.array_join(payload.new_tags(tags, known), ",").alias("fresh"),
        F.array_join(payload.merge_tags(known, tags), ",").alias("merged"),
        payload.tag_prompt_list(listed).alias("prompt"),
        payload.valid_tag(name).alias("valid"),
    )


@query(
    "time_helpers",
    """SELECT event_id, ts + INTERVAL 1 HOUR AS end_at,
      CASE WHEN hour(ts) < 12 THEN 'morning' WHEN hour(ts) < 18 THEN 'afternoon' ELSE 'evening' END AS part_of_day
    FROM events""",
)
def time_helpers(spark, sf):
    return adapters.table(spark, sf, "events").select(
        "event_id", ntz(payload.add_hours("ts"), "end_at"), payload.time_of_day("ts").alias("part_of_day")
    )


@query(
    "context_fields",
    f"""WITH {S.BASE} SELECT event_id, CASE k % 3 WHEN 0 THEN 'home' WHEN 1 THEN 'office' ELSE 'other' END AS place,
      CASE WHEN k % 2 = 0 THEN 'focused' END AS doing FROM base""",
)
def context_fields(spark, sf):
    k = F.col("k")
    place = F.when(k % 3 == 0, "Home").when(k % 3 == 1, "office").otherwise("beach")
    return adapters.base_events(spark, sf).select(
        "event_id",
        payload.location_type(place).alias("place"),
        payload.activity(F.when(k % 2 == 0, "FOCUSED").otherwise("asleep")).alias("doing"),
    )


_SHAPES = f"""{S.BASE}, shaped AS (
  SELECT event_id, k, CASE k % 4 WHEN 0 THEN '{{"a":{{"k":' || k || '}}}}' WHEN 1 THEN '{{"a":[1,' || k || ']}}'
    WHEN 2 THEN '{{"a":"v' || k || '"}}' ELSE '{{"b":1}}' END AS doc FROM base)"""


def _shaped(spark, sf):
    k = F.col("k")
    doc = (
        F.when(k % 4 == 0, F.concat(F.lit('{"a":{"k":'), k, F.lit("}}")))
        .when(k % 4 == 1, F.concat(F.lit('{"a":[1,'), k, F.lit("]}")))
        .when(k % 4 == 2, F.concat(F.lit('{"a":"v'), k, F.lit('"}')))
        .otherwise('{"b":1}')
    )
    return adapters.base_events(spark, sf).withColumn("doc", doc)


@query(
    "payload_field",
    f"""WITH {_SHAPES} SELECT event_id,
      CASE WHEN json_type(doc, '$.a') NOT IN ('OBJECT', 'ARRAY') THEN json_extract_string(doc, '$.a') END AS field,
      CASE WHEN json_type(doc, '$.a') IN ('OBJECT', 'ARRAY') THEN CAST(json_extract(doc, '$.a') AS VARCHAR) END AS fragment
    FROM shaped""",
)
def payload_field(spark, sf):
    return _shaped(spark, sf).select(
        "event_id",
        payload.json_value("doc", "$.a").alias("field"),
        payload.json_fragment("doc", "$.a").alias("fragment"),
    )


@query(
    "reading_fields",
    f"""WITH {S.SENSOR} SELECT ord, celsius, humidity, CAST(NULL AS DOUBLE) AS battery FROM sensor""",
)
def reading_fields(spark, sf):
    e = adapters.sensor_events(spark, sf)
    return e.select("ord", *[payload.json_double("payload", f"$.{c}").alias(c) for c in ("celsius", "humidity", "battery")])
