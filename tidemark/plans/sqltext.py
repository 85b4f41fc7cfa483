"""SQL twins of the adapters in `tidemark.sources.adapters`, as common table expressions."""

K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"

BASE = f"base AS (SELECT *, {K} AS k FROM events)"

LIFE = f"""{BASE},
life AS (
  SELECT event_id AS ord, 'ev-' || event_id AS id, ts, 'source-' || (user_id % 3) AS source, k, user_id, event_id,
    'link:' || (user_id * 10 + k % 10) AS subject_id,
    CASE event_type WHEN 'signup' THEN 'link.added' WHEN 'view' THEN 'content.fetched' WHEN 'error' THEN 'content.fetched'
      WHEN 'click' THEN 'enrichment.completed' ELSE 'publish.completed' END AS kind,
    CASE WHEN event_type = 'signup' THEN 'https://site' || user_id || '.example.com/' || (k % 10) END AS url,
    CASE WHEN event_type IN ('view', 'error') AND k % 2 = 0 THEN 'https://final.example.com/' || event_id END AS final_url,
    CASE WHEN event_type IN ('view', 'error') AND k % 3 <> 0 THEN 't' || k END AS title,
    CASE WHEN event_type IN ('view', 'error') AND k % 4 <> 0 THEN 'text ' || event_id END AS text_content,
    CASE WHEN event_type = 'error' THEN 'HTTP ' || (400 + k % 7) END AS fetch_error,
    CASE WHEN event_type = 'click' THEN
      CASE WHEN (k // 10) % 3 = 0 THEN '' ELSE 'tag-' || (k % 7) || ',tag-' || (k % 3) END END AS tags,
    CASE WHEN event_type = 'click' THEN
      CASE WHEN k % 2 = 0 THEN 'short ' || k WHEN k % 3 = 0 THEN 'plain ' || k END END AS summary_short,
    CASE WHEN event_type = 'click' AND k % 5 <> 0 THEN 'long ' || k END AS summary_long,
    CASE WHEN event_type = 'click' AND k % 4 = 0 THEN 'en' END AS language,
    CASE WHEN event_type = 'click' THEN 'm' || (k % 2) END AS model_version,
    event_id % 10 < 7 AS published_to_kafka, user_id % 3 AS kafka_partition, event_type
  FROM base)"""

# Stages after A, the arrival of the subject's first link.added.
AFTER = f"""{LIFE},
anchor AS (SELECT subject_id, min(ord) AS a FROM life WHERE kind = 'link.added' GROUP BY subject_id),
after_a AS (SELECT life.*, a FROM life JOIN anchor USING (subject_id) WHERE ord > a),
links_base AS (
  SELECT l.subject_id, l.url, l.url AS url_norm, l.ts AS created_at, l.source, l.ord AS added_ord
  FROM life l JOIN anchor n ON l.subject_id = n.subject_id AND l.ord = n.a),
facts AS (
  SELECT subject_id,
    max(ord) FILTER (WHERE fetch_error IS NOT NULL OR kind = 'publish.completed') AS r_ord,
    max(ord) FILTER (WHERE fetch_error IS NOT NULL) AS e_ord,
    max(ord) FILTER (WHERE kind = 'publish.completed') AS p_ord,
    max(ord) FILTER (WHERE kind = 'content.fetched') AS c_ord,
    max(ord) FILTER (WHERE kind = 'content.fetched' AND fetch_error IS NULL) AS ok_ord,
    max(ord) FILTER (WHERE kind = 'enrichment.completed') AS m_ord,
    count(*) FILTER (WHERE fetch_error IS NOT NULL) AS n_err,
    count(*) FILTER (WHERE kind = 'enrichment.completed') AS n_enrich
  FROM after_a GROUP BY subject_id),
links AS (
  SELECT b.subject_id, b.url, b.url_norm, b.created_at, b.source,
    CASE WHEN r_ord IS NOT NULL THEN CASE WHEN r_ord = e_ord THEN 'error' ELSE 'published' END
      WHEN m_ord IS NOT NULL THEN 'enriched' WHEN ok_ord IS NOT NULL THEN 'fetched' ELSE 'new' END AS status,
    'public' AS visibility, FALSE AS pinned, CAST(coalesce(n_err, 0) AS INTEGER) AS retry_count,
    e.ts AS last_error_at, e.fetch_error AS last_error
  FROM links_base b LEFT JOIN facts f USING (subject_id) LEFT JOIN life e ON e.ord = f.e_ord),
last_of AS (
  SELECT subject_id,
    max_by(final_url, ord) FILTER (WHERE final_url IS NOT NULL) AS final_url,
    max_by(title, ord) FILTER (WHERE title IS NOT NULL) AS title,
    max_by(text_content, ord) FILTER (WHERE text_content IS NOT NULL) AS text_content,
    max_by(tags, ord) FILTER (WHERE tags <> '') AS tags,
    max_by(summary_short, ord) FILTER (WHERE summary_short IS NOT NULL) AS summary_short,
    max_by(summary_long, ord) FILTER (WHERE summary_long IS NOT NULL) AS summary_long,
    max_by(language, ord) FILTER (WHERE language IS NOT NULL) AS language,
    max_by(model_version, ord) FILTER (WHERE model_version IS NOT NULL) AS model_version
  FROM after_a GROUP BY subject_id),
link_content AS (
  SELECT f.subject_id, o.final_url, o.title, o.text_content, CAST(NULL AS VARCHAR) AS html_storage_key,
    c.ts AS fetched_at, c.fetch_error
  FROM facts f JOIN last_of o USING (subject_id) JOIN life c ON c.ord = f.c_ord),
link_metadata AS (
  SELECT f.subject_id, coalesce(o.tags, '') AS tags, o.summary_short, o.summary_long, o.language, o.model_version,
    m.ts AS updated_at
  FROM facts f JOIN last_of o USING (subject_id) JOIN life m ON m.ord = f.m_ord),
before_p AS (
  SELECT subject_id, count(*) AS n FROM after_a JOIN facts USING (subject_id)
  WHERE kind = 'enrichment.completed' AND ord < p_ord GROUP BY subject_id),
publish_state AS (
  SELECT f.subject_id, CAST(n_enrich AS INTEGER) AS desired_version, CAST(coalesce(n, 0) AS INTEGER) AS published_version,
    (n IS NULL OR m_ord > p_ord) AS dirty, CASE WHEN n IS NOT NULL THEN p.ts END AS last_published_at
  FROM facts f LEFT JOIN before_p USING (subject_id) LEFT JOIN life p ON p.ord = f.p_ord
  WHERE n_enrich > 0)"""

SENSOR = f"""{BASE},
sensor AS (
  SELECT event_id AS ord, (event_id * 7919 + 13) % 1000003 AS mixed, 'sensor:room_' || (user_id % 2) AS subject_id,
    ts AS occurred_at, CASE WHEN k % 50 <> 0 THEN value END AS celsius, CAST(k AS DOUBLE) AS humidity, event_id
  FROM base)"""

ACTIVITY = f"""{BASE},
activity AS (SELECT event_id, user_id, ts, 'tag-' || (k % 7) AS topic, 'tag-' || k AS fine_topic FROM base)"""

CALENDAR = """calendar AS (
  SELECT o_orderkey AS event_id, o_custkey AS user_id,
    TIMESTAMP '2024-01-01 09:00:00' + to_days(CAST(o_orderkey % 30 AS INTEGER)) AS start_at,
    o_orderpriority AS title, 'tag-' || (o_orderkey % 7) AS tag
  FROM orders)"""

TODO = """todo_events AS (
  SELECT o_orderkey * 4 AS ord, 'todoist:' || o_orderkey AS subject_id, 'created' AS kind, o_orderdate AS ts,
    o_orderpriority AS title, CASE WHEN o_orderkey % 3 = 0 THEN 'project-' || (o_orderkey % 5) END AS project,
    'label-' || (o_orderkey % 4) AS labels,
    CASE WHEN o_orderkey % 2 = 0 THEN date_trunc('day', o_orderdate) + INTERVAL 7 DAY END AS due_at
  FROM orders
  UNION ALL
  SELECT o_orderkey * 4 + 1, 'todoist:' || o_orderkey, 'completed', o_orderdate + INTERVAL 1 HOUR, NULL, NULL, NULL, NULL
  FROM orders WHERE o_orderstatus = 'F'
  UNION ALL
  SELECT o_orderkey * 4 + 2, 'todoist:' || o_orderkey, 'created', o_orderdate + INTERVAL 2 HOUR,
    'again ' || o_orderpriority, NULL, '', NULL
  FROM orders WHERE o_orderkey % 7 = 0)"""

# Scheme, host, path, query of the page URLs. These hold no ports, upper case or escapes.
PAGE = """page AS (
  SELECT page_id, url, html,
    regexp_extract(url, '^(https?)://', 1) AS scheme,
    regexp_extract(url, '^https?://([^/?#]+)', 1) AS host,
    regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path0,
    regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) AS query0
  FROM pages),
page_parts AS (
  SELECT *, CASE WHEN path0 = '' THEN '/' ELSE path0 END AS path,
    array_to_string(list_sort(string_split(query0, '&')), '&') AS query FROM page),
page_norm AS (
  SELECT page_id, url, html, host,
    scheme || '://' || host ||
      CASE WHEN query = '' AND path <> '/' AND path LIKE '%/' THEN left(path, length(path) - 1) ELSE path END ||
      CASE WHEN query <> '' THEN '?' || query ELSE '' END AS url_norm
  FROM page_parts),
page_links AS (
  SELECT page_id, url, url_norm, html, host, 'link:' || substr(sha256(url_norm), 1, 16) AS subject_id FROM page_norm)"""

POSTS = """posts AS (
  SELECT 'doc-' || doc_id AS slug, source || ' ' || doc_id AS title, source AS series,
    CASE WHEN doc_id % 5 <> 0 THEN CAST(doc_id // 2 AS INTEGER) END AS part,
    ['lang-' || lang, 'kind-' || (doc_id % 6)] AS tags,
    CASE WHEN doc_id % 3 <> 0 THEN 'published' ELSE 'draft' END AS status,
    DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER) AS date
  FROM documents)"""
