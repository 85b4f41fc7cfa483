"""Related items, causation graphs, clusters and recurring groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import causation, clusters, enrich, groups, similar
from tidemark.plans import sqltext as S
from tidemark.plans.catalog import _KEYWORDS
from tidemark.plans.registry import flat, query
from tidemark.sources import adapters


@query(
    "similar_items",
    f"""WITH {_KEYWORDS},
    t AS (SELECT doc_id, unnest(string_split(tags, ',')) AS tag FROM tags), c AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
    p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM t x JOIN t y ON x.tag = y.tag AND x.doc_id <> y.doc_id GROUP BY ALL),
    s AS (SELECT a, b, o, o / (n.n + m.n - o) AS similarity FROM p JOIN c n ON n.doc_id = a JOIN c m ON m.doc_id = b WHERE 130 * o >= 30 * (n.n + m.n)),
    r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY similarity DESC, 'doc:' || b) AS rank FROM s)
    SELECT 'doc:' || a AS subject_id, CAST(rank AS INTEGER) AS rank, 'doc:' || b AS partner, CAST(o AS INTEGER) AS overlap, similarity FROM r WHERE rank <= 3""",
)
def similar_items(spark, sf):
    """The three documents whose keyword tags are nearest to those of each document."""
    return similar.similar_items(enrich.enrich_default(adapters.enrich_work(spark, sf)), percent=30, k=3)


def _caused(spark, sf):
    """Events whose cause is an earlier one at a data-dependent distance; some causes are missing."""
    e = adapters.base_events(spark, sf)
    back = F.col("event_id") - 1 - F.col("k") % 3
    cause = F.when(F.col("k") % 11 == 0, F.lit(None)).when(F.col("k") % 13 == 0, F.concat(F.lit("lost-"), "event_id")).when(back >= 0, F.concat(F.lit("ev-"), back))
    return e.select(F.concat(F.lit("ev-"), "event_id").alias("id"), cause.alias("causation_id"))


@query(
    "causation_forest",
    f"""WITH RECURSIVE {S.BASE}, g AS (
      SELECT event_id AS id, CASE WHEN k % 11 = 0 OR k % 13 = 0 OR event_id - 1 - k % 3 < 0 THEN NULL ELSE event_id - 1 - k % 3 END AS cause,
        CASE WHEN k % 11 <> 0 AND k % 13 = 0 THEN 'orphan' ELSE 'root' END AS mark FROM base),
    w AS (SELECT id, CASE WHEN cause IS NULL THEN mark ELSE 'caused' END AS mark, id AS here, cause AS up, 0 AS depth, CAST(NULL AS BIGINT) AS head FROM g
      UNION ALL SELECT w.id, w.mark, g.id, g.cause, w.depth + 1, w.here FROM w JOIN g ON g.id = w.up),
    below AS (SELECT here AS id, count(*) - 1 AS n FROM w GROUP BY here)
    SELECT 'ev-' || w.id AS id, mark, 'ev-' || w.here AS root, 'ev-' || head AS head, depth, n AS n_below FROM w JOIN below b ON b.id = w.id WHERE up IS NULL""",
)
def causation_forest(spark, sf):
    return flat(causation.causation_forest(_caused(spark, sf)))


def _clusters_sql(rounds: int) -> str:
    """One label table a round; a round that moves no label changes nothing."""
    step = """l{n} AS (SELECT week, tag, n, arg_min(label, (-v, label)) AS label FROM (
      SELECT week, tag, n, label, sum(v) AS v FROM (
        SELECT e.week, e.tag, m.n, o.label, 2 * w AS v FROM edges e JOIN l{r} o ON o.week = e.week AND o.tag = e.other JOIN l{r} m ON m.week = e.week AND m.tag = e.tag
        UNION ALL SELECT week, tag, n, label, n FROM l{r}) GROUP BY ALL) GROUP BY week, tag, n)"""
    return ", ".join(step.format(n=r + 1, r=r) for r in range(rounds))


@query(
    "weekly_clusters",
    f"""WITH {S.BASE}, i AS (SELECT event_id, time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS week,
        CASE WHEN k % 9 = 0 THEN [] ELSE list_sort(list_distinct(['t' || (user_id % 23), 't' || (user_id % 7), 't' || (k % 5 + 30 * (user_id % 3))])) END AS tags FROM base),
    t AS (SELECT event_id, week, unnest(tags) AS tag FROM i),
    l0 AS (SELECT week, tag, count(*) AS n, tag AS label FROM t GROUP BY week, tag),
    edges AS (SELECT x.week, x.tag, y.tag AS other, count(*) AS w FROM t x JOIN t y ON x.event_id = y.event_id AND x.tag <> y.tag GROUP BY ALL), {_clusters_sql(5)},
    totals AS (SELECT week, label, count(*) AS n_tags, sum(n) AS uses, array_to_string(list(tag ORDER BY n DESC, tag)[1:3], ', ') AS name FROM l5 GROUP BY ALL),
    votes AS (SELECT event_id, t.week, l.label, count(*) AS v FROM t JOIN l5 l ON l.week = t.week AND l.tag = t.tag GROUP BY ALL),
    homes AS (SELECT event_id, v.week, arg_min(v.label, (-v, -uses, v.label)) AS label FROM votes v JOIN totals o ON o.week = v.week AND o.label = v.label GROUP BY event_id, v.week)
    SELECT o.week, o.label AS cluster, name, n_tags, count(h.event_id) AS n_items FROM totals o LEFT JOIN homes h ON h.week = o.week AND h.label = o.label GROUP BY ALL
    UNION ALL SELECT week, NULL, NULL, 0, count(*) FROM i WHERE len(tags) = 0 GROUP BY week""",
)
def weekly_clusters(spark, sf):
    """Tags by user and by a number of the event; users of one remainder share most of them."""
    k, u = F.col("k"), F.col("user_id")
    tag = lambda c: F.concat(F.lit("t"), c.cast("string"))
    tags = F.when(k % 9 != 0, F.array(tag(u % 23), tag(u % 7), tag(k % 5 + 30 * (u % 3))))
    rows = adapters.base_events(spark, sf).withColumn("tags", tags)
    return flat(clusters.weekly_clusters(rows, "event_id", "ts", "tags"))


@query(
    "recurring_groups",
    """WITH e AS (SELECT o_orderkey AS id, TIMESTAMP '2024-01-01 09:00:00' + (o_orderkey % 30) * INTERVAL 1 DAY AS start_at,
        list_sort(list_distinct(['a' || (o_custkey % 3), 'b' || (o_custkey % 6), 'c' || (o_orderkey % 5), 'd' || (o_orderkey % 40)])) AS who FROM orders),
    s AS (SELECT id, start_at, list_filter(list_transform(range(4), lambda i: CASE WHEN (m >> i) & 1 = 1 THEN who[i + 1] END), lambda w: w IS NOT NULL) AS g FROM e, (SELECT unnest(range(1, 16)) AS m)),
    c AS (SELECT g, count(*) AS n FROM s GROUP BY g HAVING count(*) >= 20),
    closed AS (SELECT g, n FROM c x WHERE len(g) >= 2 AND NOT EXISTS (SELECT 1 FROM c y WHERE y.n = x.n AND len(y.g) = len(x.g) + 1 AND list_has_all(y.g, x.g))),
    gap AS (SELECT g, date_diff('day', lag(start_at) OVER (PARTITION BY g ORDER BY start_at, id), start_at) AS d FROM s WHERE g IN (SELECT g FROM closed)),
    k AS (SELECT g, d, count(*) AS m FROM gap WHERE d IS NOT NULL GROUP BY g, d),
    b AS (SELECT g, arg_min(d, (-m, d)) AS d, max(m) / sum(m) AS r FROM k GROUP BY g)
    SELECT array_to_string(closed.g, ',') AS attendees, n, d AS period_days, round(r, 9) AS regularity FROM closed JOIN b ON b.g = closed.g""",
)
def recurring_groups(spark, sf):
    """Four attendees an order by remainders of its keys: some always meet together."""
    o, c = F.col("event_id"), F.col("user_id")
    name = lambda letter, v: F.concat(F.lit(letter), v.cast("string"))
    who = F.array(name("a", c % 3), name("b", c % 6), name("c", o % 5), name("d", o % 40))
    rows = adapters.calendar(spark, sf).select("event_id", "start_at", who.alias("who"))
    return flat(groups.recurring_groups(rows, "event_id", "who", "start_at", least=20, largest=4).withColumn("regularity", F.round("regularity", 9)))
