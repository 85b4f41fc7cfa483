"""Weekly topic clusters: label propagation on each week's graph of tags.

Tags of one item are joined by an edge; edges and tags carry their number of items. In a round
every tag takes the label with the most votes: twice the weight of each edge for the neighbour's
label, and its own number of items for the label it has. Ties go to the smallest label, and all
tags move at once, so a round has one result. Rounds end when no tag moves, or at their limit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.skew import skew_join
from tidemark.session import stored


def propagated(nodes: DataFrame, edges: DataFrame, rounds: int) -> DataFrame:
    """(week, tag, n, label) of `nodes` (week, tag, n) after label propagation over `edges`
    (week, tag, other, w), each edge in both directions."""
    state = stored(nodes.withColumn("label", F.col("tag")), "labels")
    for _ in range(rounds):
        # Tags of one week with many neighbours are read by many edges.
        known = state.select("week", F.col("tag").alias("other"), "label")
        votes = skew_join(edges, known, ["week", "other"], salt_by="tag").select("week", "tag", "label", (2 * F.col("w")).alias("v"))
        votes = votes.unionAll(state.select("week", "tag", "label", F.col("n").alias("v")))
        sums = votes.groupBy("week", "tag", "label").agg(F.sum("v").alias("v"))
        best = sums.groupBy("week", "tag").agg(F.min(F.struct((-F.col("v")).alias("v"), "label")).alias("b"))
        after = state.withColumnRenamed("label", "_old").join(best.select("week", "tag", F.col("b.label").alias("label")), ["week", "tag"])
        after = stored(after, "labels")
        moved = not after.filter("label <> _old").isEmpty()
        state = after.drop("_old")
        if not moved:
            break
    return state


def weekly_clusters(items: DataFrame, key: str, ts: str, tags: str, *, rounds: int = 5, named: int = 3) -> DataFrame:
    """(week, cluster, name, n_tags, n_items) for every cluster of every epoch-aligned week.

    `name` joins the cluster's `named` most used tags. An item counts in the cluster that most of
    its tags belong to; ties go to the cluster whose tags are used more, then to the smallest
    label. Items without tags are the cluster null, so a week's n_items add up to its items. A
    cluster to which no item falls has 0. Null and repeated tags of an item do not count; items
    without a time are left out. Pairs of tags are made within an item only.
    """
    rows = items.filter(F.col(ts).isNotNull()).select(F.col(key).alias("key"), F.window(ts, "7 days").start.alias("week"), F.array_sort(F.array_distinct(F.array_compact(tags))).alias("tags"))
    rows = stored(rows, "items")
    tagged = rows.select("week", "key", F.explode("tags").alias("tag"))
    nodes = tagged.groupBy("week", "tag").agg(F.count(F.lit(1)).alias("n"))
    pair = F.explode(F.flatten(F.transform("tags", lambda a: F.transform(F.filter("tags", lambda b: b != a), lambda b: F.struct(a.alias("tag"), b.alias("other"))))))
    edges = rows.select("week", pair.alias("e")).groupBy("week", F.col("e.tag").alias("tag"), F.col("e.other").alias("other")).agg(F.count(F.lit(1)).alias("w"))
    labels = propagated(nodes, stored(edges, "edges"), rounds)

    totals = labels.groupBy("week", "label").agg(F.count(F.lit(1)).alias("n_tags"), F.sum("n").alias("uses"))
    ranked = labels.withColumn("_r", F.row_number().over(Window.partitionBy("week", "label").orderBy(F.desc("n"), "tag"))).filter(F.col("_r") <= named)
    names = ranked.groupBy("week", "label").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "tag"))), lambda r: r["tag"]), ", ").alias("name"))
    homes = labels.join(totals, ["week", "label"]).select("week", "tag", "label", "uses")
    held = skew_join(tagged, homes, ["week", "tag"], salt_by="key").groupBy("week", "key", "label").agg(F.count(F.lit(1)).alias("v"), F.first("uses").alias("uses"))
    chosen = held.groupBy("week", "key").agg(F.min(F.struct((-F.col("v")).alias("v"), (-F.col("uses")).alias("u"), "label")).alias("b"))
    counts = chosen.groupBy("week", F.col("b.label").alias("label")).agg(F.count(F.lit(1)).alias("n_items"))
    out = totals.join(names, ["week", "label"]).join(counts, ["week", "label"], "left")
    bare = rows.filter(F.coalesce(F.size("tags"), F.lit(0)) <= 0).groupBy("week").agg(F.count(F.lit(1)).alias("n_items"))
    out = out.select("week", F.col("label").alias("cluster"), "name", "n_tags", F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"))
    return out.unionAll(bare.select("week", F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(0).cast("long"), "n_items"))
