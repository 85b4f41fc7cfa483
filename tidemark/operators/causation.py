"""The whole causation graph of a ledger, by pointer doubling.

Events form a forest: each may name the event that caused it. After round r every event points to
its ancestor 2^r steps up and knows how many events below it are fewer than 2^r steps away. One
round doubles the reach: an event takes the pointer of its pointer, and adds the counts of the
events that point to it. A chain of n events needs log2(n) + 1 rounds. Each round is stored.

Events of which no root is found are on a cycle or below one. Their number falls in every round
as long as one of them has a root, so the rounds end when it stays the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.skew import skew_join
from tidemark.session import stored


def causation_forest(events: DataFrame, id_col: str = "id", cause_col: str = "causation_id", salts: int | None = None) -> DataFrame:
    """(id, mark, root, head, depth, n_below) of every event.

    `mark` is 'root' without a cause, 'orphan' where the cause is not in the ledger, 'cycle' where
    the causes lead into a circle, and 'caused' otherwise. Roots and orphans are their own root with
    depth 0 and no head; `head` is the root's child on the way. `n_below` counts all events below.
    Events of a cycle have null in all of these. Ids are unique; rows without id are left out.
    `salts` overrides the rows that one task takes of a hot cause.
    """
    rows = events.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(cause_col).alias("cause"))
    above = rows.select(F.col("id").alias("cause"), F.col("cause").alias("_above"), F.lit(True).alias("_there"))
    named = skew_join(rows.filter("cause IS NOT NULL"), above, ["cause"], "left", salt_by="id", target=salts)
    first = rows.filter("cause IS NULL").select("id", F.lit("root").alias("mark"), F.lit(None).cast(rows.schema["id"].dataType).alias("anc"))
    parent = F.when(F.col("_there"), F.col("cause"))
    first = stored(first.unionAll(named.select("id", F.when(F.col("_there"), "caused").otherwise("orphan"), parent)), "causes")
    # Children of a root or orphan are found at once; all others point to a parent that has one itself.
    tops = first.filter("anc IS NULL").select(F.col("id").alias("anc"), F.lit(True).alias("_top"))
    state = skew_join(first.filter("anc IS NOT NULL"), tops, ["anc"], "left", salt_by="id", target=salts)
    head = F.when(F.col("_top"), F.col("id")).alias("head")
    state = state.select("id", "mark", "anc", F.lit(0).cast("long").alias("n_below"), head, F.when(F.col("_top"), F.col("anc")).alias("root"), F.when(F.col("_top"), 1).alias("depth"))
    none = F.lit(None).cast(rows.schema["id"].dataType)
    state = state.unionAll(first.filter("anc IS NULL").select("id", "mark", "anc", F.lit(0).cast("long"), none, "id", F.lit(0)))
    state = stored(state, "round")
    reach, open_before = 1, -1
    while True:
        left = state.agg(F.count_if(F.col("anc").isNotNull()).alias("moving"), F.count_if(F.col("root").isNull()).alias("open")).first()
        # Cycles move for ever; what is below them moves with them.
        if left["moving"] == 0 or (left["open"] == open_before and state.filter("anc IS NOT NULL AND root IS NOT NULL").isEmpty()):
            break
        open_before = left["open"]
        state = stored(_doubled(state, reach, salts), "round")
        reach *= 2
    lost = F.col("root").isNull()
    below = F.when(~lost, F.col("n_below")).alias("n_below")
    return state.select(F.col("id").alias(id_col), F.when(lost, "cycle").otherwise(F.col("mark")).alias("mark"), "root", "head", "depth", below)


def _doubled(state: DataFrame, reach: int, salts: int | None) -> DataFrame:
    ups = state.select(F.col("id").alias("anc"), F.col("anc").alias("_anc"), F.col("head").alias("_head"), F.col("root").alias("_root"), F.col("depth").alias("_depth"))
    moved = skew_join(state.filter("anc IS NOT NULL"), ups, ["anc"], salt_by="id", target=salts)
    fresh = F.col("root").isNull() & F.col("_root").isNotNull()
    moved = moved.select(
        "id", "mark", F.col("_anc").alias("anc"), "n_below", F.when(fresh, F.col("_head")).otherwise(F.col("head")).alias("head"),
        F.when(fresh, F.col("_root")).otherwise(F.col("root")).alias("root"), F.when(fresh, F.col("_depth") + F.lit(reach)).otherwise(F.col("depth")).alias("depth"),
    )
    # Whom a pointer reaches is exactly `reach` above; with those below the pointing event nothing is counted twice.
    added = state.filter("anc IS NOT NULL").groupBy(F.col("anc").alias("id")).agg(F.sum(F.col("n_below") + 1).alias("_more"))
    every = moved.unionAll(state.filter("anc IS NULL"))
    return every.join(added, "id", "left").withColumn("n_below", F.col("n_below") + F.coalesce("_more", F.lit(0).cast("long"))).drop("_more")
