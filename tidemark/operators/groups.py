"""Recurring groups of attendees: frequent closed sets and the period at which they meet.

Events with the same frequent attendees are one list with a count. Frequent attendees and frequent
sets are numbered. Sets grow level by level in vertical form, as rows (list, set, attendee): a set
of a list is extended by the attendees of the list that come after its last one, so every set is
made once, from its prefix. Sets with too few events go before the next level. A set is closed when
no set of one attendee more has as many events. A level is stored once, as candidates; what goes on
is found by their counts, which are broadcast while they are few. A closed set's meetings are
counted by moment before they are ordered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.scans import carried_last, time_chunk
from tidemark.operators.skew import skew_join
from tidemark.session import stored

#: Seconds of one chunk of a set's meetings.
CHUNK_SECONDS = 7 * 86_400
#: Counted rows of a table of sets up to which it is broadcast.
FEW = 200_000


def _by_set(rows: DataFrame, sets: DataFrame, keys: list[str], counts: DataFrame) -> DataFrame:
    """Candidates joined with the one row of their set: broadcast after counting, else salted."""
    if sets.count() <= FEW:
        return rows.join(F.broadcast(sets), keys)
    return skew_join(rows, sets, keys, salt_by="list", counts=counts)


def _lists(events: DataFrame, key: str, attendees: str, start: str, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(who, name, n) of frequent attendees, (list, all, n) of the distinct lists of them with their
    events, and (list, start, n) of the moments at which a list meets."""
    listed = events.select(F.col(key).alias("key"), F.col(start).alias("start"), F.explode(F.array_distinct(F.array_compact(attendees))).alias("name"))
    often = listed.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    often = stored(often.select(F.monotonically_increasing_id().alias("who"), "name", "n"), "often")
    numbered = skew_join(listed, often.select("name", "who"), ["name"], salt_by="key")
    lists = numbered.groupBy("key", "start").agg(F.array_sort(F.collect_list("who")).alias("all"))
    moments = stored(lists.groupBy("all", "start").agg(F.count(F.lit(1)).alias("n")), "moments")
    lists = moments.groupBy("all").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("_moments"))
    lists = stored(lists.select(F.monotonically_increasing_id().alias("list"), "all", "n", "_moments"), "lists")
    counts = lists.select("all", F.col("_moments").alias("n"))
    met = skew_join(moments, lists.select("all", "list"), ["all"], salt_by="start", counts=counts).select("list", "start", "n")
    return often, lists.select("list", "all", "n"), met


def frequent_sets(often: DataFrame, lists: DataFrame, least: int, largest: int) -> tuple[DataFrame, DataFrame]:
    """(id, set, n) of the closed sets of two to `largest` attendees with at least `least` events,
    and their (list, id) rows."""
    # A set is named by its level and a number; its prefix is a set of the level below.
    counts = [often.select(F.col("who").alias("id"), F.array("who").alias("set"), "n")]
    level = lists.select("list", F.explode("all").alias("id")).withColumn("last", F.col("id"))
    candidates: list[DataFrame | None] = [None]
    # One level beyond the largest tells which of the largest are closed.
    for _ in range(largest):
        later = F.filter("all", lambda w: w > F.col("last"))
        made = level.join(lists, "list").select("list", F.col("id").alias("prefix"), F.explode(later).alias("last"), "n")
        made = stored(made, "candidates")
        count = made.groupBy("prefix", "last").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows")).filter(F.col("n") >= least)
        count = count.join(counts[-1].select(F.col("id").alias("prefix"), "set"), "prefix")
        count = count.select(F.monotonically_increasing_id().alias("id"), "prefix", "last", F.concat("set", F.array("last")).alias("set"), "n", "rows")
        count = stored(count, "counts")
        if count.isEmpty():
            break
        counts.append(count)
        candidates.append(made)
        level = _by_set(made.select("list", "prefix", "last"), count.select("prefix", "last", "id"), ["prefix", "last"], count.select("prefix", "last", F.col("rows").alias("n"))).select("list", "id", "last")
    closed, rows = None, None
    for k in range(1, min(largest, len(counts))):
        count = counts[k]
        if k + 1 < len(counts):
            inside = F.explode(F.transform("set", lambda w: F.array_remove("set", w)))
            above = counts[k + 1].select(inside.alias("set"), "n").distinct()
            count = count.join(above, ["set", "n"], "left_anti")
        # A number of its own over all levels.
        number = (F.col("id") * F.lit(largest) + F.lit(k)).alias("id")
        count = stored(count.select("prefix", "last", number, "set", "n", "rows"), "closed")
        sizes = count.select("prefix", "last", F.col("rows").alias("n"))
        found = _by_set(candidates[k].select("list", "prefix", "last"), count.select("prefix", "last", "id"), ["prefix", "last"], sizes).select("list", "id")
        count = count.select("id", "set", "n")
        closed = count if closed is None else closed.unionAll(count)
        rows = found if rows is None else rows.unionAll(found)
    if closed is None:
        closed = counts[0].filter(F.lit(False))
        rows = lists.select("list", F.col("list").alias("id")).filter(F.lit(False))
    return closed, rows


def recurring_groups(events: DataFrame, key: str, attendees: str, start: str, *, least: int = 3, largest: int = 5) -> DataFrame:
    """(attendees, n, period_days, regularity) of the closed sets of two to `largest` attendees.

    `n` counts the events that all of them attend. `period_days` is the most common number of whole
    days between one of these and the next (the smaller of equally common ones) and `regularity`
    its share of all gaps. Events are one row each; null and repeated attendees do not count, and
    events without a start count for `n` only.
    """
    often, lists, moments = _lists(events, key, attendees, start, least)
    closed, rows = frequent_sets(often, lists, least, largest)
    # One row a set and moment: events at one moment are zero days apart.
    met = rows.join(moments.filter(F.col("start").isNotNull()), "list")
    met = stored(met.groupBy("id", "start").agg(F.sum("n").alias("n")), "meetings")
    gaps = carried_last(met, ["id"], time_chunk("start", CHUNK_SECONDS), ["start"], F.col("start"), "before")
    days = F.floor((F.unix_micros("start") - F.unix_micros("before")) / 86_400_000_000)
    same = F.struct(F.lit(0).cast("bigint").alias("days"), (F.col("n") - 1).alias("m"))
    step = F.struct(days.alias("days"), F.when(F.col("before").isNotNull(), F.lit(1)).otherwise(0).cast("bigint").alias("m"))
    gaps = gaps.select("id", F.explode(F.array(same, step)).alias("g")).filter("g.m > 0")
    gaps = gaps.groupBy("id", "g.days").agg(F.sum("g.m").alias("m"))
    best = gaps.groupBy("id").agg(F.min(F.struct((-F.col("m")).alias("m"), "days")).alias("b"), F.sum("m").alias("all"))
    out = closed.join(best, "id", "left")
    names = closed.select("id", F.explode("set").alias("who"))
    names = skew_join(names, often.select("who", "name"), ["who"], salt_by="id").groupBy("id").agg(F.array_sort(F.collect_list("name")).alias("attendees"))
    return out.join(names, "id").select("attendees", "n", F.col("b.days").alias("period_days"), (-F.col("b.m") / F.col("all")).alias("regularity"))
