"""Related items with names: the k most similar partners of every item, by shared tags.

1. Items with equal tag sets become one row of a set table that keeps its k + 1 smallest ids.
2. Small sets never form pairs. Each is listed under its subsets that are large enough to be an
   overlap, and a subset keeps the k + 1 smallest ids of each set size. What a set shares with one
   of its best partners is such a subset, and the ids kept there of the partner's size are at least
   as similar: if the partner is not among them, k others come before it. So the offers of a set's
   subsets hold its best partners, and the largest subset that offers one is the overlap.
3. Pairs with a large set, which has too many subsets, are listed. A set's tags are ordered by
   rarity. Two sets of at least the wanted similarity share one of their rarest tags (prefix
   filter), so sets meet on those only, if their sizes allow it (length filter) and enough tags may
   follow (position filter). A pair counts at its first shared tag. The sets of a frequent tag are
   dealt into blocks, and each pair of blocks is a join key of its own. Overlaps are counted on
   whole sets.
4. Each set keeps the k + 1 best ids among its partners, and an item takes the first k of these
   that are not itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.skew import skew_join
from tidemark.session import stored

#: Sets of one block of a frequent tag.
BLOCK = 2_000
#: Tags of a set that is listed under its subsets.
SMALL = 8


def _first_k(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key; Spark cuts each map task's part to k before the exchange."""
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("_rank") <= k)


def _sets(items: DataFrame, key: str, tags: str) -> DataFrame:
    """(key, set) of the items with tags; the rarest tag of a set comes first."""
    tagged = stored(items.select(key, F.explode(F.array_distinct(F.array_compact(tags))).alias("tag")), "tagged")
    weights = stored(tagged.groupBy("tag").agg(F.count(F.lit(1)).alias("n")), "weights")
    weighed = skew_join(tagged, weights, ["tag"], salt_by=key, counts=weights)
    ordered = weighed.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("n", "tag"))).alias("s"))
    return stored(ordered.select(key, F.col("s.tag").alias("set")), "members")


def _least(size: Column, percent: int) -> Column:
    """The least overlap of a set of this size with any partner."""
    return F.floor((percent * size + 99) / 100).cast("int")


def _offers(tops: DataFrame, percent: int, k: int, small: int) -> DataFrame:
    """(a, partner, overlap, similarity) of sets of up to `small` tags: their k + 1 best partners
    from such sets, and others whose overlap may be understated but never passes theirs."""
    sets = tops.filter(F.size("set") <= small)
    chosen = F.filter(F.sequence(F.lit(1), F.pow(F.lit(2), F.size("set")).cast("int") - 1), lambda m: F.bit_count(m) >= _least(F.size("set"), percent))
    # Tags in one order, whatever the order of equally rare ones.
    subsets = F.transform(chosen, lambda m: F.filter("set", lambda _, i: F.getbit(m, i) == 1))
    keyed = sets.withColumn("part", F.explode(subsets))
    shared = keyed.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("top")).alias("_ids")).filter("_ids > 1").drop("_ids")
    shared = stored(shared, "shared")
    met = stored(skew_join(keyed, shared.select("part"), ["part"], "left_semi", salt_by="set", counts=shared), "subsets")
    size = F.size("set").alias("m")
    kept = _first_k(met.select("part", size, F.explode("top").alias("partner")), ["part", "m"], [F.col("partner")], k + 1)
    kept = kept.groupBy("part").agg(F.collect_list(F.struct("m", "partner")).alias("kept"))
    asked = skew_join(met.select("part", F.col("set").alias("a")), kept, ["part"], salt_by="a", counts=shared)
    n, overlap = F.size("a"), F.size("part")
    asked = asked.select("a", overlap.alias("overlap"), F.explode("kept").alias("r"))
    union = n + F.col("r.m") - F.col("overlap")
    asked = asked.filter(100 * F.col("overlap") >= percent * union).select("a", F.col("r.partner").alias("partner"), "overlap", (F.col("overlap") / union).alias("similarity"))
    # A partner's size is fixed, so its largest overlap is its largest similarity.
    return asked.groupBy("a", "partner").agg(F.max("overlap").alias("overlap"), F.max("similarity").alias("similarity"))


def _similar_sets(sets: DataFrame, percent: int, block: int, small: int) -> DataFrame:
    """(a, b, overlap) of every two different sets with 100 * overlap >= percent * union, of which
    one at least has more than `small` tags."""
    size = F.size("set")
    # A set that no large set may meet is left out.
    sets = sets.filter(100 * size >= percent * (small + 1))
    prefix = size - _least(size, percent) + 1
    keyed = stored(sets.select("set", F.posexplode(F.slice("set", F.lit(1), prefix)).alias("at", "tag")), "prefixes")
    large = F.size("set") > small
    # Only tags that a large set begins with: without large sets nothing meets here.
    blocks = keyed.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.sum(large.cast("int")).alias("n_large")).filter("n > 1 and n_large > 0")
    blocks = stored(blocks, "blocks")
    counted = skew_join(keyed, blocks, ["tag"], salt_by=["set"], counts=blocks)
    los, his = (F.ceil(F.col(c) / F.lit(block)).cast("int") for c in ("n_large", "n"))
    counted = counted.withColumn("_los", los).withColumn("_his", his)
    dealt = lambda c: F.pmod(F.xxhash64("set"), c).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = counted.filter(large).select("tag", dealt("_los").alias("lo"), every("_his").alias("hi"), F.col("set").alias("a"), F.col("at").alias("i"))
    right = counted.select("tag", every("_los").alias("lo"), dealt("_his").alias("hi"), F.col("set").alias("b"), F.col("at").alias("j"))
    n, m = F.size("a"), F.size("b")
    after = F.least(n - F.col("i"), m - F.col("j"))
    may = (100 * m >= percent * n) & (100 * n >= percent * m) & ((100 + percent) * after >= percent * (n + m))
    met = left.join(right, ["tag", "lo", "hi"]).filter(((m <= small) | (F.col("a") < F.col("b"))) & may)
    shared = F.array_intersect("a", "b")
    met = met.filter(F.get(shared, F.lit(0)) == F.col("tag")).select("a", "b", F.size(shared).alias("overlap"))
    return met.filter((100 + percent) * F.col("overlap") >= percent * (F.size("a") + F.size("b")))


def similar_items(items: DataFrame, key: str = "subject_id", tags: str = "tags", *, percent: int = 50, k: int = 5, block: int = BLOCK, small: int = SMALL) -> DataFrame:
    """(key, rank, partner, overlap, similarity): the k best partners of each item.

    Similarity is the share of common tags among all tags of two items, at least `percent`. Better
    ones come first, equal ones by id. Items are one row each; null and repeated tags of an item do
    not count, and items without tags have no partners. Work on sets of up to `small` tags grows with
    their number and 2 ** tags. Work in a tag grows with the larger sets that begin with it times all sets
    that do, in tasks of two blocks; rows out are k an item at most.
    """
    members = _sets(items, key, tags)
    tops = stored(_first_k(members, ["set"], [F.col(key)], k + 1).groupBy("set").agg(F.array_sort(F.collect_list(key)).alias("top")), "sets")
    pairs = stored(_similar_sets(tops.select("set"), percent, block, small), "pairs")
    both = pairs.select("a", "b", "overlap").unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "overlap"))
    large = tops.filter(F.size("set") > small)
    both = both.unionAll(large.select(F.col("set").alias("a"), F.col("set").alias("b"), F.size("set").alias("overlap")))
    named = skew_join(both, tops.select(F.col("set").alias("b"), "top"), ["b"], salt_by=["a"])
    similarity = F.col("overlap") / (F.size("a") + F.size("b") - F.col("overlap"))
    offered = named.select("a", F.explode("top").alias("partner"), "overlap", similarity.alias("similarity"))
    offered = offered.unionAll(_offers(tops, percent, k, small))
    best = _first_k(offered, ["a"], [F.desc("similarity"), F.col("partner")], k + 1).groupBy(F.col("a").alias("set"))
    best = best.agg(F.transform(F.array_sort(F.collect_list(F.struct("_rank", "partner", "overlap", "similarity"))), lambda r: F.struct(r["partner"], r["overlap"], r["similarity"])).alias("best"))
    found = skew_join(members, best, ["set"], salt_by=key)
    mine = F.slice(F.filter("best", lambda r: r["partner"] != F.col(key)), F.lit(1), F.lit(k))
    out = found.select(key, F.posexplode(mine).alias("_at", "r"))
    return out.select(key, (F.col("_at") + 1).alias("rank"), F.col("r.partner").alias("partner"), F.col("r.overlap").alias("overlap"), F.col("r.similarity").alias("similarity"))
