"""Ordered scans that survive one hot key.

A plain window over `partitionBy(key)` puts every row of a key into one task. These
helpers split a key into chunks that follow its order, scan each chunk on its own,
reduce every chunk to one summary row, scan the few summaries per key, and join the
carried value back on (key, chunk). No row is dropped and no task sees a whole key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def time_chunk(ts: str, seconds: int) -> Column:
    return F.floor(F.unix_seconds(F.col(ts)) / seconds)


def position_chunk(position: str, rows: int = 1_000_000) -> Column:
    """Chunks of a unique integer position hold at most `rows` rows each."""
    return F.floor(F.col(position) / rows)


def carried_last(
    rows: DataFrame,
    keys: Sequence[str],
    chunk: Column,
    order: Sequence[str],
    value: Column,
    out: str,
    *,
    include_current: bool = False,
) -> DataFrame:
    """Adds `out`: the last non-null `value` before each row (or up to it)."""
    d = rows.withColumn("_chunk", chunk).withColumn("_v", value)
    end = Window.currentRow if include_current else -1
    local = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    scanned = d.withColumn("_local", F.last("_v", ignorenulls=True).over(local))
    # Chunks without a value are listed too (NULL), because they need the carry.
    chunks = d.groupBy(*keys, "_chunk").agg(
        F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct(*order))).alias("_last")
    )
    across = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = chunks.select(*keys, "_chunk", F.last("_last", ignorenulls=True).over(across).alias("_carry"))
    return (
        scanned.join(carry, [*keys, "_chunk"], "left")
        .withColumn(out, F.coalesce("_local", "_carry"))
        .drop("_chunk", "_v", "_local", "_carry")
    )


def running_max(
    rows: DataFrame, keys: Sequence[str], chunk: Column, order: Sequence[str], value: str, out: str
) -> DataFrame:
    """Adds `out`: the greatest `value` strictly before each row of its key."""
    d = rows.withColumn("_chunk", chunk)
    local = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    chunks = d.groupBy(*keys, "_chunk").agg(F.max(value).alias("_m"))
    across = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = chunks.select(*keys, "_chunk", F.max("_m").over(across).alias("_carry"))
    return (
        d.withColumn("_local", F.max(value).over(local))
        .join(carry, [*keys, "_chunk"])
        .withColumn(out, F.greatest("_local", "_carry"))
        .drop("_chunk", "_local", "_carry")
    )


# Ranges of the order that every key shares, and rows of one chunk of a key on average.
RANGES = 256
CHUNK_ROWS = 100_000


def positions(
    rows: DataFrame,
    keys: Sequence[str],
    number: str,
    tie: str,
    *,
    out: str = "position",
    total: str = "total",
    before: str | None = None,
    after: str | None = None,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Adds the 1-based position of a row in its key, ordered by (number, tie), and the
    size of the key; on request also the `tie` of the row before and after it.

    `number` is an integer column, `tie` a unique text, ordered by its md5 first. A chunk
    is one of 2 * RANGES ranges of the numbers, cut at their quantiles, times a range of the
    digest; there are as many digest ranges as the counted rows need, so ties of any size
    split evenly. Rows are numbered per (key, chunk) and one summary row per chunk, of
    which a key has 2 * RANGES times the digest ranges at most, carries counts and edge rows
    along the key. One pass over the rows finds count and quantiles beforehand.
    """
    keys = list(keys)
    cuts = [i / RANGES for i in range(1, RANGES)]
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(number, cuts, 10_000).alias("q")).first()
    # A number that fills a whole quantile is an edge; with the one below it is a range of its own.
    edges = F.array(*[F.lit(e).cast("bigint") for e in sorted({e - d for e in seen["q"] or [0] for d in (0, 1)})])
    digests = max(1, -(-seen["n"] // chunk_rows))
    digest = F.md5(tie)
    part = F.floor(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") * F.lit(digests) / F.lit(1 << 32))
    d = rows.withColumns({"_h": digest, "_r": F.size(F.filter(edges, lambda e: e < F.col(number)))})
    # A range of one number is ordered by digest alone; a wider one must stay whole.
    spread = d.groupBy("_r").agg(F.min(number).alias("_lo"), F.max(number).alias("_hi")).filter("_lo = _hi").collect()
    single = F.col("_r").isin([r["_r"] for r in spread]) if spread else F.lit(False)
    d = d.withColumn("_c", F.when(single, part).otherwise(0).cast("bigint"))
    order = F.struct(F.col(number), F.col("_h"), F.col(tie))
    along = Window.partitionBy(*keys).orderBy("_r", "_c")
    chunks = d.groupBy(*keys, "_r", "_c").agg(
        F.count(F.lit(1)).alias("_n"), F.min_by(tie, order).alias("_first"), F.max_by(tie, order).alias("_last")
    )
    chunks = chunks.select(
        *keys,
        "_r",
        "_c",
        F.coalesce(F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
        F.sum("_n").over(Window.partitionBy(*keys)).alias(total),
        F.lag("_last").over(along).alias("_from"),
        F.lead("_first").over(along).alias("_to"),
    )
    local = Window.partitionBy(*keys, "_r", "_c").orderBy(number, "_h", tie)
    scanned = d.withColumn("_rn", F.row_number().over(local))
    extra = {}
    if before is not None:
        scanned = scanned.withColumn("_lag", F.lag(tie).over(local))
        extra[before] = F.coalesce("_lag", "_from")
    if after is not None:
        scanned = scanned.withColumn("_lead", F.lead(tie).over(local))
        extra[after] = F.coalesce("_lead", "_to")
    placed = scanned.join(chunks, [*keys, "_r", "_c"]).withColumns({out: F.col("_off") + F.col("_rn"), **extra})
    return placed.drop("_h", "_r", "_c", "_rn", "_off", "_from", "_to", "_lag", "_lead")
