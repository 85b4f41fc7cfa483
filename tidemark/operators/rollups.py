"""Mergeable roll-ups: spread, percentiles and distinct counts survive the expiry of raw rows.

A roll-up row keeps count, mean, squared deviations, extremes, a KLL sketch of the values and an
HLL sketch of the distinct ones. Rows of hours merge to days and months without the raw rows; a
coarser row is the same whichever finer ones it came from, up to rounding and sketch error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Accuracy of the sketches: KLL's rank error is about 1.7 / K^0.9, and up to K values are exact.
K = 1024
LG_K = 12
#: Rank error that a KLL sketch of this size stays within, nineteen times of twenty and more.
RANK_ERROR = 0.0035


def rollup(readings: DataFrame, key: str, ts: str, value: str, period: str = "hour", *, k: int = K) -> DataFrame:
    """(key, period, n, mean, m2, min, max, sketch, distinct) of the rows with a value and a time."""
    rows = readings.filter(F.col(value).isNotNull() & F.col(ts).isNotNull())
    v = F.col(value).cast("double")
    return rows.groupBy(key, F.date_trunc(period, ts).alias("period")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count(F.lit(1))).alias("m2"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.kll_sketch_agg_double(v, k).alias("sketch"), F.hll_sketch_agg(v.cast("string"), LG_K).alias("distinct"),
    )


def merge_rollups(rows: DataFrame, key: str, period: str) -> DataFrame:
    """Roll-up rows of a coarser period from those of a finer one.

    The squared deviations of the finer rows are completed by the distance of their means from the
    common mean, so a large common value cancels nothing. A period holds few finer ones (24 hours,
    at most 31 days), which bounds the array; merge step by step.
    """
    merged = rows.groupBy(key, F.date_trunc(period, "period").alias("period")).agg(
        F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"), F.sum("m2").alias("m2"), F.min("min").alias("min"), F.max("max").alias("max"),
        F.kll_merge_agg_double("sketch").alias("sketch"), F.hll_union_agg("distinct").alias("distinct"), F.collect_list(F.struct("n", "mean")).alias("_parts"),
    )
    between = F.aggregate("_parts", F.lit(0.0), lambda acc, p: acc + p["n"] * F.pow(p["mean"] - F.col("mean"), 2))
    return merged.withColumn("m2", F.col("m2") + between).drop("_parts")


def quantile(p: float) -> Column:
    """The value of a roll-up row at the share p of its ordered values."""
    return F.kll_sketch_get_quantile_double("sketch", F.lit(p))


def rollup_stats(rows: DataFrame, key: str, quantiles: dict[str, float] | None = None) -> DataFrame:
    """(key, period, n, mean, stddev, min, max, n_distinct, and the named quantiles); the sample
    deviation needs two values."""
    named = [quantile(p).alias(n) for n, p in (quantiles or {"p50": 0.5, "p95": 0.95}).items()]
    sd = F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1)))
    return rows.select(key, "period", "n", "mean", sd.alias("stddev"), "min", "max", F.hll_sketch_estimate("distinct").alias("n_distinct"), *named)
