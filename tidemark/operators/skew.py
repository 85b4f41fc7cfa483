"""Many-to-one joins in which one key may hold a third of the many side.

Spark's own skew handling needs an exchange directly under both sides of the join; a
side that was just aggregated on the join key has none, so a hot key would end in one
task. Here the rows of each key are counted, the rows of keys above a fair share are
spread over salts, and the matching rows of the one side are copied to each salt.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key is hot if it holds more than this fraction of all rows. By counting, fewer than
# SHARES keys can, whatever the data, so the hot keys may be broadcast; any other key
# is smaller than an even share of a job of SHARES tasks.
SHARES = 10_000
# Rows that one task may take in any case; below this nothing needs to be spread.
TARGET_ROWS = 100_000


def hot_keys(counts: DataFrame, keys: Sequence[str], n: str = "n", target: int | None = None) -> DataFrame:
    """Keys above their share with the number of salts each needs: fewer than SHARES rows.

    `counts` has one row per key. Which keys are hot depends on the counts alone, so
    every use of the result, in any task or retry, agrees.
    """
    share = F.greatest(counts.agg(F.sum(n) / F.lit(SHARES)).scalar(), F.lit(float(TARGET_ROWS if target is None else target)))
    return counts.filter(F.col(n) > share).select(*keys, F.ceil(F.col(n) / share).cast("int").alias("_salts"))


def skew_join(
    many: DataFrame,
    one: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    *,
    salt_by: str | Sequence[str],
    counts: DataFrame | None = None,
    target: int | None = None,
) -> DataFrame:
    """Join rows with at most one matching row each (inner, left, left_semi, left_anti).

    `salt_by` names columns of the many side that differ between rows of one key, such
    as the arrival position. `counts` gives rows per key (keys and `n`) where the caller
    has them. The salts change where rows are processed, never which rows match.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"skew_join does not support {how!r}")
    keys = list(keys)
    digest = F.xxhash64(*([salt_by] if isinstance(salt_by, str) else salt_by))
    if counts is None:
        counts = many.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    hot = F.broadcast(hot_keys(counts, keys, target=target))
    left = many.join(hot, keys, "left").withColumn("_salt", F.coalesce(F.pmod(digest, "_salts"), F.lit(0)).cast("int")).drop("_salts")
    every = F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)
    right = one.join(hot, keys, "left").withColumn("_salt", F.explode(every)).drop("_salts")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
