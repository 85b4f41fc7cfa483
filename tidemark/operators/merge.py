"""Applying pre-aggregated changes to state tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _merged(name: str, rule: str) -> Column:
    old, new = F.col(f"o.{name}"), F.col(f"n.{name}")
    matched = F.col("o._here") & F.col("n._here")
    if rule == "keep":
        both = old
    elif rule == "overwrite":
        both = new
    elif rule == "coalesce":
        both = F.coalesce(new, old)
    elif rule == "nonempty":
        both = F.when(F.size(new) > 0, new).when(F.size(old) > 0, old).otherwise(new)
    elif rule == "add":
        both = F.coalesce(old, F.lit(0)) + F.coalesce(new, F.lit(0))
    else:
        raise ValueError(f"unknown merge rule {rule!r}")
    return F.when(matched, both).when(F.col("o._here"), old).otherwise(new).alias(name)


def merge_state(
    current: DataFrame,
    changes: DataFrame,
    keys: Sequence[str],
    rules: Mapping[str, str],
    *,
    insert: bool = True,
) -> DataFrame:
    """New version of a state table.

    `changes` has one row per key. `rules` maps each column to keep, overwrite,
    coalesce, nonempty or add; columns without a rule are kept. `insert=False` is
    the update-only form: unknown keys are ignored.
    """
    columns = [c for c in current.columns if c not in keys]
    missing = [F.lit(None).cast(current.schema[c].dataType).alias(c) for c in columns if c not in changes.columns]
    fresh = changes.select("*", *missing)
    o = current.withColumn("_here", F.lit(True)).alias("o")
    n = fresh.withColumn("_here", F.lit(True)).alias("n")
    on = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys]
    return o.join(n, on, "full_outer" if insert else "left").select(
        *[F.coalesce(f"o.{k}", f"n.{k}").alias(k) for k in keys],
        *[_merged(c, rules.get(c, "keep")) for c in columns],
    )


def partial_update(links: DataFrame, updates: DataFrame) -> DataFrame:
    """Update-only change set for links: status, error (adds to retry_count), visibility.

    `updates` has one row per subject: status, n_errors, last_error_at, last_error,
    visibility; NULL means "not touched".
    """
    changes = updates.withColumn("retry_count", F.col("n_errors").cast("int")).drop("n_errors")
    rules = {
        "status": "coalesce",
        "retry_count": "add",
        "last_error_at": "coalesce",
        "last_error": "coalesce",
        "visibility": "coalesce",
    }
    return merge_state(links, changes, ["subject_id"], rules, insert=False)


def updates_from_events(decoded: DataFrame) -> DataFrame:
    """Collapse status, error and visibility events to one update row per subject."""
    kind = F.col("event_type")
    failed = (kind == "content.fetched") & F.col("p.fetch_error").isNotNull()
    stage = (
        F.when(failed, "error")
        .when(kind == "content.fetched", "fetched")
        .when(kind == "enrichment.completed", "enriched")
        .when(kind == "publish.completed", "published")
    )
    visible = F.when((kind == "link.visibility_changed") & F.col("p.visibility").isin("public", "private"), F.col("p.visibility"))
    err = F.max_by(F.struct("occurred_at", "p.fetch_error"), F.when(failed, F.col("ord")))
    return (
        decoded.groupBy("subject_id")
        .agg(
            F.max_by(stage, F.when(stage.isNotNull(), F.col("ord"))).alias("status"),
            F.count_if(failed).alias("n_errors"),
            err.alias("e"),
            F.max_by(visible, F.when(visible.isNotNull(), F.col("ord"))).alias("visibility"),
        )
        .select(
            "subject_id",
            "status",
            "n_errors",
            F.col("e.occurred_at").alias("last_error_at"),
            F.col("e.fetch_error").alias("last_error"),
            "visibility",
        )
    )
