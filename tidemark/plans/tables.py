"""State tables of the driver adapters, shared by the read queries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from tidemark.operators import folds, reads
from tidemark.sources import adapters


@dataclass(frozen=True)
class LinkTables:
    events: DataFrame
    links: DataFrame
    content: DataFrame
    metadata: DataFrame
    publish: DataFrame


def link_tables(spark, sf, visibility: bool = False) -> LinkTables:
    events = adapters.link_events(spark, sf) if visibility else adapters.lifecycle_events(spark, sf)
    partials = folds.link_partials(events)
    return LinkTables(
        events,
        folds.links(partials).drop("added_ord"),
        folds.link_content(partials),
        folds.link_metadata(partials),
        folds.publish_state(partials),
    )


def link_rows(spark, sf) -> DataFrame:
    """All link tables as one row per subject, from one fold and without a join."""
    return folds.link_rows(folds.link_partials(adapters.lifecycle_events(spark, sf)))


def public_stream(spark, sf) -> DataFrame:
    return reads.published_stream(link_rows(spark, sf))
