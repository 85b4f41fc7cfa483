"""Query registry and output helpers."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

MODULES = ("scalars", "ingest", "state", "joins", "aggregates", "routing", "temporal", "catalog", "reads", "streams", "related")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def load_all() -> None:
    for module in MODULES:
        importlib.import_module(f"tidemark.plans.{module}")


def ntz(name: str | Column, alias: str | None = None) -> Column:
    """Instants leave as zone-less UTC timestamps, the type the check engine reads."""
    column = F.col(name) if isinstance(name, str) else name
    out = column.cast("timestamp_ntz")
    label = alias or (name.split(".")[-1] if isinstance(name, str) else None)
    return out.alias(label) if label else out


def joined(name: str, alias: str | None = None) -> Column:
    """Text form of an array column, so both engines compare the same scalar."""
    return F.array_join(name, ",").alias(alias or name)


def flat(frame: DataFrame) -> DataFrame:
    """Timestamps and arrays of a frame in their comparable scalar form."""
    out = []
    for field in frame.schema:
        kind = field.dataType.typeName()
        if kind == "timestamp":
            out.append(ntz(field.name))
        elif kind == "array":
            out.append(joined(field.name))
        else:
            out.append(F.col(field.name))
    return frame.select(*out)
