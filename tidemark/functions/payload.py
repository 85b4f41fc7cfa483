"""JSON payload access and small value helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def unwrap_payload(payload: Column | str) -> Column:
    """A payload stored as a JSON string that itself holds JSON is unwrapped once."""
    p = _col(payload)
    return F.when(
        F.ltrim(p).startswith('"'), F.get_json_object(F.concat(F.lit("["), p, F.lit("]")), "$[0]")
    ).otherwise(p)


def json_value(payload: Column | str, path: str) -> Column:
    """Scalar at `path` as text; NULL when it is absent, an object or an array."""
    p = _col(payload)
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(p), path, "variant"))
    return F.when(~F.regexp_like(kind, F.lit("^(OBJECT|ARRAY)")), F.get_json_object(p, path))


def json_fragment(payload: Column | str, path: str) -> Column:
    """Object or array at `path` as JSON text; NULL for scalars."""
    p = _col(payload)
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(p), path, "variant"))
    return F.when(F.regexp_like(kind, F.lit("^(OBJECT|ARRAY)")), F.get_json_object(p, path))


def has_key(payload: Column | str, key: str) -> Column:
    """True where the top-level key exists, even with a JSON null."""
    return F.coalesce(F.array_contains(F.json_object_keys(_col(payload)), key), F.lit(False))


def json_double(payload: Column | str, path: str) -> Column:
    return F.try_variant_get(F.try_parse_json(_col(payload)), path, "double")


def json_tags(text: Column | str) -> Column:
    """JSON array text to ARRAY<STRING>: NULL, '' and 'null' give [], '[]' gives NULL."""
    t = _col(text)
    parsed = F.from_json(t, "array<string>")
    return F.when(t.isNull() | t.isin("", "null"), F.array().cast("array<string>")).otherwise(
        F.when(F.size(parsed) > 0, parsed)
    )


def nonempty_or_keep(new: Column | str, old: Column | str) -> Column:
    n, o = _col(new), _col(old)
    return F.when(F.size(n) > 0, n).when(F.size(o) > 0, o).otherwise(n)


def meta_json(source: Column | str) -> Column:
    return F.to_json(F.struct(_col(source).alias("source")))


def parse_iso_ts(text: Column | str) -> Column:
    return F.try_to_timestamp(_col(text))


def present(value: Column | str) -> Column:
    """Text that is neither NULL nor empty."""
    v = _col(value)
    return F.coalesce(v != "", F.lit(False))


def valid_visibility(value: Column | str) -> Column:
    return F.coalesce(_col(value).isin("public", "private"), F.lit(False))


def backoff_ms(attempt: Column | str, base: int = 1000, cap: int | None = None) -> Column:
    """Waiting time before attempt n+1: base * 2^(n-1), at most `cap`."""
    wait = (F.lit(base) * F.pow(F.lit(2), _col(attempt) - 1)).cast("bigint")
    return wait if cap is None else F.least(wait, F.lit(cap).cast("bigint"))


def truncate_content(text: Column | str, limit: int) -> Column:
    return F.substring(_col(text), 1, limit)


def display_title(title: Column | str, url: Column | str) -> Column:
    return F.coalesce(F.nullif(_col(title), F.lit("")), _col(url))


def display_date(published_at: Column | str, created_at: Column | str) -> Column:
    return F.date_format(F.coalesce(_col(published_at), _col(created_at)), "MMM d, yyyy")


def new_tags(tags: Column | str, known: Column | str) -> Column:
    return F.array_except(_col(tags), _col(known))


def merge_tags(known: Column | str, tags: Column | str) -> Column:
    return F.array_union(_col(known), _col(tags))


def tag_prompt_list(known: Column | str, limit: int = 100) -> Column:
    """First known tags as prompt text, '(none yet)' when there are none."""
    return F.coalesce(
        F.nullif(F.array_join(F.slice(_col(known), 1, limit), ", "), F.lit("")), F.lit("(none yet)")
    )


def valid_tag(tag: Column | str) -> Column:
    return F.regexp_like(_col(tag), F.lit("^[a-z0-9]+(-[a-z0-9]+)*$"))


def add_hours(ts: Column | str, hours: int = 1) -> Column:
    return _col(ts) + F.expr(f"INTERVAL {int(hours)} HOURS")


# Fixed values of the context fields.
LOCATION_TYPES = ("home", "office", "transit", "other")
ACTIVITIES = ("focused", "browsing", "moving")


def location_type(value: Column | str) -> Column:
    """One of the known places, 'other' for anything else."""
    v = F.lower(_col(value))
    return F.when(v.isin(*LOCATION_TYPES), v).otherwise(F.lit("other"))


def activity(value: Column | str) -> Column:
    """One of the known activities, NULL for anything else."""
    v = F.lower(_col(value))
    return F.when(v.isin(*ACTIVITIES), v)


def time_of_day(ts: Column | str) -> Column:
    """morning before 12, afternoon before 18, evening after."""
    hour = F.hour(_col(ts))
    return F.when(hour < 12, "morning").when(hour < 18, "afternoon").otherwise("evening")
