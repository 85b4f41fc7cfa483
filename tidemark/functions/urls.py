"""URL normalization and URL helpers as native column expressions.

The rules follow the WHATWG URL parser for http, https, ws, wss and ftp: scheme and
host in lower case, default ports dropped, dot segments resolved, illegal path
characters percent-encoded, query pairs decoded, sorted as the text "key,value" and
encoded as form data, fragment dropped, one trailing slash dropped from a non-root
path. Punycode hosts and number-only IPv4 hosts are left as written.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.hosts import parsed_host

# scheme, authority, path, query, fragment
_SPECIAL = r"^(?i)(https?|wss?|ftp):[/\\]*([^/\\?#]*)([^?#]*)(\?[^#]*)?(?:#.*)?$"
_OTHER = r"^([A-Za-z][A-Za-z0-9+.\-]*):([^?#]*)(\?[^#]*)?(?:#.*)?$"
_PORT = r":(\d*)$"
# Hosts that stay as they are: names whose last label begins with a letter.
_NAME = r"^(?:[a-z0-9_\-]+\.)*[a-z][a-z0-9_\-]*\.?$"
_ILLEGAL = r"[^\x21-\x7e]|[\"<>`{}^]"
_DOTS = r"(?i)/(\.|%2e){1,2}(/|$)"


def _clean(url: Column) -> Column:
    """Trim control characters and spaces, drop tabs and line breaks."""
    return F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\r\n]", "")


def _decode(part: Column) -> Column:
    """Form decoding; a stray '%' stays literal."""
    return F.url_decode(F.regexp_replace(part, r"%(?![0-9A-Fa-f]{2})", "%25"))


def _sorted_query(query: Column, drop_params: Sequence[str]) -> Column:
    """'?b=2&a=1' -> 'a=1&b=2' (no leading '?'), '' when no pair is left."""
    pairs = F.filter(F.split(F.substring(query, 2, 1 << 30), "&"), lambda p: p != "")
    decoded = F.transform(pairs, _pair)
    if drop_params:
        decoded = F.filter(decoded, lambda s: ~s["k"].isin(*drop_params))
    ordered = F.array_sort(decoded)
    return F.array_join(
        F.transform(ordered, lambda s: F.concat(F.url_encode(s["k"]), F.lit("="), F.url_encode(s["v"]))),
        "&",
    )


def _pair(p: Column) -> Column:
    """Sort key first: pairs compare as the text 'key,value'."""
    key = _decode(F.regexp_extract(p, r"^[^=]*", 0))
    value = _decode(F.regexp_extract(p, r"^[^=]*=(.*)$", 1))
    return F.struct(F.concat(key, F.lit(","), value).alias("sort"), key.alias("k"), value.alias("v"))


def _resolve_dots(path: Column) -> Column:
    """'/a/./b/../c' -> '/a/c'; a dot segment at the end leaves a trailing slash."""
    segments = F.split(F.substring(path, 2, 1 << 30), "/")
    one = F.lit(r"^(?i)(\.|%2e)$")
    two = F.lit(r"^(?i)(\.|%2e){2}$")
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(F.regexp_like(s, two), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(F.regexp_like(s, one), acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    tail = F.when(F.regexp_like(path, F.lit(r"(?i)/(\.|%2e){1,2}$")) & (F.size(kept) > 0), F.lit("/")).otherwise("")
    return F.concat(F.lit("/"), F.array_join(kept, "/"), tail)


def _encode_path(path: Column) -> Column:
    return F.array_join(
        F.transform(
            F.split(path, ""),
            lambda c: F.when(
                F.regexp_like(c, F.lit(_ILLEGAL)), F.regexp_replace(F.url_encode(c), r"\+", "%20")
            ).otherwise(c),
        ),
        "",
    )


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value once, so that a long expression does not repeat its computation."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _split(clean: Column) -> Column:
    """struct(scheme, userinfo, host, port, path, query) of a hierarchical web URL; host is NULL when it is none."""
    hostport = F.regexp_replace(F.regexp_extract(clean, _SPECIAL, 2), r"^.*@", "")
    return F.struct(
        F.lower(F.regexp_extract(clean, _SPECIAL, 1)).alias("scheme"),
        F.regexp_extract(F.regexp_extract(clean, _SPECIAL, 2), r"^.*@", 0).alias("userinfo"),
        _let(F.lower(F.regexp_replace(hostport, _PORT, "")), lambda h: F.when(h.rlike(_NAME), h).otherwise(parsed_host(h))).alias("host"),
        # A failing cast is expensive, so empty and over-long ports never reach it.
        _let(
            F.regexp_extract(hostport, _PORT, 1),
            lambda t: F.when(t == "", F.lit(None).cast("int"))
            .when(F.length(t) > 9, F.lit(65536))
            .otherwise(t.cast("int")),
        ).alias("port"),
        F.regexp_replace(F.regexp_extract(clean, _SPECIAL, 3), r"\\", "/").alias("path"),
        F.regexp_extract(clean, _SPECIAL, 4).alias("query"),
    )


def _accepted(p: Column) -> Column:
    """True where the split parts form a valid web URL."""
    return p["host"].isNotNull() & (F.coalesce(p["port"], F.lit(0)) <= 65535)


def _is_other(clean: Column) -> Column:
    return F.regexp_like(clean, F.lit(_OTHER)) & ~F.regexp_like(clean, F.lit(r"^(?i)(https?|wss?|ftp):"))


def is_url(url: Column | str) -> Column:
    """True where a URL parser would accept the text."""
    return _is_url_of(url) if isinstance(url, str) else _is_url(url)


def _is_url(url: Column) -> Column:
    return F.coalesce(_let(_clean(url), lambda c: _is_other(c) | _let(_split(c), _accepted)), F.lit(False))


@functools.cache
def _is_url_of(name: str) -> Column:
    return _is_url(F.col(name))


def _web(p: Column, drop_params: Sequence[str]) -> Column:
    number = p["port"]
    default_port = (
        (p["scheme"].isin("http", "ws") & (number == 80))
        | (p["scheme"].isin("https", "wss") & (number == 443))
        | ((p["scheme"] == "ftp") & (number == 21))
    )
    port = F.when(number.isNull() | default_port, F.lit("")).otherwise(F.concat(F.lit(":"), number.cast("string")))

    def resolved(path: Column) -> Column:
        return F.when(F.regexp_like(path, F.lit(_DOTS)), _resolve_dots(path)).otherwise(path)

    def encoded(path: Column) -> Column:
        return F.when(F.regexp_like(path, F.lit(_ILLEGAL)), _encode_path(path)).otherwise(path)

    path = _let(_let(F.when(p["path"] == "", F.lit("/")).otherwise(p["path"]), resolved), encoded)
    query = F.when(F.length(p["query"]) > 1, _sorted_query(p["query"], drop_params)).otherwise(F.lit(""))

    def build(t: Column) -> Column:
        bare = (t["query"] == "") & t["path"].endswith("/") & (t["path"] != "/")
        return F.concat(
            p["scheme"],
            F.lit("://"),
            p["userinfo"],
            p["host"],
            port,
            F.when(bare, F.regexp_replace(t["path"], "/$", "")).otherwise(t["path"]),
            F.when(t["query"] != "", F.concat(F.lit("?"), t["query"])).otherwise(F.lit("")),
        )

    return _let(F.struct(path.alias("path"), query.alias("query")), build)


def _opaque(clean: Column, drop_params: Sequence[str]) -> Column:
    raw = F.regexp_extract(clean, _OTHER, 3)
    query = F.when(F.length(raw) > 1, _sorted_query(raw, drop_params)).otherwise(F.lit(""))
    body = F.regexp_extract(clean, _OTHER, 2)
    return F.concat(
        F.lower(F.regexp_extract(clean, _OTHER, 1)),
        F.lit(":"),
        _let(
            query,
            lambda q: F.when(q == "", F.regexp_replace(body, "(?<=[^/])/$", "")).otherwise(
                F.concat(body, F.lit("?"), q)
            ),
        ),
    )


def normalize_url(url: Column | str, drop_params: Sequence[str] = ()) -> Column:
    """Canonical form of a URL; text that is no URL comes back unchanged.

    `drop_params` removes named query parameters (tracking tags); nothing is removed by default.
    The expression is long: for a column name it is built once a process.
    """
    return _normalized_of(url, tuple(drop_params)) if isinstance(url, str) else _normalized(url, drop_params)


def _normalized(url: Column, drop_params: Sequence[str]) -> Column:
    def body(clean: Column) -> Column:
        other = F.when(_is_other(clean), _opaque(clean, drop_params)).otherwise(url)
        return _let(_split(clean), lambda p: F.when(_accepted(p), _web(p, drop_params)).otherwise(other))

    return _let(_clean(url), body)


@functools.cache
def _normalized_of(name: str, drop_params: tuple[str, ...]) -> Column:
    return _normalized(F.col(name), drop_params)


def domain(url: Column | str) -> Column:
    """Host of a URL, 'unknown' where it cannot be parsed."""
    url = F.col(url) if isinstance(url, str) else url
    host = _let(_split(_clean(url)), lambda p: F.when(_accepted(p), p["host"]))
    return F.coalesce(host, F.lit("unknown"))


def extract_url(text: Column | str) -> Column:
    """First http(s) URL inside shared text, NULL when there is none."""
    text = F.col(text) if isinstance(text, str) else text
    # Fixed pattern: the run stops at white space and at characters no URL may hold.
    pattern = r"(?i)https?://[^\s<>\"{}|\\^`\[\]]+"
    return F.nullif(F.regexp_extract(text, pattern, 0), F.lit(""))


def truncate_url(url: Column | str, limit: int) -> Column:
    """First `limit` characters, with '...' when something was cut."""
    url = F.col(url) if isinstance(url, str) else url
    return F.when(F.length(url) > limit, F.concat(F.substring(url, 1, limit), F.lit("..."))).otherwise(url)
