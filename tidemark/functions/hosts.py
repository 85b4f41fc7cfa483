"""Hosts of web URLs as native column expressions: numeric forms, IPv6, and IDN labels.

The rules follow the WHATWG host parser. An ASCII host whose last label is a number is an IPv4
address in one to four parts, each decimal, octal (0...) or hexadecimal (0x...). A bracketed host
is an IPv6 address, written in its shortest form. Labels with letters outside ASCII are put in
lower case and encoded by bootstring (RFC 3492). Compatibility forms are mapped only for the
full-width letters and the three other full stops; hosts are expected in composed form (NFC).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The parameters of RFC 3492.
_BASE, _TMIN, _TMAX, _SKEW, _DAMP, _BIAS, _FIRST = 36, 1, 26, 38, 700, 72, 128
_DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"
# Digits of one delta and steps of one bias: a label of 63 characters needs no more.
_MOST_DIGITS, _MOST_STEPS = 10, 6
# Full stops and full-width forms that stand for ASCII characters.
_WIDE = "。．｡" + "".join(chr(0xFF01 + i) for i in range(94))
_PLAIN = "..." + "".join(chr(0x21 + i) for i in range(94))
# Soft hyphen and zero-width characters have no effect in a host.
_NOTHING = "[­​⁠﻿]"

_BAD_HOST = r"[\x00-\x20\x7f<>\[\]^|%\\/?#@:]"
_NUMBER = r"^(?:.*\.)?(?:[0-9]+|0x[0-9a-f]*)\.?$"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _part(p: Column) -> Column:
    """Value of one part of a number host, NULL when it is none or far too large."""
    bare = F.regexp_replace(p, r"^0x0*|^0+(?=.)", "")
    base = F.when(p.rlike("^0x[0-9a-f]*$"), 16).when(p.rlike("^0[0-7]+$"), 8).when(p.rlike("^(0|[1-9][0-9]*)$"), 10)

    def value(b: Column) -> Column:
        return (
            F.when((base == 16) & (F.length(b) <= 8), F.conv(F.when(b == "", "0").otherwise(b), 16, 10))
            .when((base == 8) & (F.length(b) <= 11), F.conv(b, 8, 10))
            .when((base == 10) & (F.length(b) <= 10), b)
            .cast("long")
        )

    return _let(bare, value)


def ipv4(host: Column) -> Column:
    """Dotted form of a host that ends in a number; NULL when it is no address."""

    def whole(v: Column) -> Column:
        n = F.size(v)
        fits = F.forall(v, lambda x: x.isNotNull()) & (n <= 4) & F.forall(F.slice(v, 1, n - 1), lambda x: x <= 255)
        last = F.element_at(v, -1)
        # What the last of n parts may hold: all bytes that the others leave.
        room = F.get(F.array(*(F.lit(1 << (8 * (4 - i))).cast("long") for i in range(4))), n - 1)
        fits &= last < room
        head = F.aggregate(F.slice(v, 1, n - 1), F.lit(0).cast("long"), lambda acc, x: acc * 256 + x)
        number = head * room + last
        dotted = _let(number, lambda x: F.concat_ws(".", *(F.shiftright(x, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0))))
        return F.when(fits, dotted)

    return _let(F.transform(F.split(F.regexp_replace(host, r"\.$", ""), r"\."), _part), whole)


def ipv6(host: Column) -> Column:
    """Shortest form of a bracketed address; NULL when it is no address."""
    inner = F.regexp_extract(host, r"^\[([0-9a-f:.]+)\]$", 1)

    def pieces(text: Column) -> Column:
        return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ":"))

    def built(t: Column) -> Column:
        halves = F.split(t, "::", -1)
        left, right = pieces(F.get(halves, F.lit(0))), pieces(F.coalesce(F.get(halves, F.lit(1)), F.lit("")))
        gap = F.size(halves) == 2
        n = F.size(left) + F.size(right)
        good = F.forall(F.concat(left, right), lambda p: p.rlike("^[0-9a-f]{1,4}$")) & (F.size(halves) <= 2) & F.when(gap, n <= 7).otherwise(n == 8)
        zeros = F.when(gap & (n < 8), F.array_repeat(F.lit("0"), 8 - n)).otherwise(F.array().cast("array<string>"))
        short = F.transform(F.concat(left, zeros, right), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
        return F.when(good, _let(F.array_join(short, ":"), _shortest))

    # A dotted tail is two pieces.
    v4 = r"(^|.*:)(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$"
    octets = [F.regexp_extract(inner, v4, i).cast("int") for i in range(2, 6)]
    pair = [F.lower(F.hex((octets[i] * 256 + octets[i + 1]).cast("long"))) for i in (0, 2)]
    in_range = F.forall(F.array(*octets), lambda o: o <= 255) & ~inner.rlike(r"[:.]0\d+(\.|$)")
    dotted = F.when(in_range, F.concat(F.regexp_extract(inner, v4, 1), pair[0], F.lit(":"), pair[1]))
    text = F.when(~F.contains(inner, F.lit(".")), inner).when(inner.rlike(v4), dotted)
    return _let(text, lambda t: F.when(t != "", F.concat(F.lit("["), _let(t, built), F.lit("]"))))


def _shortest(eight: Column) -> Column:
    """Eight pieces with their longest run of two or more zeros as '::', the first of equal runs."""
    out = eight
    for n in range(2, 9):
        run = r"(^|:)" + ":".join(["0"] * n) + r"(:|$)"
        # A longer run replaces what a shorter one gave.
        out = F.when(eight.rlike(run), F.regexp_replace(F.regexp_replace(eight, f"^(.*?){run}", "$1::"), ":::+", "::")).otherwise(out)
    return out


def _digits(delta: Column, bias: Column) -> Column:
    """Text of a generalised variable-length integer."""
    start = F.struct(F.lit("").alias("out"), delta.alias("q"), F.lit(False).alias("done"))

    def step(acc: Column, k: Column) -> Column:
        t = F.least(F.greatest(k * _BASE - bias, F.lit(_TMIN)), F.lit(_TMAX))
        last = acc["q"] < t
        digit = F.when(last, acc["q"]).otherwise(t + (acc["q"] - t) % (_BASE - t))
        shown = F.substr(F.lit(_DIGITS), digit + 1, F.lit(1))
        return F.when(acc["done"], acc).otherwise(
            F.struct(F.concat(acc["out"], shown).alias("out"), F.when(last, F.lit(0)).otherwise(F.floor((acc["q"] - t) / (_BASE - t))).cast("int").alias("q"), last.alias("done"))
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(_MOST_DIGITS)), start, step, lambda acc: acc["out"])


def _adapted(delta: Column, points: Column, first: Column) -> Column:
    """The bias after a delta."""
    halved = F.when(first, F.floor(delta / _DAMP)).otherwise(F.floor(delta / 2)).cast("int")
    most = (_BASE - _TMIN) * _TMAX // 2

    def step(acc: Column, _: Column) -> Column:
        more = acc["d"] > most
        return F.struct(F.when(more, F.floor(acc["d"] / (_BASE - _TMIN))).otherwise(acc["d"]).cast("int").alias("d"), (acc["k"] + F.when(more, _BASE).otherwise(0)).alias("k"))

    return _let(
        halved,
        lambda d: F.aggregate(
            F.sequence(F.lit(1), F.lit(_MOST_STEPS)),
            F.struct((d + F.floor(d / points)).cast("int").alias("d"), F.lit(0).alias("k")),
            step,
            lambda acc: (acc["k"] + F.floor((_BASE - _TMIN + 1) * acc["d"] / (acc["d"] + _SKEW))).cast("int"),
        ),
    )


def punycode(label: Column) -> Column:
    """Bootstring of one label, without prefix.

    The characters outside ASCII are inserted in the order of their code points, equal ones from
    the left. A character's place in the text built so far is the number of characters before it
    with a code point that is not larger.
    """
    codes = F.transform(F.split(label, ""), lambda c: F.ascii(c))

    def encode(c: Column) -> Column:
        basic = F.filter(c, lambda x: x < _FIRST)
        ordered = F.array_sort(F.filter(F.transform(c, lambda x, i: F.struct(x.alias("c"), i.alias("i"))), lambda s: s["c"] >= _FIRST))
        head = F.regexp_replace(label, r"[^\x00-\x7f]", "")
        start = F.struct(
            F.when(F.size(basic) > 0, F.concat(head, F.lit("-"))).otherwise("").alias("out"), F.lit(_FIRST).alias("n"), F.lit(0).alias("i"), F.size(basic).alias("h"), F.lit(_BIAS).alias("bias")
        )

        def insert(acc: Column, s: Column) -> Column:
            place = F.size(F.filter(F.slice(c, F.lit(1), s["i"]), lambda x: x <= s["c"]))

            def put(t: Column) -> Column:
                first = acc["h"] == F.size(basic)
                bias = _adapted(t["delta"], acc["h"] + 1, first)
                return F.struct(
                    F.concat(acc["out"], _digits(t["delta"], acc["bias"])).alias("out"), s["c"].alias("n"), (t["place"] + 1).alias("i"), (acc["h"] + 1).alias("h"), bias.alias("bias")
                )

            return _let(F.struct(((s["c"] - acc["n"]) * (acc["h"] + 1) + place - acc["i"]).alias("delta"), place.alias("place")), put)

        return F.aggregate(ordered, start, insert, lambda acc: acc["out"])

    return _let(codes, encode)


def _idn(host: Column) -> Column:
    plain = F.lower(F.regexp_replace(F.translate(host, _WIDE, _PLAIN), _NOTHING, ""))

    def label(p: Column) -> Column:
        return F.when(p.rlike(r"^[\x00-\x7f]*$"), p).otherwise(F.concat(F.lit("xn--"), punycode(p)))

    return _let(plain, lambda h: F.array_join(F.transform(F.split(h, r"\."), label), "."))


def parsed_host(host: Column) -> Column:
    """The host as a URL parser writes it, NULL when the parser refuses it.

    `host` is in lower case and has no port or user part.
    """

    def name(h: Column) -> Column:
        return F.when((h == "") | h.rlike(_BAD_HOST), F.lit(None).cast("string")).when(h.rlike(_NUMBER), ipv4(h)).otherwise(h)

    percent = F.url_decode(F.regexp_replace(F.regexp_replace(host, r"%(?![0-9A-Fa-f]{2})", "%25"), r"\+", "%2B"))
    decoded = F.when(F.contains(host, F.lit("%")), percent).otherwise(host)
    web = _let(decoded, lambda d: _let(F.when(d.rlike(r"^[\x00-\x7f]*$"), F.lower(d)).otherwise(_idn(d)), name))
    return F.when(host.startswith("["), ipv6(host)).otherwise(web)
