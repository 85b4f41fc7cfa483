"""Hosts of URLs: numeric forms, IPv6 and bootstring labels."""

import ipaddress
import random

from pyspark.sql import functions as F

from tidemark.functions import hosts, urls

# Sample strings of RFC 3492, section 7.1 (their host forms are in lower case).
SAMPLES = [
    ("ليهمابتكلموشعربي؟", "egbpdaj6bu4bxfgehfvwxn"),
    ("他们为什么不说中文", "ihqwcrb4cv8a8dqg056pqjye"),
    ("他們爲什麽不說中文", "ihqwctvzc91f659drss3x8bo0yb"),
    ("למההםפשוטלאמדבריםעברית", "4dbcagdahymbxekheh6e0a7fei0b"),
    ("почемужеонинеговорятпорусски", "b1abfaaepdrnnbgefbadotcwatmq2g4l"),
    ("3年b組金八先生", "3b-ww4c5e180e575a65lsy2b"),
    ("安室奈美恵-with-super-monkeys", "-with-super-monkeys-pc58ag80a8qai00g7n9n"),
    ("そのスピードで", "d9juau41awczczp"),
]
HOSTS = [
    ("0x7f.1", "127.0.0.1"), ("2130706433", "127.0.0.1"), ("0x7f000001", "127.0.0.1"), ("017700000001", "127.0.0.1"), ("1.2.3", "1.2.0.3"), ("1.2.3.", "1.2.0.3"),
    ("127.0.0.0x1", "127.0.0.1"), ("0x", "0.0.0.0"), ("256.1", None), ("1.2.3.4.5", None), ("08", None), ("1.0x100", "1.0.1.0"), ("4294967296", None), ("4294967295", "255.255.255.255"),
    ("a.1", None), ("1.a", "1.a"), ("1..2", None), ("99999999999999999999", None), ("[::1]", "[::1]"), ("[0:0:0:0:0:0:0:1]", "[::1]"), ("[1:0:0:2:0:0:0:3]", "[1:0:0:2::3]"),
    ("[::ffff:1.2.3.4]", "[::ffff:102:304]"), ("[1::2::3]", None), ("[::]", "[::]"), ("[12345::]", None), ("[::1.2.3.400]", None), ("[::01.2.3.4]", None), ("[1:2:3:4:5:6:7::8]", None),
    ("[1:0:0:2:3:0:0:4]", "[1::2:3:0:0:4]"), ("[]", None), ("[:]", None), ("[1:2]", None), ("münchen.de", "xn--mnchen-3ya.de"), ("straße.de", "xn--strae-oqa.de"), ("例え。jp", "xn--r8jz45g.jp"),
    ("ｅｘample.com", "example.com"), ("a%41b.com", "aab.com"), ("bücher%2ecom", "xn--bcher-kva.com"), ("ex ample.com", None), ("a%20b", None), ("a_b.com", "a_b.com"), ("so­ft.com", "soft.com"), ("", None),
]
URLS = [
    ("http://0x7f.1:80/a/", "http://127.0.0.1/a"), ("http://2130706433", "http://127.0.0.1/"), ("https://[0:0:0:0:0:0:0:1]:443/x", "https://[::1]/x"),
    ("https://Bücher.example/ä?q=ü", "https://xn--bcher-kva.example/%C3%A4?q=%C3%BC"), ("https://u@MÜNCHEN.de:8443", "https://u@xn--mnchen-3ya.de:8443/"), ("http://1.2.3.4.5/", "http://1.2.3.4.5/"),
]


def test_hosts(spark):
    df = spark.createDataFrame([(h,) for h, _ in HOSTS], "h string")
    assert [tuple(r) for r in df.select("h", hosts.parsed_host(F.col("h"))).collect()] == HOSTS


def test_bootstring(spark):
    rng = random.Random(3)
    ranges = ((97, 123), (0xE0, 0xF7), (0x430, 0x44F), (0x4E00, 0x5000), (0x1F600, 0x1F640))
    labels = ["".join(chr(rng.randrange(*rng.choice(ranges))) for _ in range(rng.randrange(1, 60))) for _ in range(800)]
    labels = [s for s in labels if not s.isascii()] + ["é" * 59, "a" * 50 + "\U0010ffff", "\U0010ffff" * 10]
    df = spark.createDataFrame([(s,) for s in labels + [s for s, _ in SAMPLES]], "h string")
    got = {r.h: r.p for r in df.select("h", hosts.punycode(F.col("h")).alias("p")).collect()}
    assert {s: got[s] for s, _ in SAMPLES} == dict(SAMPLES)
    assert {s: got[s] for s in labels} == {s: s.encode("punycode").decode() for s in labels}


def test_addresses_are_those_of_the_standard_library(spark):
    rng = random.Random(9)
    six = [":".join(f"{rng.choice((0, 0, 1, rng.randrange(65536))):x}" for _ in range(8)) for _ in range(400)]
    df = spark.createDataFrame([(f"[{h}]",) for h in six], "h string")
    want = [f"[{ipaddress.IPv6Address(h).compressed}]" for h in six]
    assert [r.p for r in df.select(hosts.ipv6(F.col("h")).alias("p")).collect()] == [w for w in want]
    four = [rng.randrange(1 << 32) for _ in range(200)]
    rows = [(f.format(n), str(ipaddress.IPv4Address(n))) for n in four for f in ("{}", "0x{:x}", "0{:o}")]
    df = spark.createDataFrame(rows, "h string, want string")
    assert df.filter(~hosts.ipv4(F.col("h")).eqNullSafe(F.col("want"))).count() == 0


def test_urls(spark):
    df = spark.createDataFrame([(u,) for u, _ in URLS], "u string")
    got = df.select("u", urls.normalize_url("u").alias("n"))
    assert [tuple(r) for r in got.collect()] == URLS
    assert got.filter(urls.normalize_url("n") != F.col("n")).count() == 0
    assert [r.d for r in df.select(urls.domain("u").alias("d")).collect()] == ["127.0.0.1", "127.0.0.1", "[::1]", "xn--bcher-kva.example", "xn--mnchen-3ya.de", "unknown"]
