import pytest
from pyspark.sql import functions as F

from tidemark.functions import ids, payload, urls

GOLDEN = [
    ("https://example.com/blog/rust-async-programming", "https://example.com/blog/rust-async-programming", "link:5700e10f9e44e268"),
    ("https://news.ycombinator.com/item?id=12345", "https://news.ycombinator.com/item?id=12345", "link:a56a0a0654b80249"),
    ("https://kafka.apache.org/documentation/#gettingStarted", "https://kafka.apache.org/documentation", "link:bb1d9a6c1eed204d"),
    ("https://blog.cloudflare.com/workers-ai/", "https://blog.cloudflare.com/workers-ai", "link:cba3d579907c4c8a"),
    ("HTTP://Example.COM:80/page", "http://example.com/page", "link:b2b930c1becd9bf7"),
    ("https://example.com", "https://example.com/", "link:0f115db062b7c0dd"),
    ("https://e.com/p/?b=2&a=1#x", "https://e.com/p/?a=1&b=2", "link:28a0cec51f2e524b"),
    ("https://e.com/p?flag&q=a b", "https://e.com/p?flag=&q=a+b", "link:66b8393bc05a2648"),
    ("not a url", "not a url", "link:d8b5bf9b9fd4760c"),
]
MORE = [
    ("https://e.com/a/../b/./c/", "https://e.com/b/c"),
    ("https://e.com/a/..", "https://e.com/"),
    ("https://e.com/é ü😀", "https://e.com/%C3%A9%20%C3%BC%F0%9F%98%80"),
    ("https://e.com:8443/x?%zz=1&a=%41", "https://e.com:8443/x?%25zz=1&a=A"),
    ("https://u:p@E.com/", "https://u:p@e.com/"),
    ("https://e.com:99999/x", "https://e.com:99999/x"),
    ("https://e.com/?", "https://e.com/"),
    ("  https://e.com/x\n", "https://e.com/x"),
    ("http://", "http://"),
    ("mailto:Me@x.com", "mailto:Me@x.com"),
    ("https://[::1]:443/a", "https://[::1]/a"),
    (None, None),
]


def test_golden_urls(spark):
    df = spark.createDataFrame([(g[0],) for g in GOLDEN], "u string")
    rows = df.select("u", urls.normalize_url("u").alias("n"), ids.link_subject_id("u").alias("i")).collect()
    assert [tuple(r) for r in rows] == GOLDEN


def test_more_urls(spark):
    df = spark.createDataFrame([(m[0],) for m in MORE], "u string")
    assert [r.n for r in df.select(urls.normalize_url("u").alias("n")).collect()] == [m[1] for m in MORE]


def test_normalize_is_idempotent(spark):
    df = spark.createDataFrame([(m[0],) for m in MORE + [g[:2] for g in GOLDEN]], "u string").select(urls.normalize_url("u").alias("n"))
    assert df.filter(~F.col("n").eqNullSafe(urls.normalize_url("n"))).count() == 0


def test_ids(spark):
    row = spark.range(1).select(
        ids.sensor_subject_id(F.lit("Living  Room")).alias("s"),
        ids.todo_subject_id(F.lit("todoist"), F.lit("12345")).alias("t"),
        ids.parse_subject_id(F.lit("gcal:primary:abc")).alias("a"),
        ids.parse_subject_id(F.lit("abc")).alias("b"),
        ids.parse_calendar_subject_id(F.lit("gcal:primary:a:b")).alias("c"),
    ).first()
    assert (row.s, row.t) == ("sensor:living_room", "todoist:12345")
    assert tuple(row.a) == ("gcal", "primary:abc") and tuple(row.b) == ("unknown", "abc")
    assert tuple(row.c) == ("primary", "a:b")


@pytest.mark.parametrize(
    "text,value,fragment",
    [('{"a":"x"}', "x", None), ('{"a":{"b":1}}', None, '{"b":1}'), ('{"a":[1]}', None, "[1]"), ('{"b":1}', None, None), ("{", None, None), ('{"a":"[x"}', "[x", None)],
)
def test_json_access(spark, text, value, fragment):
    row = spark.range(1).select(
        payload.json_value(F.lit(text), "$.a").alias("v"), payload.json_fragment(F.lit(text), "$.a").alias("f")
    ).first()
    assert (row.v, row.f) == (value, fragment)


def test_unwrap_double_encoded_payload(spark):
    row = spark.range(1).select(payload.unwrap_payload(F.lit('"{\\"url\\": \\"u\\"}"')).alias("p")).first()
    assert row.p == '{"url": "u"}'


def test_extract_url(spark):
    texts = [("see https://a.b/c?d=1 now", "https://a.b/c?d=1"), ("HTTP://X.y<z>", "HTTP://X.y"), ("nothing", None)]
    df = spark.createDataFrame([(t,) for t, _ in texts], "t string")
    assert [r.u for r in df.select(urls.extract_url("t").alias("u")).collect()] == [u for _, u in texts]
