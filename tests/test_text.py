import pytest
from conftest import rows
from pyspark.sql import functions as F

from updatelens.functions import links as L
from updatelens.functions import text as T
from updatelens.functions import values as V


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "v string").select(fn(F.col("v")).alias("x")).first().x


@pytest.mark.parametrize(
    "text,tokens",
    [
        ("Kubernetes 1.30: release-notes!", ["kubernetes", "1", "30", "release", "notes"]),
        ("ＡＢ", ["ab"]),
        ("Straße snake_case", ["strasse", "snake", "case"]),
        ("...", []),
        ("ﬁn Ⅳ ½", ["fin", "iv", "1", "2"]),
        ("ÉCOLE", ["école"]),
    ],
)
def test_tokens(spark, text, tokens):
    assert one(spark, text, T.tokenize) == tokens


def test_pairs(spark):
    assert one(spark, "a b c", T.bigrams) == ["a b", "b c"]
    assert one(spark, "a", T.bigrams) == []


@pytest.mark.parametrize(
    "text,plain",
    [
        ("  A durable   first update ", "A durable first update"),
        ("&lt;b&gt;bold&lt;/b&gt; text", "bold text"),
        ("a < b and c > d", "a < b and c d"),
        ("1 <2> 3", "1 <2 3"),
        ("open <em never closed", "open"),
        ("x &amp;amp; &#65;&#x42; &nope; &copy", "x &amp; AB &nope; &copy"),
        ("<!-- c -->kept<?pi?>", "kept"),
        ("</p>end</ p>", "end</ p"),
        ("   ", None),
        ("<b></b>", ""),
    ],
)
def test_bounded_text(spark, text, plain):
    assert one(spark, text, lambda c: T.bounded_text(c, 100)) == plain


def test_text_is_cut(spark):
    assert one(spark, "abcdef", lambda c: T.bounded_text(c, 3)) == "abc"


def test_upper_case_keeps_sharp_s(spark):
    assert one(spark, " straße  x ", T.normalize_title) == "STRAßE X"


@pytest.mark.parametrize(
    "url,canonical",
    [
        ("HTTPS://Example.TEST:443/Path?Q=1#frag", "https://example.test/Path?Q=1"),
        ("http://example.test", "http://example.test/"),
        ("http://example.test:8080/a", "http://example.test:8080/a"),
        ("http://example.test/a b", "http://example.test/a%20b"),
        ("http://example.test/é", "http://example.test/%C3%A9"),
        ("ftp://example.test/", None),
        ("/relative", None),
        ("http://example.test/" + "a" * 2048, None),
        ("http://example.test:99999/", None),
    ],
)
def test_canonical_url(spark, url, canonical):
    assert one(spark, url, L.canonical_url) == canonical


@pytest.mark.parametrize(
    "url,ok",
    [
        ("https://example.test/rss", True), ("https://me:x@example.test/rss", False), ("http://localhost/rss", False),
        ("http://a.localhost./", False), ("http://10.1.2.3/", False), ("http://192.0.66.1/", False), ("http://8.8.8.8/", True),
        ("http://[::1]/", False), ("http://[2606:4700::1]/", True), ("http://[2001:db8::1]/", False),
        ("http://[::ffff:10.0.0.1]/", False), ("https://example.test/" + "a" * 850, False),
    ],
)
def test_feed_url(spark, url, ok):
    assert (one(spark, url, L.canonical_feed_url) is not None) == ok


@pytest.mark.parametrize(
    "host,public",
    [
        ("192.0.66.1", True), ("192.0.2.9", False), ("100.64.0.1", False), ("100.128.0.1", True), ("172.32.0.1", True),
        ("168.63.129.16", False), ("239.1.1.1", False), ("example.test", True), ("LOCALHOST", False), ("fe80::1", False),
        ("2606:4700::1", True), ("::ffff:8.8.8.8", True), (None, False),
    ],
)
def test_public_host(spark, host, public):
    assert one(spark, host, L.is_public_host) == public


@pytest.mark.parametrize(
    "ref,url",
    [
        ("/updates/two", "https://example.test/updates/two"), ("three", "https://example.test/feeds/three"),
        ("//other.test/x", "https://other.test/x"), ("http://other.test/y", "http://other.test/y"),
        ("mailto:a@b.c", None), ("javascript:void(0)", None), ("  ", None), (None, None),
    ],
)
def test_resolve_url(spark, ref, url):
    assert one(spark, ref, lambda c: L.resolve_url(F.lit("https://example.test/feeds/rss"), c)) == url


@pytest.mark.parametrize(
    "text,utc",
    [
        ("Sun, 13 Sep 2026 12:00:00 -0300", "2026-09-13 15:00:00"), ("2026-09-13T12:00:00Z", "2026-09-13 12:00:00"),
        ("2026-09-13T12:00:00.250+02:00", "2026-09-13 10:00:00.25"), ("13 Sep 2026 12:00 GMT", "2026-09-13 12:00:00"),
        ("2026-09-13 12:00:00", "2026-09-13 12:00:00"), ("Wednesday, 9 Sep 2026 01:02:03 GMT", "2026-09-09 01:02:03"),
        ("soon", None), ("", None),
        ("Sun, 13 Sep 26 12:00:00 GMT", "2026-09-13 12:00:00"),
        ("13 Sep 74 12:00", "1974-09-13 12:00:00"),
        ("2026-09-13T12:00:00.1234567Z", "2026-09-13 12:00:00.123456"),
        ("13 September 2026 12:00", "2026-09-13 12:00:00"),
        ("1 May 2026 12:00:30 +0200", "2026-05-01 10:00:30"),
    ],
)
def test_parse_utc(spark, text, utc):
    assert one(spark, text, lambda c: V.parse_utc(c).cast("string")) == utc


def test_feedback_words(spark):
    df = spark.createDataFrame([(" Relevant ",), ("NOTRELEVANT",), ("maybe",), (None,)], "v string")
    assert [r.x for r in df.select(V.parse_feedback(F.col("v")).alias("x")).collect()] == ["Relevant", "NotRelevant", None, None]


def test_names_and_content(spark):
    assert one(spark, " Straße ", T.normalize_name) == "STRAßE"
    assert one(spark, "x" * 201, T.normalize_name) is None
    df = spark.createDataFrame([("t", None, "c")], "a string, b string, c string")
    assert rows(df.select(T.bound_content("a", "b", "c", budget=2).alias("x")), "x") == [("t\n",)]
