from datetime import datetime

from conftest import rows
from pyspark.sql import functions as F

from updatelens.operators import briefs as B
from updatelens.operators import features as X
from updatelens.operators import quality as Q
from updatelens.plans.ingest import ingest_feeds
from updatelens.session import scratch_dir
from updatelens.sources import articles, feeds, messages, sinks

RSS = """<?xml version="1.0"?><RSS version="2.0" xmlns:content="http://purl.org/rss/1.0/modules/content/"><Channel><title>c</title>
<item><guid>one</guid><title>  A durable   first update </title><link>https://example.test/one</link>
<description>&lt;b&gt;Bold&lt;/b&gt; words</description><pubDate>Sun, 13 Sep 2026 12:00:00 -0300</pubDate></item>
<item><guid>two</guid><title>Second</title><link>/updates/two</link><content:encoded>Long form</content:encoded></item>
<item><guid>three</guid></item></Channel></RSS>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><id>f</id><title>t</title><updated>2026-09-13T00:00:00Z</updated>
<entry><id>e1</id><title>Entry</title><link rel="self" href="/self"/><link rel="alternate" href="/alt"/>
<summary>Short</summary><content>Whole</content><updated>2026-09-13T10:00:00Z</updated></entry></feed>"""
BROKEN = ["<rss><channel>", "<rss version='2.0'></rss>", "<html/>", "<rss><channel/><channel/></rss>", None,
          "<!DOCTYPE rss [<!ENTITY a 'b'>]><rss><channel/></rss>"]


def table(spark, payloads):
    return spark.createDataFrame(
        [(f"s{i}", "https://example.test/rss", p) for i, p in enumerate(payloads)],
        "source_id string, feed_url string, payload string",
    )


def test_feed_entries(spark):
    items, rejects = feeds.parse_feeds(table(spark, [RSS, ATOM, *BROKEN]))
    got = {(r.source_id, r.external_id): r for r in items.collect()}
    assert set(got) == {("s0", "one"), ("s0", "two"), ("s1", "e1")}
    one, two, atom = got["s0", "one"], got["s0", "two"], got["s1", "e1"]
    assert (one.title, one.excerpt, one.url) == ("A durable first update", "Bold words", "https://example.test/one")
    assert one.published_at == datetime(2026, 9, 13, 15)
    assert (two.url, two.excerpt, two.published_at) == ("https://example.test/updates/two", "Long form", None)
    assert (atom.url, atom.excerpt, atom.published_at) == ("https://example.test/alt", "Short", datetime(2026, 9, 13, 10))
    assert rows(rejects, "source_id", "error_code") == [(f"s{i}", "malformed_feed") for i in range(2, 8)]


def test_too_large_feed(spark):
    items, rejects = feeds.parse_feeds(table(spark, [RSS]), max_bytes=100)
    assert items.count() == 0 and rows(rejects, "error_code") == [("response_too_large",)]


def test_feed_structure(spark):
    got = rows(feeds.classify_feeds(table(spark, [RSS, ATOM, *BROKEN, ATOM.replace("<id>f</id>", "")])), "source_id", "is_supported", "reason")
    assert got == [
        ("s0", True, None), ("s1", True, None), ("s2", True, None), ("s3", False, "missing_channel"),
        ("s4", False, "unsupported_root"), ("s5", True, None), ("s6", False, "malformed_xml"), ("s7", False, "malformed_xml"),
        ("s8", False, "missing_id"),
    ]


def test_ingest_twice(spark):
    source = spark.createDataFrame([("s0", None), ("s1", None)], "source_id string, validator string")
    now = F.lit("2026-09-14 00:00:00").cast("timestamp")
    first = ingest_feeds(table(spark, [RSS, ATOM]), source, now)
    assert first.items.count() == 3
    assert rows(first.runs, "source_id", "retrieved_count", "new_count", "status") == [("s0", 2, 2, "Succeeded"), ("s1", 1, 1, "Succeeded")]
    later = F.lit("2026-09-15 00:00:00").cast("timestamp")
    again = ingest_feeds(table(spark, [RSS, ATOM]), source, later, first.items)
    assert again.items.count() == 0
    assert rows(again.runs, "source_id", "retrieved_count", "new_count") == [("s0", 2, 0), ("s1", 1, 0)]
    known = table(spark, [RSS, ATOM]).select("source_id", F.sha2("payload", 256).alias("validator"))
    quiet = ingest_feeds(table(spark, [RSS, ATOM]), known, later, first.items)
    assert rows(quiet.runs, "status") == [("NotModified",), ("NotModified",)]


PAGES = {
    1: ("<title>T</title><meta property='OG:Title' content=' Og '><article><h1>H</h1><p>a<p>b<script>x</script></article>", "Og", "Hab"),
    2: ("<head><title> The  title </title></head><body><nav>n</nav><main><p>main text</p></main><footer>f</footer></body>", "The title", "main text"),
    3: ("<h1>Only h1</h1><div><p>short</p></div><div><p>the longest paragraph</p><aside>no</aside></div>", "Only h1", "the longest paragraph"),
    4: ("<title>t</title><body>plain <b>body</b> &amp; more</body>", "t", "plain body & more"),
    5: ("<body>no title</body>", None, None),
    6: ("<title>t</title><body><script>only()</script></body>", None, None),
    7: ("", None, None),
}


def test_articles(spark):
    df = spark.createDataFrame([(k, "u", v[0]) for k, v in PAGES.items()], "page_id bigint, url string, html string")
    found, rejects = articles.extract_articles(df)
    assert rows(found, "page_id", "title", "text") == [(k, v[1], v[2]) for k, v in PAGES.items() if v[1]]
    assert rows(rejects, "page_id") == [(5,), (6,), (7,)]


def test_messages(spark):
    ok = '{"messageId":"m","sourceItemId":"i","correlationId":"c","occurredAtUtc":"2026-01-01T00:00:00Z","traceParent":" t "}'
    bad = {
        "not_json": ok[:20], "unknown_field": ok.replace("traceParent", "other"), "wrong_type": ok.replace("2026-01-01T00:00:00Z", "soon"),
        "missing_field": ok.replace('"messageId":"m",', ""), "trace_too_long": ok.replace(" t ", "t" * 513),
    }
    lines = spark.createDataFrame([(0, ok)] + [(i, b) for i, b in enumerate(bad.values(), 1)], "row_id int, body string")
    typed, malformed = messages.read_messages(lines)
    assert rows(typed, "row_id", "message_id", "trace_parent", "occurred_at") == [(0, "m", "t", datetime(2026, 1, 1))]
    assert rows(malformed, "row_id", "reason") == list(enumerate(bad, 1))


def test_append_is_idempotent(spark):
    path = f"{scratch_dir(spark)}/append-test"
    batch = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    for _ in range(3):
        sinks.append_if_absent(path, batch, ["k"], ["v"])
    assert rows(spark.read.parquet(path), "k", "v") == [(1, "a"), (2, "c")]


def test_custom_providers(spark):
    import pytest

    items = spark.createDataFrame([(1, "t", None)], "item_id int, title string, excerpt string")
    interests = spark.createDataFrame([("i", "t", "High", True)], "interest_id string, name string, priority string, is_active boolean")
    assert X.analyze(items, interests).first().interest_matches[0].strength == 1.0
    with pytest.raises(ValueError):
        X.analyze(items, interests, lambda i, n: i)
    with pytest.raises(ValueError):
        B.compose(items, lambda i: i)
    made = spark.createDataFrame(
        [(1, "i", 0.5, 0), (1, "i", 0.9, 1), (1, "x", 0.5, 2), (2, "i", 1.5, 0)],
        "item_id int, interest_id string, strength double, position int",
    )
    assert rows(Q.validate_matches(made, interests), "item_id", "strength") == [(1, 0.5)]
