"""Entries are cleaned and checked once, not again for each table that is written."""

from pyspark.sql import functions as F

from updatelens.plans.ingest import ingest_feeds

RSS = "<rss><channel><item><guid>{0}</guid><title>Title {0}</title><link>{1}</link></item></channel></rss>"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_feeds_are_checked_once(spark):
    rows = [("s1", "https://a.test/r", RSS.format(1, "/x")), ("s2", "https://a.test/r", RSS.format(2, "https://")), ("s3", "https://a.test/r", "<rss>")]
    feeds = spark.createDataFrame(rows, "source_id string, feed_url string, payload string")
    sources = spark.createDataFrame([], "source_id string, validator string")
    done = ingest_feeds(feeds, sources, F.lit("2024-01-01").cast("timestamp"))
    assert done.items.count() == 2 and done.rejected_feeds.count() == 1 and done.bad_items.count() == 0
    assert "regexp_replace" not in optimized(done.bad_items) and "regexp_replace" not in optimized(done.items)
