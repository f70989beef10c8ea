"""Pages handed in by their address."""

from datetime import datetime, timedelta

from conftest import rows
from pyspark.sql import functions as F

from updatelens.plans.articles import ingest_articles

START = datetime(2024, 1, 1)


def page(title, text):
    return f"<html><head><title>{title}</title></head><body><article><p>{text}</p></article></body></html>"


def test_articles_are_checked_compared_and_queued(spark):
    pages = [
        (1, "https://a.example/one", page("One", "First text.")),
        (2, "HTTPS://A.example:443/one#top", page("Other", "Another text.")),  # the same address
        (3, "https://b.example/copy", page("Copy", "First text.")),  # the same text
        (4, "https://b.example/two", page("one", "A text of its own.")),  # a key of its own: the title does not count
        (5, "http://127.0.0.1/x", page("Inside", "Private.")),
        (6, "not a link", page("None", "No link.")),
        (7, "https://c.example/empty", "<html><body></body></html>"),
        (8, "https://d.example/stored", page("Eight", "Eighth text.")),
        (9, None, page("Null", "Null link.")),
    ]
    df = spark.createDataFrame([(i, u, h) for i, u, h in pages], "page_id long, url string, html string")
    at = F.lit(START) + F.make_dt_interval(hours=F.col("page_id").cast("int"))
    first = ingest_articles(df.where("page_id < 8"), at)
    assert rows(first.items, "item_id") == [(1,), (4,)] and rows(first.queue, "item_id", "status") == [(1, "Pending"), (4, "Pending")]
    assert rows(first.outcomes.na.fill("", ["reason"]).na.fill(0, ["existing_item_id"]), "page_id", "outcome", "reason", "existing_item_id") == [
        (1, "stored", "", 0), (2, "duplicate", "url", 1), (3, "duplicate", "content_hash", 1), (4, "stored", "", 0),
        (5, "rejected", "host_not_public", 0), (6, "rejected", "url_invalid", 0), (7, "rejected", "not_extractable", 0),
    ]
    again = ingest_articles(df.where("page_id IN (1, 8, 9)"), at + timedelta(days=1), first.items)
    assert rows(again.outcomes.na.fill(0, ["existing_item_id"]), "page_id", "outcome", "existing_item_id") == [
        (1, "duplicate", 1), (8, "stored", 0), (9, "rejected", 0)
    ]
    assert again.items.select("source_id", "origin", "status").first() == (None, "ManualUrl", "Queued")
