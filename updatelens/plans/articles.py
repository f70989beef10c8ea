"""Single pages, handed in by their address, to stored items and queue rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from updatelens.functions import links as L
from updatelens.functions import text as T
from updatelens.operators.dedup import dedup_articles
from updatelens.options import DedupOptions
from updatelens.session import materialize
from updatelens.sources.articles import article_items, extract_articles


@dataclass(frozen=True)
class ArticleResult:
    items: DataFrame  # new items, in their stored form
    queue: DataFrame  # one row for each new item, for the grouping to take up
    outcomes: DataFrame  # page_id, outcome (stored, duplicate or rejected), reason and the item that was there before


def ingest_articles(
    pages: DataFrame,
    retrieved_at: Column,
    stored: DataFrame | None = None,
    options: DedupOptions = DedupOptions(),
) -> ArticleResult:
    """Pages (page_id, url, html) that someone handed in: read, checked and compared with what is stored.

    An address that is no link, or of a host that is not public, is rejected before the page is read; so is a page
    without title or text. Articles have no source and no external id: link, digest of the whole text and the
    title window decide. ``page_id`` becomes the id of the item.
    """
    url = L.canonical_url(F.col("url"))
    reason = F.when(url.isNull(), F.lit("url_invalid")).when(~L.is_public_host(L.url_host(url)), F.lit("host_not_public"))
    judged = pages.withColumn("_reason", reason)
    refused = judged.where("_reason IS NOT NULL").select("page_id", F.col("_reason").alias("reason"))
    found, unread = extract_articles(judged.where("_reason IS NULL").drop("_reason"))
    fields = article_items(found).withColumn("retrieved_at", retrieved_at)
    none = F.lit(None).cast("string")
    items = materialize(
        fields.select(
            F.col("page_id").alias("item_id"),
            none.alias("source_id"),
            none.alias("external_id"),
            F.col("url").alias("original_url"),
            L.canonical_url(F.col("url")).alias("canonical_url"),
            L.url_hash(L.canonical_url(F.col("url"))).alias("url_hash"),
            T.clean_title("title").alias("title"),
            T.normalize_title("title").alias("normalized_title"),
            T.clean_optional("excerpt").alias("excerpt"),
            "content_hash",
            F.lit(None).cast("timestamp").alias("published_at"),
            "retrieved_at",
            F.lit("ManualUrl").alias("origin"),
            F.lit("Queued").alias("status"),
            F.lit(0).alias("failure_count"),
        )
    )
    judged = materialize(dedup_articles(items, stored, options))
    kept = items.join(judged.where("NOT is_duplicate").select("item_id"), "item_id", "left_semi")
    queue = kept.select("item_id", F.col("retrieved_at").alias("queued_at"), F.lit("Pending").alias("status"))
    told = judged.select(
        F.col("item_id").alias("page_id"),
        F.when(F.col("is_duplicate"), F.lit("duplicate")).otherwise(F.lit("stored")).alias("outcome"),
        "reason",
        "existing_item_id",
    )
    unread = unread.select("page_id", F.col("error_code").alias("reason"))
    rejected = refused.unionByName(unread).withColumn("outcome", F.lit("rejected"))
    return ArticleResult(kept, queue, told.unionByName(rejected, allowMissingColumns=True))
