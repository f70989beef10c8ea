"""Raw feed documents to stored items and run rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from updatelens.operators.dedup import dedup_items
from updatelens.operators.quality import check_items, clean_items, split_checked
from updatelens.operators.state import run_report
from updatelens.options import DedupOptions
from updatelens.session import materialize
from updatelens.sources.feeds import parse_feeds, unchanged_filter


@dataclass(frozen=True)
class IngestResult:
    items: DataFrame
    duplicates: DataFrame
    bad_items: DataFrame
    rejected_feeds: DataFrame
    runs: DataFrame


def item_key(source_id: Column, position: Column, moment: Column) -> Column:
    """A repeatable id for an entry of one pass."""
    return F.sha2(F.concat_ws("\x1f", source_id.cast("string"), moment.cast("string"), position.cast("string")), 256)


def ingest_feeds(
    feeds: DataFrame,
    sources: DataFrame,
    retrieved_at: Column,
    stored: DataFrame | None = None,
    options: DedupOptions = DedupOptions(),
) -> IngestResult:
    """One pass over all feeds: unchanged payloads out, entries read, checked, cleaned and compared
    with what is stored. feeds: source_id, feed_url, payload."""
    changed, unchanged = unchanged_filter(feeds, sources)
    entries, rejects = parse_feeds(changed)
    entries = entries.withColumn("retrieved_at", retrieved_at).withColumn(
        "item_id", item_key(F.col("source_id"), F.col("position"), retrieved_at)
    )
    good, bad = split_checked(materialize(check_items(entries)))
    items = materialize(clean_items(good))
    kept, duplicates = dedup_items(items, stored, options)
    outcomes = (
        kept.select("source_id", F.lit("new").alias("outcome"))
        .unionByName(
            duplicates.join(items, "item_id").select("source_id", F.lit("duplicate").alias("outcome"))
        )
        .unionByName(bad.select("source_id", F.lit("failed").alias("outcome")))
    )
    status = (
        changed.select("source_id", F.lit(False).alias("not_modified"))
        .unionByName(unchanged.select("source_id", F.lit(True).alias("not_modified")))
        .join(rejects.select("source_id", "error_code"), "source_id", "left")
    )
    return IngestResult(kept, duplicates, bad, rejects, run_report(status, outcomes))
