"""How well selection worked."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from updatelens.operators.interactions import latest_feedback


def grouped_duplicates(links: DataFrame) -> DataFrame:
    """Links beyond the first of each update."""
    per_update = links.groupBy("update_id").agg(F.count("*").alias("n"))
    return per_update.agg(
        F.greatest(
            F.lit(0).cast("bigint"), F.coalesce(F.sum("n"), F.lit(0)) - F.count("*")
        ).cast("bigint").alias("grouped_duplicates")
    )


def feedback_tally(feedback: DataFrame) -> DataFrame:
    return latest_feedback(feedback).agg(
        F.count_if(F.col("feedback_type") == "Relevant").alias("relevant_feedback"),
        F.count_if(F.col("feedback_type") != "Relevant").alias("not_relevant_feedback"),
    )


def _selected(briefs: DataFrame, rows: DataFrame) -> DataFrame:
    completed = briefs.where("status = 'Completed'").select("brief_id")
    return rows.join(completed, "brief_id", "left_semi")


def items_per_brief(briefs: DataFrame, brief_items: DataFrame) -> DataFrame:
    completed = briefs.agg(F.count_if(F.col("status") == "Completed").alias("completed_briefs"))
    selected = _selected(briefs, brief_items).agg(F.count("*").alias("items_selected"))
    mean = F.when(F.col("completed_briefs") == 0, F.lit(0.0)).otherwise(
        F.col("items_selected") / F.col("completed_briefs")
    )
    return _one_row(completed, selected).withColumn("items_per_brief", mean)


def source_distribution(
    items: DataFrame, briefs: DataFrame, brief_item_sources: DataFrame, sources: DataFrame
) -> DataFrame:
    """Ingested and selected items per source; items without a source are left out.

    brief_item_sources: brief_id, item_id. Items are counted per source in one aggregation; whether
    an item was ever selected is settled per item first.
    """
    chosen = _selected(briefs, brief_item_sources).select("item_id").distinct().withColumn("_s", F.lit(1))
    counted = (
        items.where("source_id IS NOT NULL").select("item_id", "source_id")
        .join(chosen, "item_id", "left")
        .groupBy("source_id")
        .agg(F.count("*").alias("ingested_items"), F.count("_s").alias("selected_items"))
    )
    named = counted.join(sources.select("source_id", "name"), "source_id", "left")
    return named.select(
        "source_id", F.coalesce("name", F.lit("")).alias("source_name"), "ingested_items", "selected_items"
    ).orderBy("source_name", "source_id")


def _one_row(*frames: DataFrame) -> DataFrame:
    """One-row totals side by side, joined on a constant key."""
    keyed = [f.withColumn("_k", F.lit(1)) for f in frames]
    return reduce(lambda a, b: a.join(b, "_k"), keyed).drop("_k")


def evaluation_summary(
    items: DataFrame,
    briefs: DataFrame,
    brief_items: DataFrame,
    links: DataFrame,
    feedback: DataFrame,
    opens: DataFrame,
    saves: DataFrame,
) -> DataFrame:
    """All totals in one row."""
    return _one_row(
        items.agg(F.count("*").alias("items_ingested")),
        items_per_brief(briefs, brief_items),
        grouped_duplicates(links),
        feedback_tally(feedback),
        opens.agg(F.count("*").alias("source_opens")),
        saves.agg(F.count("*").alias("saves")),
    )


def list_interests(interests: DataFrame, active_only: bool = False) -> DataFrame:
    rows = interests.where("is_active") if active_only else interests
    return rows.orderBy(F.col("is_active").desc(), "name", "interest_id")


def list_sources(sources: DataFrame, enabled_only: bool = False) -> DataFrame:
    rows = sources.where("is_enabled") if enabled_only else sources
    return rows.orderBy(F.col("is_enabled").desc(), "name", "source_id")
