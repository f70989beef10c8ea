"""Feedback, saves and source opens folded from event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from updatelens.skew import lookup


def record_feedback(events: DataFrame, updates: DataFrame, brief_items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split feedback events into (accepted, rejected with reason).

    events: feedback_id, update_id, brief_item_id (nullable), feedback_type, created_at. The update
    must exist, and a named brief item must belong to it.
    """
    known = updates.select("update_id").distinct().withColumn("_known", F.lit(True))
    owner = brief_items.select("brief_item_id", F.col("update_id").alias("_owner"))
    rows = lookup(events, known, ["update_id"], F.col("feedback_id"))
    rows = lookup(rows, owner, ["brief_item_id"], F.col("feedback_id"))
    wrong = F.col("brief_item_id").isNotNull() & ~F.col("_owner").eqNullSafe(F.col("update_id"))
    judged = rows.withColumn(
        "reason",
        F.when(F.col("_known").isNull(), F.lit("update_not_found")).when(wrong, F.lit("brief_item_not_found")),
    ).drop("_known", "_owner")
    return judged.where("reason IS NULL").drop("reason"), judged.where("reason IS NOT NULL")


def latest_feedback(feedback: DataFrame) -> DataFrame:
    """Current feedback per update: the newest row, the larger id at one time."""
    newest = F.max(F.struct("created_at", "feedback_id", "feedback_type"))
    return feedback.groupBy("update_id").agg(newest.alias("m")).select(
        "update_id",
        F.col("m.feedback_type").alias("feedback_type"),
        F.col("m.created_at").alias("created_at"),
        F.col("m.feedback_id").alias("feedback_id"),
    )


def clear_feedback(feedback: DataFrame, clears: DataFrame) -> DataFrame:
    """Feedback that survives its update's last clear. clears: update_id, cleared_at, clear_id."""
    last = clears.groupBy("update_id").agg(F.max(F.struct("cleared_at", "clear_id")).alias("_clear"))
    rows = lookup(feedback, last, ["update_id"], F.col("feedback_id"))
    moment = F.struct("created_at", "feedback_id")
    return rows.where(F.col("_clear").isNull() | (moment > F.col("_clear"))).drop("_clear")


def apply_saves(events: DataFrame, updates: DataFrame | None = None) -> DataFrame:
    """Saved updates with the time they were first saved since the last unsave.

    events: event_id, update_id, action (save or unsave), created_at. Saving twice keeps the first
    time; saves of unknown updates are refused when ``updates`` is given.
    """
    moment = F.struct("created_at", "event_id")
    gone = (
        events.where("action = 'unsave'").groupBy("update_id").agg(F.max(moment).alias("_gone"))
    )
    saves = events.where("action = 'save'").select("update_id", "created_at", "event_id")
    alive = lookup(saves, gone, ["update_id"], F.col("event_id")).where(
        F.col("_gone").isNull() | (moment > F.col("_gone"))
    )
    saved = alive.groupBy("update_id").agg(F.min("created_at").alias("saved_at"))
    return saved if updates is None else saved.join(updates.select("update_id"), "update_id", "left_semi")


def record_opens(events: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split open events into (accepted, rejected): the item has to support the update.

    Only links that some event names are made distinct, so no task holds a table of all links.
    """
    keys = ["update_id", "item_id"]
    named = links.select(*keys).join(events.select(*keys).distinct(), keys, "left_semi")
    pairs = named.distinct().withColumn("_supports", F.lit(True))
    rows = lookup(events, pairs, keys, F.col("event_id"))
    return rows.where("_supports").drop("_supports"), rows.where("_supports IS NULL").drop("_supports")
