"""Scored updates to an immutable brief."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from updatelens.operators import briefs as B
from updatelens.options import BriefOptions, ScoringOptions


def generate_brief(
    request: DataFrame,
    updates: DataFrame,
    links: DataFrame,
    items: DataFrame,
    update_interests: DataFrame,
    interests: DataFrame,
    briefs: DataFrame,
    brief_items: DataFrame,
    now: Column,
    options: BriefOptions = BriefOptions(),
    scoring: ScoringOptions = ScoringOptions(),
    composer: B.Composer = B.deterministic_composer,
    window: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fill one generating brief. ``request`` is its one-row header (brief_id, status, generated_at).

    One lazy plan: updates are chosen before any text is gathered, so at most ``max_items`` updates
    reach the composer. ``window`` stands for the time since the latest completed brief. Returns (header, items, item sources).
    """
    window = B.brief_window(briefs, now, options) if window is None else window
    eligible = B.eligible_updates(updates, briefs, brief_items, window, scoring.threshold)
    header = request.select("brief_id").withColumn("_k", F.lit(1))
    selected = (
        B.select_current(eligible, options).withColumn("_k", F.lit(1)).join(header, "_k").drop("_k")
    )
    inputs = B.generation_inputs(selected, links, items, update_interests, interests, updates)
    composed = B.compose(inputs, composer)
    return B.complete_brief(request, selected, composed, B.brief_sources(selected, links, items), now)
