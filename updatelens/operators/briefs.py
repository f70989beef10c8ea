"""Selection, composition and history of briefs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from updatelens import constants as K
from updatelens.functions import text as T
from updatelens.functions.values import feedback_wire
from updatelens.operators.interactions import latest_feedback
from updatelens.options import BriefOptions, ScoringOptions


def brief_window(briefs: DataFrame, now: Column, options: BriefOptions = BriefOptions()) -> DataFrame:
    """One row (window_start, window_end): from the latest completed brief, else the look-back."""
    latest = briefs.agg(F.max(F.when(F.col("status") == "Completed", F.col("generated_at"))).alias("_l"))
    return latest.select(
        F.coalesce("_l", now - F.make_dt_interval(days=F.lit(options.lookback_days))).alias("window_start"),
        now.alias("window_end"),
    )


def eligible_updates(
    updates: DataFrame,
    briefs: DataFrame,
    brief_items: DataFrame,
    window: DataFrame,
    threshold: float = ScoringOptions().threshold,
) -> DataFrame:
    """Active updates at or over the threshold, seen in the window, in no completed brief yet.

    ``window`` is the one-row frame of ``brief_window``; its bound stays in the plan.
    """
    completed = briefs.where("status = 'Completed'").select("brief_id")
    briefed = brief_items.join(completed, "brief_id", "left_semi").select("update_id").distinct()
    good = updates.where((F.col("status") == "Active") & (F.col("score") >= threshold)).withColumn("_k", F.lit(1))
    bound = window.select("window_start").withColumn("_k", F.lit(1))
    recent = good.join(bound, "_k").where(F.col("last_observed_at") >= F.col("window_start"))
    return recent.drop("_k", "window_start").join(briefed, "update_id", "left_anti")


def select_brief(eligible: DataFrame, options: BriefOptions = BriefOptions()) -> DataFrame:
    """The best updates with rank and the number of candidates they were chosen from.

    ``eligible`` may carry brief_id to select for several briefs at once. No padding: fewer
    candidates give fewer rows.
    """
    keyed = eligible if "brief_id" in eligible.columns else eligible.withColumn("brief_id", F.lit("current"))
    order = W.partitionBy("brief_id").orderBy(F.col("score").desc(), "update_id")
    ranked = keyed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= options.max_items)
    counts = keyed.groupBy("brief_id").agg(F.count("*").alias("candidate_count"))
    return ranked.join(counts, "brief_id").select("brief_id", "update_id", "rank", "score", "candidate_count")


def select_current(eligible: DataFrame, options: BriefOptions = BriefOptions()) -> DataFrame:
    """As ``select_brief`` for one brief over a large table: a distributed top-k."""
    best = eligible.orderBy(F.col("score").desc(), "update_id").limit(options.max_items)
    order = W.partitionBy("_k").orderBy(F.col("score").desc(), "update_id")
    ranked = best.withColumn("_k", F.lit(1)).withColumn("rank", F.row_number().over(order))
    count = eligible.agg(F.count("*").alias("candidate_count")).withColumn("_k", F.lit(1))
    return ranked.join(count, "_k").select("update_id", "rank", "score", "candidate_count")


def brief_sources(selected: DataFrame, links: DataFrame, items: DataFrame) -> DataFrame:
    """All supporting items of the selected updates in their order: newest first, undated last."""
    chosen = selected.select("update_id").distinct()
    facts = items.select(
        "item_id", "title", "excerpt", F.coalesce("canonical_url", "original_url").alias("url"), "published_at"
    )
    return links.join(chosen, "update_id", "left_semi").select("update_id", "item_id").join(facts, "item_id")


def generation_inputs(
    selected: DataFrame,
    links: DataFrame,
    items: DataFrame,
    update_interests: DataFrame,
    interests: DataFrame,
    updates: DataFrame,
) -> DataFrame:
    """One bounded request per selected update: primary_topic, sources, interests.

    Lists are cut to the request limits before they are gathered; updates without a source give no
    row.
    """
    by_date = W.partitionBy("update_id").orderBy(F.col("published_at").desc_nulls_last(), "item_id")
    source = F.struct(
        F.col("_n"),
        F.col("item_id"),
        T.clamp("title", K.REQUEST_TITLE_MAX).alias("title"),
        T.clamp(T.clamp("excerpt", K.REQUEST_EXCERPT_MAX), K.REQUEST_EXCERPT_BUDGET).alias("excerpt"),
        F.col("url"),
        F.col("published_at"),
    )
    sources = (
        brief_sources(selected, links, items)
        .withColumn("_n", F.row_number().over(by_date))
        .where(F.col("_n") <= K.REQUEST_SOURCES_MAX)
        .groupBy("update_id")
        .agg(F.sort_array(F.collect_list(source)).alias("sources"))
    )
    by_strength = W.partitionBy("update_id").orderBy(F.col("strength").desc(), "interest_id")
    active = interests.where("is_active").select("interest_id", "name", "priority")
    interest = F.struct(
        F.col("_n"), F.col("interest_id"), T.clamp("name", K.REQUEST_INTEREST_NAME_MAX).alias("name"), F.col("priority")
    )
    matched = (
        update_interests.join(selected.select("update_id").distinct(), "update_id", "left_semi")
        .join(active, "interest_id")
        .withColumn("_n", F.row_number().over(by_strength))
        .where(F.col("_n") <= K.REQUEST_INTERESTS_MAX)
        .groupBy("update_id")
        .agg(F.sort_array(F.collect_list(interest)).alias("interests"))
    )
    topics = updates.select("update_id", T.clamp("primary_topic", K.REQUEST_TOPIC_MAX).alias("primary_topic"))
    empty = F.array().cast("array<struct<_n:int,interest_id:string,name:string,priority:string>>")
    return (
        selected.join(sources, "update_id")
        .join(matched, "update_id", "left")
        .join(topics, "update_id")
        .withColumn("interests", F.coalesce("interests", empty))
    )


def _distinct_text(values: Column) -> Column:
    trimmed = F.transform(values, lambda v: T.trim_ws(v))
    return F.array_distinct(F.filter(trimmed, lambda v: v.isNotNull() & (v != "")))


def deterministic_composer(inputs: DataFrame) -> DataFrame:
    """Title of the first source; distinct excerpts, else titles; matched interests, else the topic."""
    excerpts = _distinct_text(F.transform("sources", lambda s: s["excerpt"]))
    titles = _distinct_text(F.transform("sources", lambda s: s["title"]))
    names = _distinct_text(F.transform("interests", lambda i: i["name"]))
    summary = F.array_join(F.when(F.size(excerpts) > 0, excerpts).otherwise(titles), " ")
    # The two sentences on relevance.
    why = F.when(
        F.size(names) > 0,
        F.concat(F.lit("Relevant to your interests: "), F.array_join(names, ", "), F.lit(".")),
    ).otherwise(F.concat(F.lit("Relevant to the "), T.trim_ws("primary_topic"), F.lit(" topic.")))
    kept = [c for c in inputs.columns if c not in ("sources", "interests")]
    return inputs.select(
        *kept,
        T.clamp(T.trim_ws(F.get("sources", F.lit(0))["title"]), K.COMPOSED_TITLE_MAX).alias("title"),
        T.clamp(summary, K.COMPOSED_SUMMARY_MAX).alias("summary"),
        T.clamp(why, K.COMPOSED_WHY_MAX).alias("why_relevant"),
        F.lit(K.GENERATION_VERSION).alias("generation_version"),
    )


Composer = Callable[[DataFrame], DataFrame]


def compose(inputs: DataFrame, provider: Composer = deterministic_composer) -> DataFrame:
    """Text per selected update by any provider; an update the provider leaves out is excluded."""
    result = provider(inputs)
    missing = {"update_id", "title", "summary", "why_relevant", "generation_version"} - set(result.columns)
    if missing:
        raise ValueError(f"provider result lacks {sorted(missing)}")
    return result


def complete_brief(
    briefs: DataFrame, selected: DataFrame, composed: DataFrame, sources: DataFrame, now: Column
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Completed header, items and item sources of briefs that are being generated.

    selected: brief_id, update_id, rank, score, candidate_count; composed: update_id, primary_topic
    and the generated text; sources as ``brief_sources`` returns them. Updates without text are left
    out and the ranks close up.
    """
    generating = briefs.where("status = 'Generating'")
    text = composed.select("update_id", "primary_topic", "title", "summary", "why_relevant", "generation_version")
    order = W.partitionBy("brief_id").orderBy("rank")
    items = (
        selected.join(generating.select("brief_id"), "brief_id", "left_semi")
        .join(text, "update_id")
        .withColumn("rank", F.row_number().over(order))
        .select(
            "brief_id",
            "update_id",
            "rank",
            F.col("score").alias("score"),
            T.clamp_trimmed("title", K.SNAPSHOT_TITLE_MAX).alias("title"),
            T.clamp_trimmed("primary_topic", K.SNAPSHOT_TOPIC_MAX).alias("topic"),
            T.clamp_trimmed("summary", K.SNAPSHOT_TEXT_MAX).alias("summary"),
            T.clamp_trimmed("why_relevant", K.SNAPSHOT_TEXT_MAX).alias("why_relevant"),
            now.alias("generated_at"),
            F.col("generation_version").alias("prompt_version"),
            F.col("generation_version").alias("algorithm_version"),
        )
    )
    item_sources = items.select("brief_id", "update_id").join(sources, "update_id").select(
        "brief_id",
        "update_id",
        "item_id",
        T.clamp_trimmed("title", K.SNAPSHOT_TITLE_MAX).alias("title"),
        F.when(~T.is_blank("url"), T.clamp_trimmed("url", K.URL_MAX)).alias("url"),
        "published_at",
    )
    written = items.groupBy("brief_id").agg(F.count("*").alias("_written"))
    candidates = selected.groupBy("brief_id").agg(F.max("candidate_count").alias("_candidates"))
    header = generating.join(written, "brief_id", "left").join(candidates, "brief_id", "left").select(
        *[c for c in briefs.columns if c not in ("status", "candidate_count", "selected_count")],
        F.lit("Completed").alias("status"),
        F.coalesce("_candidates", F.lit(0)).cast("bigint").alias("candidate_count"),
        F.coalesce("_written", F.lit(0)).cast("bigint").alias("selected_count"),
    )
    return header, items, item_sources


def fail_orphans(briefs: DataFrame, cutoff: Column) -> DataFrame:
    """Briefs left generating from before the cutoff become failed and count no items."""
    orphan = (F.col("status") == "Generating") & (F.col("generated_at") < cutoff)
    changed = {"status": F.when(orphan, F.lit("Failed")).otherwise(F.col("status"))}
    if "selected_count" in briefs.columns:
        changed["selected_count"] = F.when(orphan, F.lit(0)).otherwise(F.col("selected_count"))
    return briefs.withColumns(changed)


def failed_without_items(briefs: DataFrame, rows: DataFrame) -> DataFrame:
    """Item or source rows without those of failed briefs."""
    return rows.join(briefs.where("status = 'Failed'").select("brief_id"), "brief_id", "left_anti")


def current_brief(briefs: DataFrame) -> DataFrame:
    """Header of the latest completed brief."""
    completed = briefs.where("status = 'Completed'")
    return completed.orderBy(F.col("generated_at").desc(), F.col("brief_id").desc()).limit(1)


def brief_by_id(briefs: DataFrame, brief_id) -> DataFrame:
    return briefs.where(F.col("brief_id") == brief_id)


def brief_view(
    header: DataFrame,
    brief_items: DataFrame,
    brief_item_sources: DataFrame,
    feedback: DataFrame,
    saves: DataFrame,
) -> DataFrame:
    """Read model of the briefs in ``header``: one row per ranked item and source, with the live
    feedback and saved flag of the item's update. Snapshot columns stay as written.

    Every large table is first cut down to the header's briefs or their updates.
    """
    items = header.select("brief_id", "generated_at").join(brief_items.drop("generated_at"), "brief_id")
    mine = items.select("update_id").distinct()
    current = latest_feedback(feedback.join(mine, "update_id", "left_semi")).select(
        "update_id", feedback_wire(F.col("feedback_type")).alias("latest_feedback")
    )
    saved = saves.join(mine, "update_id", "left_semi").select("update_id").distinct().withColumn("_saved", F.lit(True))
    sources = brief_item_sources.join(header.select("brief_id"), "brief_id", "left_semi")
    return (
        items.join(current, "update_id", "left")
        .join(saved, "update_id", "left")
        .withColumn("is_saved", F.coalesce("_saved", F.lit(False)))
        .drop("_saved")
        .join(
            sources.withColumnsRenamed({c: f"source_{c}" for c in sources.columns if c not in ("brief_id", "update_id")}),
            ["brief_id", "update_id"],
            "left",
        )
    )


def brief_history(briefs: DataFrame, limit: int, after: DataFrame | None = None) -> DataFrame:
    """One page of briefs, newest first, with ``has_more`` and the cursor columns on every row.

    ``after`` is a one-row frame (generated_at, brief_id) naming the last brief of the page before.
    The id takes part, so briefs of one moment are never skipped.
    """
    size = max(1, min(limit, 100))
    rows = briefs
    if after is not None:
        cursor = after.select(F.struct("generated_at", "brief_id").alias("_cursor"), F.lit(1).alias("_k"))
        rows = (
            rows.withColumn("_k", F.lit(1)).join(cursor, "_k")
            .where(F.struct("generated_at", "brief_id") < F.col("_cursor")).drop("_k", "_cursor")
        )
    newest = [F.col("generated_at").desc(), F.col("brief_id").desc()]
    page = rows.orderBy(*newest).limit(size + 1).withColumn("_k", F.lit(1))
    order = W.partitionBy("_k").orderBy(*newest)
    return (
        page.withColumn("position", F.row_number().over(order))
        .withColumn("has_more", F.count("*").over(W.partitionBy("_k")) > size)
        .where(F.col("position") <= size)
        .drop("_k")
    )


def next_cursor(page: DataFrame) -> DataFrame:
    """Cursor for the page after this one; empty when there is none."""
    last = page.where("has_more").orderBy(F.col("position").desc()).limit(1)
    return last.select("generated_at", "brief_id")
