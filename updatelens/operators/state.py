"""Ingestion runs and processing state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from updatelens import constants as K
from updatelens.functions.text import clean_optional
from updatelens.options import GroupingOptions


def run_report(feeds: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One run row per feed of a pass.

    feeds: source_id, not_modified, error_code (null when the document was read); outcomes: source_id
    and outcome (new, duplicate or failed) per entry. Entries are counted before they are shuffled.
    """
    counts = outcomes.groupBy("source_id").agg(
        F.count("*").alias("_all"),
        F.count_if(F.col("outcome") == "new").alias("_new"),
        F.count_if(F.col("outcome") == "failed").alias("_failed"),
    )
    rows = feeds.join(counts, "source_id", "left")
    quiet = F.col("not_modified") & F.col("error_code").isNull()

    def number(name: str) -> Column:
        return F.when(quiet, F.lit(0)).otherwise(F.coalesce(name, F.lit(0))).cast("bigint")

    failed = number("_failed") > 0
    return rows.select(
        "source_id",
        number("_all").alias("retrieved_count"),
        number("_new").alias("new_count"),
        number("_failed").alias("failed_count"),
        F.when(F.col("error_code").isNotNull() | failed, F.lit("Failed"))
        .when(F.col("not_modified"), F.lit("NotModified"))
        .otherwise(F.lit("Succeeded"))
        .alias("status"),
        F.coalesce("error_code", F.when(failed, F.lit("feed_items_failed"))).alias("error_code"),
    )


def job_summary(runs: DataFrame) -> DataFrame:
    """One row over all runs of a pass; ``all_failed`` is the job's exit condition."""
    ok = F.col("status").isin("Succeeded", "NotModified")
    totals = runs.agg(
        F.count("*").alias("enabled_sources"),
        F.count_if(ok).alias("succeeded_sources"),
        F.count_if(~ok).alias("failed_sources"),
        F.coalesce(F.sum("new_count"), F.lit(0)).cast("bigint").alias("new_items"),
    )
    return totals.withColumn("all_failed", (F.col("enabled_sources") > 0) & (F.col("succeeded_sources") == 0))


def latest_run_per_source(runs: DataFrame) -> DataFrame:
    """Last time, last status and current validator per source.

    A succeeded run sets the validator, a not-modified one only when it names one, a failed one never.
    """
    sets = (F.col("status") == "Succeeded") | (
        (F.col("status") == "NotModified") & F.col("validator").isNotNull()
    )
    moment = F.struct("completed_at", "run_id", "status", "validator")
    latest = runs.where("status <> 'Running'").groupBy("source_id").agg(
        F.max(moment).alias("l"), F.max(F.when(sets, moment)).alias("v")
    )
    return latest.select(
        "source_id",
        F.col("l.completed_at").alias("last_ingestion_at"),
        F.col("l.status").alias("last_status"),
        F.col("v.validator").alias("validator"),
    )


def apply_failures(
    items: DataFrame, failures: DataFrame, options: GroupingOptions = GroupingOptions()
) -> DataFrame:
    """Failure count, last code and state of items after a list of failures, oldest first.

    items: item_id, status, failure_count, last_failure_code; failures: item_id, failed_at,
    failure_id, failure_code, is_validation. A validation failure or the last attempt is terminal;
    what comes after is ignored, so at most ``max_attempts`` failures per item matter.
    """
    limit = options.max_attempts
    order = W.partitionBy("item_id").orderBy("failed_at", "failure_id")
    counted = (
        failures.withColumn("_n", F.row_number().over(order))
        .where(F.col("_n") <= limit)
        .groupBy("item_id")
        .agg(F.sort_array(F.collect_list(F.struct("_n", "failure_code", "is_validation"))).alias("_f"))
    )
    rows = items.join(counted, "item_id", "left")
    open_item = ~F.col("status").isin(*K.TERMINAL_STATES) & F.col("_f").isNotNull()
    first_bad = F.get(F.filter("_f", lambda x: x["is_validation"]), F.lit(0))["_n"]
    budget = F.greatest(F.lit(1), F.lit(limit) - F.col("failure_count"))
    stop = F.least(F.coalesce(first_bad, F.lit(limit + 1)), budget)
    used = F.least(F.size("_f"), stop)
    code = F.substring(clean_optional(F.get("_f", used - 1)["failure_code"]), 1, K.FAILURE_CODE_MAX)
    state = F.when(used >= stop, F.lit("FailedTerminal")).otherwise(F.lit("FailedRetryable"))
    return rows.select(
        "item_id",
        F.when(open_item, state).otherwise(F.col("status")).alias("status"),
        (F.col("failure_count") + F.when(open_item, used).otherwise(F.lit(0))).cast("int").alias("failure_count"),
        F.when(open_item, code).otherwise(F.col("last_failure_code")).alias("last_failure_code"),
    )


def mark_processed(items: DataFrame, links: DataFrame) -> DataFrame:
    """Items after grouping: linked ones are Processed, which is illegal from another final state."""
    linked = links.select("item_id").distinct().withColumn("_linked", F.lit(True))
    rows = items.join(linked, "item_id", "left")
    illegal = F.col("_linked") & F.col("status").isin("Filtered", "FailedTerminal")
    return rows.select(
        "item_id",
        F.when(F.col("_linked") & ~F.col("status").isin("Filtered", "FailedTerminal"), F.lit("Processed"))
        .otherwise(F.col("status"))
        .alias("status"),
        F.when(illegal, F.lit("illegal_transition")).alias("error"),
    )


def pending(messages: DataFrame, as_of: Column, limit: int, lease_seconds: int = 30) -> DataFrame:
    """The oldest messages that were never tried or whose lease ran out."""
    free = F.col("last_attempt_at").isNull() | (
        F.col("last_attempt_at") <= as_of - F.make_dt_interval(secs=F.lit(lease_seconds))
    )
    return (
        messages.where((F.col("status") == "Pending") & free).orderBy("created_at", "message_id").limit(limit)
    )


def quarantine_report(messages: DataFrame) -> DataFrame:
    """Messages, attempts and the latest error per status."""
    error = F.when(
        F.col("last_error").isNotNull(), F.struct("last_attempt_at", "message_id", "last_error")
    )
    return messages.groupBy("status").agg(
        F.count("*").alias("messages"),
        F.sum("attempts").cast("bigint").alias("attempts"),
        F.count_if(F.col("last_error").isNotNull()).alias("with_error"),
        F.max(error)["last_error"].alias("last_error"),
    )
