"""Row rules. Good and bad rows leave by two filters over one error column; nothing fails the job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from updatelens import constants as K
from updatelens.functions import links as L
from updatelens.functions import text as T
from updatelens.skew import lookup


def _errors(*checks: Column) -> Column:
    return F.filter(F.array(*checks), lambda e: e.isNotNull())


def validate_items(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entity rules of an item. Returns (good, bad); bad rows carry ``errors``.

    ``raw`` has source_id, external_id, url, title, excerpt, content_hash, retrieved_at.
    """
    return split_checked(check_items(raw))


def split_checked(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    return checked.where(F.size("errors") == 0).drop("errors"), checked.where(F.size("errors") > 0)


def check_items(raw: DataFrame) -> DataFrame:
    """All items with their ``errors``. A filter on them repeats the rules, so written rows are split more cheaply."""
    url_bad = ~T.is_blank("url") & L.canonical_url(F.col("url")).isNull()
    errors = _errors(
        F.when(T.is_blank(F.col("source_id").cast("string")), F.lit("source_missing")),
        T.title_error("title"),
        F.when(T.too_long("external_id", K.EXTERNAL_ID_MAX), F.lit("external_id_too_long")),
        F.when(T.too_long("excerpt", K.EXCERPT_MAX), F.lit("excerpt_too_long")),
        F.when(T.too_long("content_hash", K.CONTENT_HASH_MAX), F.lit("content_hash_too_long")),
        F.when(url_bad, F.lit("url_invalid")),
        F.when(F.col("retrieved_at").isNull(), F.lit("retrieved_at_missing")),
    )
    return raw.withColumn("errors", errors)


def clean_items(good: DataFrame) -> DataFrame:
    """Stored form of valid items: cleaned text, canonical link and the comparison keys."""
    url = L.canonical_url(F.col("url"))
    kept = [
        c for c in good.columns
        if c not in {"url", "title", "excerpt", "external_id", "content_hash"}
    ]
    prepared = good.withColumn("canonical_url", url)
    return prepared.select(
        *kept,
        T.clean_optional("external_id").alias("external_id"),
        T.clean_optional("url").alias("original_url"),
        "canonical_url",
        L.url_hash(F.col("canonical_url")).alias("url_hash"),
        T.clean_title("title").alias("title"),
        T.normalize_title("title").alias("normalized_title"),
        T.clean_optional("excerpt").alias("excerpt"),
        F.upper(T.clean_optional("content_hash")).alias("content_hash"),
        F.lit("Queued").alias("status"),
        F.lit(0).alias("failure_count"),
    )


def validate_messages(messages: DataFrame, items: DataFrame, outbox: DataFrame, receipts: DataFrame) -> DataFrame:
    """Disposition of each item-ready message; the first rule that applies decides.

    messages: message_id, item_id, source_id, run_id, correlation_id, occurred_at. items: item_id,
    source_id, status. outbox: message_id, item_id, source_id, run_id, correlation_id, created_at,
    status. receipts: item_id. Within the batch the first message of an item is accepted.
    """
    known = items.select("item_id", F.col("source_id").alias("i_source"), F.col("status").alias("i_status"))
    sent = outbox.select(
        "message_id",
        F.col("item_id").alias("o_item"),
        F.col("source_id").alias("o_source"),
        F.col("run_id").alias("o_run"),
        F.col("correlation_id").alias("o_correlation"),
        F.col("created_at").alias("o_created"),
        F.col("status").alias("o_status"),
    )
    done = receipts.select("item_id").distinct().withColumn("_received", F.lit(True))
    # One item may be named by very many messages.
    spread = F.col("message_id")
    joined = lookup(lookup(messages, known, ["item_id"], spread), done, ["item_id"], spread)
    joined = joined.join(sent, "message_id", "left")
    mismatch = (
        ~F.col("i_source").eqNullSafe(F.col("source_id"))
        | F.col("o_item").isNull()
        | (F.col("o_item") != F.col("item_id"))
        | ~F.col("o_source").eqNullSafe(F.col("source_id"))
        | ~F.col("o_run").eqNullSafe(F.col("run_id"))
        | (F.col("o_correlation") != F.col("correlation_id"))
        | (F.col("o_created") != F.col("occurred_at"))
        | (F.col("o_status") == "Quarantined")
    )
    rule = (
        F.when(F.col("i_status").isNull(), F.lit("item_missing"))
        .when(mismatch, F.lit("reference_mismatch"))
        .when(F.col("i_status").isin(*K.TERMINAL_STATES), F.lit("item_terminal"))
        .when(~F.col("i_status").isin(*K.OPEN_STATES), F.lit("invalid_state"))
        .when(F.col("_received"), F.lit("already_accepted"))
        .otherwise(F.lit("accepted"))
    )
    judged = joined.select(*messages.columns, rule.alias("disposition"))
    # The first acceptable message per item: a map-side combined minimum, then one row per item.
    first = (
        judged.where("disposition = 'accepted'")
        .groupBy("item_id")
        .agg(F.min(F.struct("occurred_at", "message_id")).alias("_first"))
    )
    again = (F.col("disposition") == "accepted") & (F.col("_first.message_id") != F.col("message_id"))
    return lookup(judged, first, ["item_id"], spread).select(
        *messages.columns,
        F.when(again, F.lit("already_accepted")).otherwise(F.col("disposition")).alias("disposition"),
    )


def check_outbox(outbox: DataFrame, envelopes: DataFrame) -> DataFrame:
    """Diagnostic per outbox row: destination, readable payload, and metadata equal to it.

    ``envelopes`` are the typed payloads keyed by ``message_id``, as ``read_messages`` returns them.
    """
    e = envelopes.select(
        F.col("row_id").alias("message_id"),
        F.col("message_id").alias("e_message"),
        F.col("item_id").alias("e_item"),
        F.col("source_id").alias("e_source"),
        F.col("run_id").alias("e_run"),
        F.col("correlation_id").alias("e_correlation"),
    )
    rows = outbox.join(e, "message_id", "left")
    same = (
        (F.col("e_message") == F.col("message_id"))
        & (F.col("e_item") == F.col("item_id"))
        & F.col("e_source").eqNullSafe(F.col("source_id"))
        & F.col("e_run").eqNullSafe(F.col("run_id"))
        & (F.col("e_correlation") == F.col("correlation_id"))
    )
    return rows.select(
        *outbox.columns,
        F.when(F.col("destination") != K.MESSAGE_DESTINATION, F.lit("wrong_destination"))
        .when(F.col("e_message").isNull(), F.lit("unreadable_payload"))
        .when(~same, F.lit("metadata_mismatch"))
        .alias("diagnostic"),
    )


def duplicate_ids(df: DataFrame, group: str, id_col: str) -> DataFrame:
    """Ids that one request lists more than once."""
    return (
        df.groupBy(group, id_col).agg(F.count("*").alias("occurrences")).where("occurrences > 1")
    )


def validate_runs(runs: DataFrame) -> DataFrame:
    """Run accounting rules, with the counts a failed run would record."""
    retrieved, new = F.col("retrieved_count"), F.col("new_count")
    errors = _errors(
        F.when(retrieved < 0, F.lit("negative_retrieved")),
        F.when((new < 0) | (new > retrieved), F.lit("new_out_of_range")),
        F.when(
            (F.col("status") == "NotModified") & ((retrieved != 0) | (new != 0)),
            F.lit("not_modified_with_items"),
        ),
        F.when(F.col("completed_at") < F.col("started_at"), F.lit("completed_before_start")),
    )
    bounded = F.greatest(F.lit(0), retrieved)
    return runs.select(
        *runs.columns,
        errors.alias("errors"),
        bounded.alias("bounded_retrieved"),
        F.least(F.greatest(F.lit(0), new), bounded).alias("bounded_new"),
        F.greatest("completed_at", "started_at").alias("bounded_completed_at"),
    )


def validate_briefs(brief_items: DataFrame, brief_item_sources: DataFrame) -> DataFrame:
    """Violations of brief item rules: (brief_id, update_id, rank, error), one row per violation."""
    by_rank = brief_items.groupBy("brief_id", "rank").agg(
        F.count("*").alias("n"), F.min("update_id").alias("update_id")
    )
    by_update = brief_items.groupBy("brief_id", "update_id").agg(
        F.count("*").alias("n"), F.min("rank").alias("rank")
    )
    score = F.col("score")
    row_errors = _errors(
        F.when(F.col("rank") < 1, F.lit("rank_not_positive")),
        F.when(
            score.isNull() | F.isnan(score) | (F.abs(score) == float("inf")), F.lit("score_not_finite")
        ),
    )
    unsupported = brief_items.join(
        brief_item_sources.select("brief_id", "update_id").distinct(), ["brief_id", "update_id"], "left_anti"
    )
    cols = ["brief_id", "update_id", "rank"]
    return (
        by_rank.where("n > 1").select(*cols, F.lit("duplicate_rank").alias("error"))
        .unionByName(by_update.where("n > 1").select(*cols, F.lit("duplicate_update").alias("error")))
        .unionByName(brief_items.select(*cols, F.explode(row_errors).alias("error")))
        .unionByName(unsupported.select(*cols, F.lit("no_source").alias("error")))
    )


def filtered_unique_violations(df: DataFrame, keys: list[str], predicate: Column) -> DataFrame:
    """Keys that occur more than once among the rows a filtered unique rule covers."""
    covered = df.where(predicate).where(" AND ".join(f"{k} IS NOT NULL" for k in keys))
    return covered.groupBy(*keys).agg(F.count("*").alias("occurrences")).where("occurrences > 1")


def validate_matches(provider_rows: DataFrame, interests: DataFrame) -> DataFrame:
    """Provider matches that are usable: supplied interests, first row per id, strength in 0..1.

    ``provider_rows`` has item_id, interest_id, strength and position. The first row of an id
    decides even when its strength is out of bounds.
    """
    supplied = provider_rows.join(interests.select("interest_id"), "interest_id", "left_semi")
    first = W.partitionBy("item_id", "interest_id").orderBy("position")
    return (
        supplied.withColumn("_n", F.row_number().over(first))
        .where("_n = 1")
        .where("strength BETWEEN 0 AND 1")
        .drop("_n")
    )
