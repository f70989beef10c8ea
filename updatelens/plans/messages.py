"""From item-ready messages to groups: each message gets a disposition, each accepted item an outcome and a state."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from updatelens import constants as K
from updatelens.functions.text import too_long
from updatelens.operators.features import analyze_items
from updatelens.operators.grouping import commit_outcomes, group_items
from updatelens.operators.quality import validate_messages
from updatelens.operators.state import apply_failures, mark_processed
from updatelens.options import GroupingOptions
from updatelens.plans.relevance import grouping_input
from updatelens.session import materialize
from updatelens.sources.messages import read_messages


@dataclass(frozen=True)
class MessageResult:
    """dispositions: row_id, item_id, disposition; outcomes: row_id, item_id, outcome of accepted messages;
    updates and links: what was founded and joined; states: item_id, status, failure_count,
    last_failure_code and error of every item."""

    dispositions: DataFrame
    outcomes: DataFrame
    updates: DataFrame
    links: DataFrame
    states: DataFrame


def over_contract(items: DataFrame, at: Column) -> DataFrame:
    """Failures of items whose title or excerpt is longer than the analysis takes: terminal, not cut."""
    bad = items.where(too_long("title", K.REQUEST_TITLE_MAX) | too_long("excerpt", K.REQUEST_EXCERPT_MAX))
    return bad.select(
        "item_id", at.alias("failed_at"), F.col("item_id").alias("failure_id"),
        F.lit("IntelligenceValidation").alias("failure_code"), F.lit(True).alias("is_validation"),
    )


def process_messages(
    lines: DataFrame,
    items: DataFrame,
    outbox: DataFrame,
    receipts: DataFrame,
    links: DataFrame,
    as_of: Column,
    stored: DataFrame | None = None,
    lexicon: list[str] | None = None,
    options: GroupingOptions = GroupingOptions(),
    strict: bool = True,
) -> MessageResult:
    """One pass over message lines (row_id, body).

    Malformed and mismatched messages go no further. Accepted items that are missing, final or linked
    already are skipped, the others are analysed and grouped against ``stored`` updates and each
    other, and become Processed. With ``strict``, over-long items fail for good; otherwise the
    analysis cuts them. Doing the pass again with its links changes nothing.
    """
    typed, malformed = read_messages(lines)
    judged = materialize(validate_messages(typed, items, outbox, receipts))
    none = F.lit(None).cast(judged.schema["item_id"].dataType).alias("item_id")
    dispositions = judged.select("row_id", "item_id", "disposition").unionByName(
        malformed.select("row_id", none, F.lit("malformed").alias("disposition"))
    )
    accepted = judged.where("disposition = 'accepted'").select("row_id", "item_id")
    outcomes = materialize(commit_outcomes(accepted, items, links))
    named = outcomes.where("outcome = 'Grouped'").select("item_id").distinct()
    due = materialize(items.join(named, "item_id", "left_semi"))
    failures = materialize(over_contract(due, as_of) if strict else over_contract(due, as_of).limit(0))
    good = materialize(due.join(failures, "item_id", "left_anti"))
    analyses = materialize(analyze_items(good, lexicon))
    updates, joined = group_items(grouping_input(good, analyses), as_of, options, stored)
    failed = apply_failures(items, failures)
    states = failed.drop("status").join(mark_processed(failed, joined), "item_id")
    return MessageResult(dispositions, outcomes, updates, joined, states)
