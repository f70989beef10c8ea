"""Times, digests and small value tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from updatelens.functions.text import is_blank, let, trim_ws
from updatelens.options import ScoringOptions

# Accepted time patterns, tried in order after the weekday name is dropped.
TIME_PATTERNS = (
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]XXX",
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]XX",
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]",
    "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]XXX",
    "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]",
    "yyyy-MM-dd'T'HH:mmXXX",
    "yyyy-MM-dd'T'HH:mm",
    "yyyy-MM-dd",
    "d MMM yyyy HH:mm:ss XX",
    "d MMM yyyy HH:mm:ss XXX",
    "d MMM yyyy HH:mm XX",
    "d MMM yyyy HH:mm:ss",
    "d MMM yyyy HH:mm",
    "d MMM yyyy",
    "d MMMM yyyy HH:mm:ss XX",
    "d MMMM yyyy HH:mm:ss XXX",
    "d MMMM yyyy HH:mm XX",
    "d MMMM yyyy HH:mm:ss",
    "d MMMM yyyy HH:mm",
    "d MMMM yyyy",
)


def parse_utc(c: Column) -> Column:
    """ISO-8601 or mail-style time to a UTC timestamp; no offset means UTC; unreadable is null.

    Fractions are cut to microseconds. Years of two digits lie between 1950 and 2049.
    """
    text = F.regexp_replace(F.regexp_replace(trim_ws(c), r"^[A-Za-z]{3,9},\s*", ""), r"\s+", " ")
    text = F.regexp_replace(text, r" (GMT|UTC|UT|Z)$", " +0000")
    text = F.regexp_replace(text, r"(\.\d{6})\d+", "$1")
    text = F.regexp_replace(text, r"^(\d{1,2} [A-Za-z]{3,9}) ([0-4]\d)(?= |$)", "$1 20$2")
    text = F.regexp_replace(text, r"^(\d{1,2} [A-Za-z]{3,9}) ([5-9]\d)(?= |$)", "$1 19$2")
    return let(text, lambda t: F.coalesce(*[F.try_to_timestamp(t, F.lit(p)) for p in TIME_PATTERNS]))


def observed_at(published: Column | str, retrieved: Column | str) -> Column:
    return F.coalesce(published, retrieved)


def sha256_upper(c: Column | str) -> Column:
    return F.upper(F.sha2(F.col(c) if isinstance(c, str) else c, 256))


def content_hash(title: Column, excerpt: Column) -> Column:
    """Digest of title and excerpt; an item without an excerpt has none."""
    return F.when(~is_blank(excerpt), sha256_upper(F.concat_ws("\n", title, excerpt)))


def parse_feedback(c: Column) -> Column:
    value = F.lower(trim_ws(c))
    return F.when(value == "relevant", F.lit("Relevant")).when(value == "notrelevant", F.lit("NotRelevant"))


def feedback_wire(c: Column) -> Column:
    return F.when(c == "Relevant", F.lit("relevant")).when(c == "NotRelevant", F.lit("notRelevant"))


def priority_rank(c: Column) -> Column:
    return F.when(c == "High", 3).when(c == "Medium", 2).when(c == "Low", 1)


def priority_weight(c: Column, o: ScoringOptions = ScoringOptions()) -> Column:
    return (
        F.when(c == "High", F.lit(o.high_weight))
        .when(c == "Medium", F.lit(o.medium_weight))
        .when(c == "Low", F.lit(o.low_weight))
    )


def impact_points(level: Column, o: ScoringOptions = ScoringOptions()) -> Column:
    return (
        F.when(level == "high", F.lit(o.impact_high))
        .when(level == "medium", F.lit(o.impact_medium))
        .otherwise(F.lit(0.0))
    )

