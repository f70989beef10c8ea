"""Item-ready messages as JSON text with a closed schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from updatelens import constants as K
from updatelens.functions.text import clean_optional, is_blank, let
from updatelens.session import materialize

# Message fields, required ones first.
REQUIRED = {"messageId": "message_id", "sourceItemId": "item_id", "correlationId": "correlation_id", "occurredAtUtc": "occurred_at"}
OPTIONAL = {"sourceId": "source_id", "ingestionRunId": "run_id", "traceParent": "trace_parent"}


def _parsed(body: Column) -> Column:
    fields = ", ".join(
        f"{name} {'timestamp' if name == 'occurredAtUtc' else 'string'}" for name in [*REQUIRED, *OPTIONAL]
    )
    return F.from_json(body, f"{fields}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})


def read_messages(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Typed messages of (row_id, body). Returns (typed, malformed).

    A row is malformed when its JSON does not parse, a required field is missing or blank, a field
    has the wrong type or is unknown, or the trace text is too long.
    """
    known = F.array(*[F.lit(n) for n in [*REQUIRED, *OPTIONAL]])

    def reason(m: Column, names: Column) -> Column:
        found = (
            F.when(m.isNull() | names.isNull(), F.lit("not_json"))
            .when(F.size(F.array_except(names, known)) > 0, F.lit("unknown_field"))
            .when(m["_bad"].isNotNull(), F.lit("wrong_type"))
        )
        for name in REQUIRED:
            found = found.when(is_blank(m[name].cast("string")), F.lit("missing_field"))
        for name in ("sourceId", "ingestionRunId"):
            found = found.when(m[name].isNotNull() & is_blank(m[name]), F.lit("missing_field"))
        return found.when(
            F.char_length(clean_optional(m["traceParent"])) > K.TRACE_MAX, F.lit("trace_too_long")
        )

    parts = F.struct(_parsed(F.col("body")).alias("m"), F.json_object_keys("body").alias("names"))
    judge = let(parts, lambda p: F.struct(p["m"].alias("m"), reason(p["m"], p["names"]).alias("reason")))
    # The outer form keeps the two filters from parsing the text again.
    judged = lines.select("row_id", "body", F.inline_outer(F.array(judge)))
    kept_body = F.when(F.col("reason").isNotNull(), F.col("body")).alias("body")
    # Written, so that taking the two parts apart does not read the text twice.
    judged = materialize(judged.select("row_id", kept_body, "m", "reason"))
    m = F.col("m")
    fields = [
        (clean_optional(m[n]) if n == "traceParent" else m[n]).alias(c) for n, c in {**REQUIRED, **OPTIONAL}.items()
    ]
    typed = judged.where("reason IS NULL").select("row_id", *fields)
    return typed, judged.where("reason IS NOT NULL").select("row_id", "body", "reason")
