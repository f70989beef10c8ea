"""Removal of long repeated strings of bytes, by refinement of suffix buckets.

Suffixes start in buckets of their q-grams. Of a window of ``length`` bytes the bucket of its least
q-gram is kept, the same for every suffix of a run, so the table of bucket pointers is many times
shorter than the text. Buckets are refined by what stands at later offsets, first for whole runs and
then, only inside buckets that are still mixed, for single windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from updatelens.llm.repeats import Bytes, Task, remove


def remove_repeated_bytes(docs: DataFrame, length: int = 200, gram: int = 32) -> DataFrame:
    """Per row: doc_id, size in bytes, ``removed`` spans [start, end) and ``kept``, the other bytes.

    A byte is removed if a string of ``length`` bytes over it also starts elsewhere, in the same text
    too. A null text is empty. Equal rows count as separate texts, so both lose what they share. An
    empty table gives an empty result; other columns are not read. ``gram`` is a power of two below ``length``.
    """
    return remove(docs, Task(Bytes, length, gram, earlier=False))


def digest_rows(found: DataFrame, size: str) -> DataFrame:
    """The kept bytes of a removal as counts and a digest; ``size`` names the column of the size."""
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", F.col("size").alias(size), n_removed.alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )
