"""Joins that stay balanced when one key holds a large share of the rows.

Nothing is counted beforehand and nothing is broadcast here: which side is broadcast is left to the planner and to the
sizes that adaptive execution measures, and adaptive execution cuts the partitions of keys that turn out large
(``spark.sql.adaptive.skewJoin``, set by ``session.configure``). What it cannot cut well is taken out before: rows
without a key match nothing, so they are dealt out under salts of their own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NO_KEY_PARTS = 1 << 10


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], spread: Column, leave_out: str | None = None) -> DataFrame:
    """Left join ``rows`` to ``table``, which has one row per key.

    Rows without a key are spread by ``spread``. ``leave_out`` names a column of ``table`` that is not wanted.
    """
    values = [c for c in table.columns if c not in keys and c != leave_out]
    no_key = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    apart = F.lit(1) + F.pmod(F.xxhash64(spread), F.lit(NO_KEY_PARTS)).cast("int")
    left = rows.withColumn("_salt", F.when(no_key, apart).otherwise(F.lit(0)))
    right = table.select(*keys, F.struct(*values).alias("_found"), F.lit(0).alias("_salt"))
    joined = left.join(right, [*keys, "_salt"], "left")
    return joined.select(*rows.columns, *[F.col("_found")[v].alias(v) for v in values])
