"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from updatelens.session import configure, materialize

WORD = r"[^\x20\x09-\x0D]+"  # bytes.split() cuts at the same six characters
SALTS = 64
# A table is broadcast below this measured size; above it, its rows are repeated under salts.
BROADCAST_BYTES = 8 << 20

# A batch of long texts must fit a Python worker.
BATCH = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}


def session(spark: SparkSession) -> SparkSession:
    for key, value in BATCH.items():
        spark.conf.set(key, value)
    return configure(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return session(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _frame(batch: pa.RecordBatch) -> pd.DataFrame:
    """Whole numbers stay whole where some are null."""
    return batch.to_pandas(types_mapper={pa.int64(): pd.Int64Dtype(), pa.int32(): pd.Int32Dtype()}.get)


def map_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``fn`` on every Arrow batch of ``df``; rows stay where they are."""
    session(df.sparkSession)
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pandas(fn(_frame(batch)), schema=arrow, preserve_index=False)

    return df.mapInArrow(run, schema)


def filter_batches(df: DataFrame, keep: Callable[[list[str | None]], list[bool]], text: str = "text") -> DataFrame:
    """The rows of ``df`` whose text ``keep`` accepts; all columns pass as they are."""
    session(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
                yield batch.filter(pa.array(keep(texts), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def n_words(text: str = "text") -> Column:
    """The words of a text, by SQL functions only; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def n_bytes(text: str = "text") -> Column:
    return F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")


def attach(rows: DataFrame, facts: DataFrame, key: str, spread: Column) -> DataFrame:
    """Left join of ``rows`` to ``facts``, a written table with one row per key; a null key finds the null key.

    ``facts`` is broadcast if the bytes of its rows, as counted, are few. Otherwise every row of it
    is repeated under each salt and ``rows`` are salted by ``spread``, so a key with a third of all
    rows is read by many tasks.
    """
    values = [c for c in facts.columns if c != key]
    wide = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + 16 for c in facts.columns), F.lit(0))
    size = facts.agg(F.sum(wide)).first()[0] or 0
    right = facts.select(F.col(key).alias("_key"), F.struct(*values).alias("_facts"))
    if size <= BROADCAST_BYTES:
        joined = rows.join(F.broadcast(right), rows[key].eqNullSafe(right["_key"]), "left")
    else:
        right = right.withColumn("_at", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        left = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
        joined = left.join(right, left[key].eqNullSafe(right["_key"]) & (left["_salt"] == right["_at"]), "left")
    return joined.select(*[F.col(c) for c in rows.columns], *[F.col(f"_facts.{c}").alias(c) for c in values])


def in_order(rows: DataFrame, keys: list[str], sums: dict[str, str]) -> DataFrame:
    """``rows`` with ``_rank`` (from 1, over the whole table) and the running sums ``sums`` (new name: column).

    Ranges of the keys become partitions and are written once; the counts and sums of whole
    partitions (a row each) are then added to those within a partition. Equal rows may stand in
    any order; they are told apart by where they were read.
    """
    spark = rows.sparkSession
    ranged = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys, "_tie")
    placed = materialize(ranged.withColumn("_part", F.spark_partition_id()))
    names = {"_rank": F.lit(1), **{new: F.coalesce(F.col(old), F.lit(0)) for new, old in sums.items()}}
    whole = placed.groupBy("_part").agg(*[F.sum(c).cast("long").alias(n) for n, c in names.items()])
    whole = whole.orderBy("_part").collect()  # a row for each partition
    before, run = [], [0] * len(names)
    for part in whole:
        before.append((part["_part"], *run))
        run = [a + part[n] for a, n in zip(run, names)]
    schema = T.StructType(
        [T.StructField("_part", T.IntegerType())] + [T.StructField(f"_before{n}", T.LongType()) for n in names]
    )
    offsets = F.broadcast(spark.createDataFrame(before, schema))
    within = Window.partitionBy("_part").orderBy(*keys, "_tie").rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.select("*", *[F.sum(c).over(within).alias(n) for n, c in names.items()])
    out = summed.join(offsets, "_part", "left")
    return out.select(
        *rows.columns, *[(F.col(n) + F.col(f"_before{n}")).cast("long").alias(n) for n in names]
    )
