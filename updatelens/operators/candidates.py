"""Items against stored updates without a limit on candidates, and the stored prefix index for it.

Items and updates of a topic are compared in the tiles of ``tiles``. An item can only be similar to an update if both share,
in a topic, one of the tokens that each cannot do without (the exact prefix filter of ``grouping``); the index keeps these
tokens, so that a probe compares only updates that share one with some item. Equal texts are one text on both sides, so copies
cost one comparison; of updates with equal texts the smallest id answers, as it does among equal similarities.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from updatelens.functions import text as T
from updatelens.operators import grouping as G
from updatelens.operators.features import with_counts
from updatelens.operators.tiles import side, similar
from updatelens.options import GroupingOptions
from updatelens.session import materialize
from updatelens.sources.sinks import read_table


def _item_texts(items: DataFrame) -> DataFrame:
    """(item_id, id, topics, probe, probe_norm): ``id`` is shared by items that are alike for grouping."""
    shaped = items.select(
        "item_id",
        F.sort_array(G.topic_keys(F.col("topics"), F.col("primary_topic"))).alias("topics"),
        T.tokenize(G.probe_text(F.col("title"), F.col("primary_topic"))).alias("_p"),
    )
    return with_counts(shaped, "_p", "probe").select(
        "item_id", F.sha2(F.to_json(F.struct("topics", "probe")), 256).alias("id"), "topics", "probe",
        G.squared_norm(F.col("probe")).alias("probe_norm"),
    )


def _update_texts(updates: DataFrame) -> DataFrame:
    """(update_id, last_observed_at, id, topic, rep, rep_norm) of stored updates."""
    shaped = updates.select(
        "update_id", "last_observed_at", F.lower("primary_topic").alias("topic"),
        T.tokenize(G.representative_text(F.col("representative_title"), F.col("primary_topic"))).alias("_r"),
    )
    return with_counts(shaped, "_r", "rep").select(
        "update_id", "last_observed_at", F.sha2(F.to_json(F.struct("topic", "rep")), 256).alias("id"), "topic", "rep",
        G.squared_norm(F.col("rep")).alias("rep_norm"),
    )


def _one_each(texts: DataFrame, *columns: str) -> DataFrame:
    return texts.groupBy("id").agg(*[F.any_value(c).alias(c) for c in columns])


def _update_entries(texts: DataFrame, order: DataFrame, threshold: float) -> DataFrame:
    """Prefix entries (id, topic, token, reach) of distinct update texts."""
    return G._block_entries(texts, "rep", F.array("topic"), order, threshold)


def _order_of(texts: DataFrame) -> DataFrame:
    return G._token_order(texts.select(F.col("rep").alias("probe")))


def _assign(items: DataFrame, texts: DataFrame, since: Column, threshold: float, entries: DataFrame | None = None, order: DataFrame | None = None) -> DataFrame:
    """Best update of each item: (item_id, update_id, similarity), null where none reaches the threshold.

    With ``entries`` only texts that share one with an item are compared.
    """
    probes = materialize(_item_texts(items))
    distinct = materialize(_one_each(probes, "topics", "probe", "probe_norm"))
    live = texts.where(F.col("last_observed_at") >= since)
    answers = live.groupBy("id").agg(*[F.any_value(c).alias(c) for c in ("topic", "rep", "rep_norm")], F.min("update_id").alias("update_id"))
    if entries is not None:
        near = G._block_entries(distinct, "probe", F.col("topics"), order, threshold).select("topic", "token").distinct()
        answers = answers.join(entries.join(near, ["topic", "token"], "left_semi").select("id"), "id", "left_semi")
    answers = materialize(answers)
    spread = distinct.withColumn("_topic", F.explode("topics"))
    left = side(spread, F.col("_topic"), "probe", "probe_norm", F.lit(0), F.col("id"))
    right = side(answers, F.col("topic"), "rep", "rep_norm", F.lit(0), F.col("update_id"))
    scored = similar(left, right, threshold, "best")
    named = scored.join(answers.select(F.col("id").alias("rep_id"), "update_id"), "rep_id")
    best = named.groupBy(F.col("probe_id").alias("id")).agg(
        F.min(F.struct((-F.col("similarity")).alias("s"), F.col("update_id").alias("u"))).alias("b")
    )
    return probes.select("item_id", "id").join(best, "id", "left").select(
        "item_id", F.col("b.u").alias("update_id"), (-F.col("b.s")).alias("similarity")
    )


def assign_among_all(
    items: DataFrame, updates: DataFrame, as_of: Column, options: GroupingOptions = GroupingOptions()
) -> DataFrame:
    """Merge target of each item among all stored updates of the window, as ``grouping.assign_to_updates`` gives it."""
    since, threshold = G.window_start(as_of, options), options.merge_threshold
    texts = materialize(_update_texts(updates.where(F.col("last_observed_at") >= since)))
    return _assign(items, texts, since, threshold)


# --- stored index ---------------------------------------------------------------------------------
#
# ``order`` holds the common tokens of the first batch. Both sides must rank tokens alike, so it never changes; any order
# gives exact results. ``entries`` and ``texts`` lie under batch_id and the day of the last observation: a probe reads the
# days of its window only. An update that is observed again is added again, so its newest row is in the newest day.


def _day(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd")


def index_updates(
    path: str, batch_id: int, updates: DataFrame, options: GroupingOptions = GroupingOptions()
) -> None:
    """Add a batch's new or newly observed updates to the index at ``path``; adding it again replaces it.

    updates: update_id, representative_title, primary_topic, last_observed_at. The index serves the merge threshold it is
    built with and higher ones. Updates without a time are in no window and are left out.
    """
    spark = updates.sparkSession
    texts = materialize(_update_texts(updates.where("last_observed_at IS NOT NULL")))
    dated = texts.withColumn("day", _day(F.col("last_observed_at")))
    order = read_table(spark, f"{path}/order")
    if order is None:
        _order_of(_one_each(texts, "rep")).coalesce(1).write.mode("overwrite").parquet(f"{path}/order")
        order = spark.read.parquet(f"{path}/order")
    days = dated.select("id", "day").distinct()
    entries = _update_entries(_one_each(texts, "topic", "rep", "rep_norm"), order, options.merge_threshold).join(days, "id")
    # Entries of a day lie in the order of their tokens, so a selective probe skips row groups.
    entries.hint("rebalance", "day").sortWithinPartitions("day", "token", "topic").write.mode("overwrite").partitionBy(
        "day"
    ).parquet(f"{path}/entries/batch_id={batch_id}")
    dated.hint("rebalance", "day").write.mode("overwrite").partitionBy("day").parquet(f"{path}/texts/batch_id={batch_id}")


def _indexed(spark: SparkSession, path: str, before: int | None, since: Column, columns: list[str]) -> DataFrame:
    rows = spark.read.parquet(path).where(F.col("day").cast("string") >= _day(since))
    return (rows if before is None else rows.where(F.col("batch_id") < before)).select(*columns)


def assign_by_index(
    path: str, items: DataFrame, as_of: Column, options: GroupingOptions = GroupingOptions(), before: int | None = None
) -> DataFrame:
    """Merge target of each item among the indexed updates: (item_id, update_id, similarity).

    ``before`` leaves out that batch and later ones, so a batch that runs again meets the same updates.
    """
    spark, since = items.sparkSession, G.window_start(as_of, options)
    order = read_table(spark, f"{path}/order")
    if order is None:
        none = F.lit(None)
        return items.select("item_id", none.cast("string").alias("update_id"), none.cast("double").alias("similarity"))
    texts = _indexed(
        spark, f"{path}/texts", before, since, ["update_id", "last_observed_at", "id", "topic", "rep", "rep_norm"]
    )
    entries = _indexed(spark, f"{path}/entries", before, since, ["id", "topic", "token", "reach"])
    return _assign(items, texts, since, options.merge_threshold, entries, order)
