"""Structured Streaming jobs: items, groups, feedback and late arrivals.

State that other jobs also read (items, updates, links) is kept in tables, one partition per
micro-batch. A batch that is run again replaces its own partition, so results are written once.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from updatelens.functions.links import url_host
from updatelens.functions.values import observed_at
from updatelens.operators import features as X
from updatelens.operators import grouping as G
from updatelens.operators.dedup import dedup_items
from updatelens.operators.interactions import latest_feedback
from updatelens.operators.scoring import score_updates
from updatelens.options import DedupOptions, GroupingOptions, ScoringOptions
from updatelens.plans.ingest import ingest_feeds
from updatelens.plans.relevance import grouping_input
from updatelens.session import materialize, scratch_dir
from updatelens.skew import lookup
from updatelens.sources.sinks import read_table

Prepare = Callable[[DataFrame], DataFrame]


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Store a micro-batch's rows under its id, replacing an earlier attempt, also by no rows."""
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def before_batch(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    """Rows stored by earlier micro-batches."""
    stored = read_table(spark, path)
    return None if stored is None else stored.where(F.col("batch_id") < batch_id).drop("batch_id")


def read_tables(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    """A stream over the parquet files of one table in a folder."""
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


# Everything there is, then stop. Pass {"processingTime": "1 minute"} and the like to go on.
ONCE = {"availableNow": True}


def store_items(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    prepare: Prepare,
    options: DedupOptions = DedupOptions(),
    trigger: dict = ONCE,
) -> StreamingQuery:
    """Prepare each micro-batch as items, drop repeats within it and of stored items, store the rest."""

    def run(batch: DataFrame, batch_id: int) -> None:
        items = materialize(prepare(batch))
        kept, _ = dedup_items(items, before_batch(batch.sparkSession, path, batch_id), options)
        write_batch(kept, path, batch_id)

    return (
        stream.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


# One row for each update a micro-batch touched: all that grouping and scoring need to know of it.
STATE = (
    "update_id {id}, representative_title string, primary_topic string, first_observed_at timestamp, last_observed_at timestamp, "
    "newest_at timestamp, hosts array<string>, impact struct<received_at:timestamp,item_id:{id},level:string>, "
    "interests array<struct<interest_id:string,strength:double>>"
)


def live_updates(spark: SparkSession, folder: str, batch_id: int, since: Column, id_type: str) -> DataFrame:
    """The updates last observed at or after ``since``, as earlier micro-batches left them.

    The state lies in a partition for each day of the last observation, so days before ``since`` are not read.
    """
    log = read_table(spark, f"{folder}/updates", f"{STATE.format(id=id_type)}, batch_id int, day date")
    if log is None:
        return spark.createDataFrame([], STATE.format(id=id_type))
    recent = log.where((F.col("day") >= F.to_date(since)) & (F.col("batch_id") < batch_id))
    columns = [c for c in recent.columns if c not in ("batch_id", "day", "update_id")]
    newest = recent.groupBy("update_id").agg(F.max_by(F.struct(*columns), "batch_id").alias("_m"))
    return newest.select("update_id", "_m.*")


def _next_state(
    stored: DataFrame, fresh: DataFrame, links: DataFrame, items: DataFrame, analyses: DataFrame, met: DataFrame, sources: DataFrame
) -> DataFrame:
    """State of the updates that a micro-batch touched: what was stored, widened by the batch's items."""
    hosts = sources.select("source_id", url_host(F.col("feed_url")).alias("_host"))
    facts = items.select("item_id", "source_id", observed_at("published_at", "retrieved_at").alias("_at"), "retrieved_at")
    facts = lookup(facts, hosts, ["source_id"], F.col("item_id")).join(analyses.select("item_id", "impact_level"), "item_id")
    impact = F.struct(
        F.col("retrieved_at").alias("received_at"), F.col("item_id"), F.col("impact_level").alias("level")
    )
    added = links.select("update_id", "item_id").join(facts, "item_id").groupBy("update_id").agg(
        F.max("_at").alias("_newest"), F.collect_set("_host").alias("_hosts"), F.max(impact).alias("_impact")
    )
    old = stored.select("update_id", F.struct(*[c for c in stored.columns if c != "update_id"]).alias("_old"))
    known = fresh.drop("item_count").join(added, "update_id").join(old, "update_id", "left")
    touched = links.select("update_id").distinct()
    earlier = stored.join(touched, "update_id", "left_semi").select("update_id", F.inline("interests"))
    interests = (
        met.select("update_id", "interest_id", "strength").unionByName(earlier)
        .groupBy("update_id", "interest_id").agg(F.max("strength").alias("strength"))
        .groupBy("update_id").agg(F.sort_array(F.collect_list(F.struct("interest_id", "strength"))).alias("interests"))
    )
    none = F.array().cast("array<string>")
    state = known.select(
        "update_id",
        F.coalesce("_old.representative_title", "representative_title").alias("representative_title"),
        F.coalesce("_old.primary_topic", "primary_topic").alias("primary_topic"),
        F.least("_old.first_observed_at", "first_observed_at").alias("first_observed_at"),
        F.greatest("_old.last_observed_at", "last_observed_at").alias("last_observed_at"),
        F.greatest("_old.newest_at", "_newest").alias("newest_at"),
        F.array_sort(F.array_union(F.coalesce("_old.hosts", none), "_hosts")).alias("hosts"),
        F.greatest("_old.impact", "_impact").alias("impact"),
    )
    return state.join(interests, "update_id", "left").withColumn(
        "interests", F.coalesce("interests", F.array().cast("array<struct<interest_id:string,strength:double>>"))
    )


def split_late(batch: DataFrame, batch_id: int, folder: str, hours: int | None) -> tuple[DataFrame, DataFrame | None]:
    """(on time, late): items observed more than ``hours`` before the latest item of earlier micro-batches are late.

    This is the rule of a watermark, whose late rows Spark would drop unseen. The latest time of each batch is kept in a
    table, so a batch that is run again is split in the same way.
    """
    if hours is None:
        return batch, None
    spark, seen = batch.sparkSession, observed_at("published_at", "retrieved_at")
    high = batch.agg(F.max(seen).alias("high"))
    past = read_table(spark, f"{folder}/watermark", "high timestamp, batch_id int")
    before = None if past is None else past.where(F.col("batch_id") < batch_id).agg(F.max("high")).first()[0]
    write_batch(high, f"{folder}/watermark", batch_id)
    if before is None:
        return batch, batch.limit(0)
    late = F.coalesce(seen < F.lit(before) - F.make_dt_interval(hours=F.lit(hours)), F.lit(False))
    return batch.where(~late), batch.where(late)


def store_groups(
    stream: DataFrame,
    folder: str,
    checkpoint: str,
    interests: DataFrame,
    sources: DataFrame,
    as_of: Column,
    grouping: GroupingOptions = GroupingOptions(),
    scoring: ScoringOptions = ScoringOptions(),
    lexicon: list[str] | None = None,
    trigger: dict = ONCE,
    late_after: int | None = None,
    prepare: Prepare = lambda batch: batch,
) -> StreamingQuery:
    """Group each micro-batch of items with the stored updates and re-score what it touched.

    Tables below ``folder``, a partition for each micro-batch: items, analyses, links, update_interests, updates (the state of
    what the batch touched), scores (newest batch counts), and late (items that came after ``late_after`` hours).
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        group_batch(prepare(batch), batch_id, folder, interests, sources, as_of, grouping, scoring, lexicon, late_after)

    return (
        stream.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def group_batch(
    batch: DataFrame,
    batch_id: int,
    folder: str,
    interests: DataFrame,
    sources: DataFrame,
    as_of: Column,
    grouping: GroupingOptions = GroupingOptions(),
    scoring: ScoringOptions = ScoringOptions(),
    lexicon: list[str] | None = None,
    late_after: int | None = None,
) -> None:
    """One micro-batch. Of what earlier ones stored only the updates of the window are read."""
    spark = batch.sparkSession
    items, late = split_late(materialize(batch), batch_id, folder, late_after)
    if late is not None:
        write_batch(late, f"{folder}/late", batch_id)
    analyses = materialize(X.analyze_items(items, lexicon))
    id_type = items.schema["item_id"].dataType.simpleString()
    stored = materialize(live_updates(spark, folder, batch_id, G.window_start(as_of, grouping), id_type))
    fresh, links = G.group_items(grouping_input(items, analyses), as_of, grouping, stored)
    matches = X.interest_match(analyses, "item_id", "tokens", interests.where("is_active"))
    met = materialize(G.upsert_matches(links, matches.withColumn("matched_at", as_of)))
    state = materialize(_next_state(stored, fresh, links, items, analyses, met, sources))
    write_batch(items, f"{folder}/items", batch_id)
    write_batch(analyses.select("item_id", "impact_level"), f"{folder}/analyses", batch_id)
    write_batch(links, f"{folder}/links", batch_id)
    write_batch(met, f"{folder}/update_interests", batch_id)
    days = state.withColumn("day", F.to_date("last_observed_at"))
    days.write.mode("overwrite").partitionBy("day").parquet(f"{folder}/updates/batch_id={batch_id}")
    signals = state.select(
        "update_id", "newest_at", F.size("hosts").alias("host_count"), F.col("impact.level").alias("impact_level")
    )
    active = X.active_matches(state.select("update_id", F.inline("interests")), interests)
    write_batch(score_updates(signals, active, as_of, scoring), f"{folder}/scores", batch_id)


def newest_scores(log: DataFrame) -> DataFrame:
    """Score of each update from the last micro-batch that touched it."""
    last = log.groupBy("update_id").agg(F.max(F.struct("batch_id", "score", "meets_threshold")).alias("m"))
    return last.select("update_id", F.col("m.score").alias("score"), F.col("m.meets_threshold").alias("meets_threshold"))


def store_latest_feedback(stream: DataFrame, path: str, checkpoint: str, trigger: dict = ONCE) -> StreamingQuery:
    """Keep the current feedback per update in streaming state and log each change.

    ``newest_feedback`` reads the log."""

    def run(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, path, batch_id)

    return (
        latest_feedback(stream).writeStream.outputMode("update").foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def newest_feedback(log: DataFrame) -> DataFrame:
    return latest_feedback(log)


def store_feedback_with_clears(
    feedback: DataFrame, clears: DataFrame, path: str, checkpoint: str, trigger: dict = ONCE
) -> StreamingQuery:
    """Keep per update the newest feedback and the last clear, two streams in one state, and log each change.

    Both are maxima, so the state does not depend on the order in which feedback and clears arrive; whether the
    feedback stands is read off the pair. ``standing_feedback`` reads the log.
    """
    said = feedback.select("update_id", F.struct("created_at", "feedback_id", "feedback_type").alias("newest"))
    gone = clears.select("update_id", F.struct("cleared_at", "clear_id").alias("cleared"))
    both = said.unionByName(gone, allowMissingColumns=True)
    state = both.groupBy("update_id").agg(F.max("newest").alias("newest"), F.max("cleared").alias("cleared"))

    def run(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, path, batch_id)

    return (
        state.writeStream.outputMode("update").foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def standing_feedback(log: DataFrame) -> DataFrame:
    """Current feedback per update: the newest, if it came after the last clear."""
    last = log.groupBy("update_id").agg(F.max("newest").alias("f"), F.max("cleared").alias("c"))
    after = F.struct("f.created_at", "f.feedback_id") > F.col("c")
    return last.where(F.col("f").isNotNull() & (F.col("c").isNull() | after)).select(
        "update_id", F.col("f.feedback_type").alias("feedback_type"), F.col("f.created_at").alias("created_at"),
        F.col("f.feedback_id").alias("feedback_id"),
    )


def store_on_time(stream: DataFrame, folder: str, checkpoint: str, hours: int, prepare: Prepare, trigger: dict = ONCE) -> StreamingQuery:
    """Items on time and late ones, each in their own table below ``folder``."""

    def run(batch: DataFrame, batch_id: int) -> None:
        good, late = split_late(materialize(prepare(batch)), batch_id, folder, hours)
        write_batch(good, f"{folder}/on_time", batch_id)
        write_batch(late, f"{folder}/late", batch_id)

    return (
        stream.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def store_feeds(
    stream: DataFrame,
    folder: str,
    checkpoint: str,
    sources: DataFrame,
    options: DedupOptions = DedupOptions(),
    trigger: dict = ONCE,
) -> StreamingQuery:
    """Raw feed documents (source_id, feed_url, payload, retrieved_at) to stored items.

    Each micro-batch is parsed, checked, cleaned and compared with what earlier ones stored, of which only the columns
    that are compared are read. Its moment is its latest ``retrieved_at``. Tables below ``folder``: items, duplicates,
    bad_items, rejected_feeds and runs.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        batch = materialize(batch)
        moment = F.lit(batch.agg(F.max("retrieved_at")).first()[0]).cast("timestamp")
        stored = before_batch(batch.sparkSession, f"{folder}/items", batch_id)
        done = ingest_feeds(batch.drop("retrieved_at"), sources, moment, stored, options)
        for name in ("items", "duplicates", "bad_items", "rejected_feeds", "runs"):
            write_batch(getattr(done, name), f"{folder}/{name}", batch_id)

    return (
        stream.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def late_items(items: DataFrame, arrived_at: Column, options: GroupingOptions = GroupingOptions()) -> DataFrame:
    """Items that were older than the grouping window when they arrived. Works on tables and streams."""
    return items.where(F.col("observed_at") < G.window_start(arrived_at, options))


# --- registered runs over the test tables -----------------------------------------------------------


def run_latest_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    from updatelens.workload import adapters as A

    A.configure(spark)
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = read_tables(spark, sf_dir, "events", schema)
    base = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"
    store_latest_feedback(A.feedback(spark, sf_dir, events), f"{base}/log", f"{base}/state").awaitTermination()
    return newest_feedback(spark.read.parquet(f"{base}/log"))


def arrivals(df: DataFrame, batch: Column, n: int, base: str, start: Callable[[DataFrame], StreamingQuery]) -> None:
    """Let ``df`` arrive in ``n`` parts by the number ``batch``, each taken by a stream that goes on from its checkpoint."""
    spark = df.sparkSession
    for part in range(n):
        df.where(batch == part).write.mode("append").parquet(f"{base}/in")
        start(spark.readStream.schema(df.schema).parquet(f"{base}/in")).awaitTermination()


def _base(spark: SparkSession) -> str:
    return f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"


BATCHES = 4


def by_time() -> Column:
    """Which of four parts of the retrieval times a document belongs to."""
    return F.floor(F.col("doc_id") % 1080 / F.lit(1080 // BATCHES))


def run_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    from updatelens.workload import adapters as A

    docs, base = A.table(spark, sf_dir, "documents"), _base(spark)
    arrivals(docs, by_time(), BATCHES, base, lambda s: store_items(s, f"{base}/items", f"{base}/state", lambda b: A.items(spark, sf_dir, b)))
    return spark.read.parquet(f"{base}/items").select("item_id")


def run_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feeds come in four batches; every second one comes again, unchanged, in the next batch."""
    from updatelens.workload import adapters as A

    A.configure(spark)
    feeds, base = A.feeds(spark, sf_dir), _base(spark)
    turns = F.array(F.col("source_id") % BATCHES, F.when(F.col("source_id") % 8 < BATCHES, F.col("source_id") % BATCHES + 1))
    polled = feeds.select("*", F.explode(F.filter(turns, lambda t: t < BATCHES)).alias("turn"))
    polled = polled.withColumn("retrieved_at", F.timestamp_add("HOUR", F.col("turn").cast("int"), F.lit("2024-01-01").cast("timestamp")))
    sources = feeds.select("source_id", F.lit(None).cast("string").alias("validator")).limit(0)
    arrivals(polled, F.col("turn"), BATCHES, base, lambda s: store_feeds(s.drop("turn"), base, f"{base}/state", sources))
    return spark.read.parquet(f"{base}/items").select("source_id", "external_id", "batch_id")


def run_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from updatelens.workload import adapters as A

    docs, base = A.table(spark, sf_dir, "documents"), _base(spark)
    arrivals(
        docs, by_time(), BATCHES, base,
        lambda s: store_groups(
            s, base, f"{base}/state", A.interests(spark), A.feed_sources(spark, sf_dir), A.as_of(), GroupingOptions(window_hours=744),
            lexicon=A.LEXICON, prepare=lambda b: A.items(spark, sf_dir, b),
        ),
    )
    scores = newest_scores(spark.read.parquet(f"{base}/scores"))
    return scores.select("update_id", F.round("score", 6).alias("score"), "meets_threshold")


def run_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items in an order that is not that of their times: by id; 48 hours may pass."""
    from updatelens.workload import adapters as A

    docs, base = A.table(spark, sf_dir, "documents"), _base(spark)
    turn = F.floor(F.col("doc_id") / 7).cast("long") % BATCHES
    arrivals(docs, turn, BATCHES, base, lambda s: store_on_time(s, base, f"{base}/state", 48, lambda b: A.items(spark, sf_dir, b)))
    both = [spark.read.parquet(f"{base}/{name}").select("item_id", F.lit(name == "late").alias("late")) for name in ("on_time", "late")]
    return both[0].unionByName(both[1])


def run_feedback_with_clears(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback and clears of all times mixed over four batches."""
    from updatelens.workload import adapters as A

    events, base = A.table(spark, sf_dir, "events"), _base(spark)
    turn = F.col("event_id") % BATCHES
    arrivals(
        events, turn, BATCHES, base,
        lambda s: store_feedback_with_clears(A.feedback(spark, sf_dir, s), A.clears(spark, sf_dir, s), f"{base}/log", f"{base}/state"),
    )
    return standing_feedback(spark.read.parquet(f"{base}/log"))
