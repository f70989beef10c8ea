"""Streams give what one batch gives."""

from datetime import datetime, timedelta

from conftest import rows
from pyspark.sql import functions as F

from updatelens.operators.dedup import dedup_items
from updatelens.plans import relevance
from updatelens.session import scratch_dir
from updatelens.streaming import jobs

START = datetime(2024, 1, 30)
AS_OF = datetime(2024, 1, 31)
SCHEMA = (
    "item_id bigint, source_id string, external_id string, url_hash string, content_hash string, normalized_title string, "
    "title string, excerpt string, published_at timestamp, retrieved_at timestamp"
)


def items(n):
    out = []
    for i in range(n):
        title = f"release notes topic{i % 3} build"
        key = f"x{i % 4}" if i % 2 else None
        out.append((i, f"s{i % 2}", key, None, None, title.upper(), title, f"security words {i % 3}", None, START + timedelta(minutes=i)))
    return out


def test_items_over_several_batches(spark):
    base = f"{scratch_dir(spark)}/stream-items"
    every = spark.createDataFrame(items(12), SCHEMA)
    every.repartitionByRange(4, "item_id").write.parquet(f"{base}/in")
    stream = spark.readStream.schema(every.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    jobs.store_items(stream, f"{base}/out", f"{base}/state", lambda b: b).awaitTermination()
    stored = spark.read.parquet(f"{base}/out")
    assert stored.select("batch_id").distinct().count() > 1
    # Files may come in any order, so compare the number kept per key, which does not depend on it.
    kept, _ = dedup_items(every)
    assert stored.groupBy("source_id", "external_id").count().where("external_id IS NOT NULL AND count > 1").count() == 0
    assert stored.where("external_id IS NOT NULL").count() == kept.where("external_id IS NOT NULL").count()


def test_a_repeated_batch_changes_nothing(spark):
    base = f"{scratch_dir(spark)}/replay"
    batch = spark.createDataFrame(items(6), SCHEMA)
    for _ in range(2):
        jobs.write_batch(batch, base, 7)
    assert spark.read.parquet(base).count() == 6
    assert jobs.before_batch(spark, base, 7).count() == 0


def test_groups_one_item_at_a_time(spark):
    base = f"{scratch_dir(spark)}/stream-groups"
    interests = spark.createDataFrame([("i", "release", "High", True)], "interest_id string, name string, priority string, is_active boolean")
    sources = spark.createDataFrame([("s0", "https://a.test/r"), ("s1", "https://b.test/r")], "source_id string, feed_url string")
    data = items(4)
    for n, row in enumerate(data):
        jobs.group_batch(spark.createDataFrame([row], SCHEMA), n, base, interests, sources, F.lit(AS_OF))
    whole = relevance.score_items(spark.createDataFrame(data, SCHEMA), interests, sources, F.lit(AS_OF))
    links = spark.read.parquet(f"{base}/links")
    assert rows(links, "item_id", "update_id") == rows(whole.links, "item_id", "update_id")
    scores = jobs.newest_scores(spark.read.parquet(f"{base}/scores"))
    assert rows(scores, "update_id", "score") == rows(whole.scores, "update_id", "score")


def test_late_items(spark):
    df = spark.createDataFrame([(1, AS_OF - timedelta(hours=168)), (2, AS_OF - timedelta(hours=169))], "item_id int, observed_at timestamp")
    assert rows(jobs.late_items(df, F.lit(AS_OF)), "item_id") == [(2,)]


def test_groups_from_a_running_stream(spark):
    base = f"{scratch_dir(spark)}/running-groups"
    interests = spark.createDataFrame([("i", "release", "High", True)], "interest_id string, name string, priority string, is_active boolean")
    sources = spark.createDataFrame([("s0", "https://a.test/r"), ("s1", "https://b.test/r")], "source_id string, feed_url string")
    every = spark.createDataFrame(items(6), SCHEMA)
    every.coalesce(1).write.parquet(f"{base}/in")
    stream = spark.readStream.schema(every.schema).parquet(f"{base}/in")
    jobs.store_groups(stream, f"{base}/out", f"{base}/state", interests, sources, F.lit(AS_OF)).awaitTermination()
    whole = relevance.score_items(every, interests, sources, F.lit(AS_OF))
    scores = jobs.newest_scores(spark.read.parquet(f"{base}/out/scores"))
    assert rows(scores, "update_id", "score") == rows(whole.scores, "update_id", "score")


def interest_tables(spark):
    interests = spark.createDataFrame([("i", "release", "High", True)], "interest_id string, name string, priority string, is_active boolean")
    return interests, spark.createDataFrame([("s0", "https://a.test/r"), ("s1", "https://b.test/r")], "source_id string, feed_url string")


def test_a_batch_reads_only_days_of_the_window(spark):
    base = f"{scratch_dir(spark)}/window-groups"
    interests, sources = interest_tables(spark)
    data = [(n, "s0", None, None, None, f"T{n}", f"alone{n} word{n}", None, None, AS_OF - timedelta(days=a)) for n, a in ((2, 12), (4, 4))]
    data.append((6, "s1", None, None, None, "T4", "alone4 word4", None, None, AS_OF - timedelta(hours=1)))
    for n, row in enumerate(data):
        jobs.group_batch(spark.createDataFrame([row], SCHEMA), n, base, interests, sources, F.lit(AS_OF))
    live = jobs.live_updates(spark, base, 7, F.lit(AS_OF - timedelta(hours=168)), "bigint")
    assert rows(live, "update_id") == [(4,)]
    plan = live._jdf.queryExecution().executedPlan().toString()
    filters = plan.partition("PartitionFilters: [")[2].partition("]")[0]
    assert ">= 2024-01-24" in filters and "batch_id" in filters
    state = {r.update_id: r for r in live.collect()}
    assert state[4].hosts == ["a.test", "b.test"] and state[4].newest_at == AS_OF - timedelta(hours=1) and state[4].impact.item_id == 6
    assert state[4].representative_title == "alone4 word4" and state[4].first_observed_at == AS_OF - timedelta(days=4)
    scores = jobs.newest_scores(spark.read.parquet(f"{base}/scores"))
    whole = relevance.score_items(spark.createDataFrame(data, SCHEMA), interests, sources, F.lit(AS_OF))
    assert rows(scores, "update_id", "score") == rows(whole.scores, "update_id", "score")


def test_a_repeated_group_batch_changes_nothing(spark):
    base = f"{scratch_dir(spark)}/again-groups"
    interests, sources = interest_tables(spark)
    batches = [spark.createDataFrame(items(8)[a:b], SCHEMA) for a, b in ((0, 3), (3, 8))]
    results = []
    for order in ((0, 1), (1,)):
        for n in order:
            jobs.group_batch(batches[n], n, base, interests, sources, F.lit(AS_OF), late_after=1)
        tables = {"links": ["item_id", "update_id"], "scores": ["batch_id", "update_id", "score"], "late": ["item_id"]}
        results.append([rows(spark.read.parquet(f"{base}/{t}"), *c) for t, c in tables.items()])
    assert results[0] == results[1]


def test_late_items_go_to_their_own_table(spark):
    base = f"{scratch_dir(spark)}/late"
    ages = [(0, 10), (1, 2), (2, 30), (3, 27), (4, 25), (5, 1), (6, None)]  # hours before as_of; the watermark trails by 24
    late = {}
    for n, (i, age) in enumerate([*ages, (3, 27)]):
        at = None if age is None else AS_OF - timedelta(hours=age)
        row = (i, "s0", None, None, None, f"T{i}", f"alone{i}", None, None, at)
        batch = n if n < len(ages) else 3  # the last one is a batch that comes again
        good, bad = jobs.split_late(spark.createDataFrame([row], SCHEMA), batch, base, 24)
        late.setdefault(i, []).append((good.count(), bad.count()))
    assert late == {0: [(1, 0)], 1: [(1, 0)], 2: [(0, 1)], 3: [(0, 1), (0, 1)], 4: [(1, 0)], 5: [(1, 0)], 6: [(1, 0)]}


def test_feedback_and_clears_in_any_order(spark):
    base = f"{scratch_dir(spark)}/clears"
    at = [START + timedelta(minutes=m) for m in range(10)]
    told = "kind string, id bigint, update_id bigint, at timestamp"
    events = [("f", 1, 1, at[1]), ("c", 2, 1, at[2]), ("f", 3, 2, at[5]), ("c", 4, 2, at[4]), ("c", 5, 3, at[1]), ("f", 6, 4, at[3]), ("f", 7, 1, at[2]), ("f", 8, 5, at[6]), ("c", 9, 5, at[6])]
    for turn, part in enumerate((events[4:], events[:2], events[2:4])):
        spark.createDataFrame(part, told).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(told).parquet(f"{base}/in")
        feedback = stream.where("kind = 'f'").selectExpr("id AS feedback_id", "update_id", "'Relevant' AS feedback_type", "at AS created_at")
        clears = stream.where("kind = 'c'").selectExpr("id AS clear_id", "update_id", "at AS cleared_at")
        jobs.store_feedback_with_clears(feedback, clears, f"{base}/log", f"{base}/state").awaitTermination()
    got = jobs.standing_feedback(spark.read.parquet(f"{base}/log"))
    assert rows(got, "update_id", "feedback_id") == [(1, 7), (2, 3), (4, 6)]


def test_feeds_that_come_again_store_nothing(spark):
    base = f"{scratch_dir(spark)}/raw-feeds"
    rss = "<rss><channel><item><guid>{0}</guid><title>Title {0}</title><description>Text {1}.</description></item></channel></rss>"
    told = "source_id string, feed_url string, payload string, retrieved_at timestamp"
    batches = [
        [("a", "https://a.test/r", rss.format(1, 1), START), ("b", "https://b.test/r", "<rss>", START)],
        [("a", "https://a.test/r", rss.format(1, 2), START + timedelta(hours=1)), ("b", "https://b.test/r", rss.format(2, 3), START + timedelta(hours=1))],
        [("c", "https://c.test/r", rss.format(2, 3), START + timedelta(hours=2)), ("c2", "https://c.test/r", rss.format(2, 4), START + timedelta(hours=2))],
    ]
    sources = spark.createDataFrame([], "source_id string, validator string")
    for batch in batches:
        spark.createDataFrame(batch, told).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(told).parquet(f"{base}/in")
        jobs.store_feeds(stream, base, f"{base}/state", sources).awaitTermination()
    kept = spark.read.parquet(f"{base}/items")
    assert rows(kept, "batch_id", "source_id", "external_id") == [(0, "a", "1"), (1, "b", "2"), (2, "c2", "2")]
    assert rows(spark.read.parquet(f"{base}/duplicates"), "batch_id", "reason") == [(1, "external_id"), (2, "content_hash")]
    assert rows(spark.read.parquet(f"{base}/rejected_feeds"), "batch_id", "source_id") == [(0, "b")]
    assert spark.read.parquet(f"{base}/runs").groupBy("batch_id").count().count() == 3
