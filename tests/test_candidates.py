"""Items against all stored updates, directly and through the stored index, against a plain loop."""

import random
import tempfile
from datetime import datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F
from test_grouping import AS_OF, SCHEMA, cosine, random_items

from updatelens.operators import candidates as C
from updatelens.operators import grouping as G
from updatelens.options import GroupingOptions

UPDATES = "update_id bigint, representative_title string, primary_topic string, last_observed_at timestamp"
OPTIONS = GroupingOptions(merge_threshold=0.7)


def plain(items, updates, threshold):
    start, found = AS_OF - timedelta(hours=168), []
    for i in items:
        best = None
        for u, title, topic, at in updates:
            if at is None or at < start or topic not in {i[2], *i[3]}:
                continue
            s = cosine(f"{i[1]} {i[2]}", f"{title} {topic}")
            if s >= threshold and (best is None or (-s, u) < best):
                best = (-s, u)
        found.append((i[0], best and best[1], best and round(-best[0], 9)))
    return sorted(found)


def stored(seed, n, words):
    r = random.Random(seed)
    made = [
        (u, " ".join(r.choice(words) for _ in range(r.randint(1, 6))), r.choice(["alpha", "beta", "gamma"]), AS_OF - timedelta(hours=r.randrange(300)))
        for u in range(n)
    ]
    # Copies of one text: the smallest id inside the window answers.
    copies = [(u, "same words here", "alpha", AS_OF - timedelta(hours=400 if u < 1003 else 1)) for u in range(1000, 1200)]
    return [*made, *copies, (5000, "same words here", "alpha", None)]


def result(df):
    return rows(df.select("item_id", "update_id", F.round("similarity", 9).alias("similarity")), "item_id", "update_id", "similarity")


@pytest.fixture(scope="module")
def cases():
    words = "red green blue fast slow old new release".split()
    same = [(i, "same words here", "alpha", ["alpha"], AS_OF, AS_OF) for i in range(900, 1000)]
    return random_items(5, 150, words) + same, stored(6, 300, words)


def test_all_updates_of_the_window_count(spark, cases):
    items, updates = cases
    left, right = spark.createDataFrame(items, SCHEMA), spark.createDataFrame(updates, UPDATES)
    want = plain(items, updates, 0.7)
    assert sum(w[1] is not None for w in want) > 100
    assert result(G.assign_to_updates(left, right, F.lit(AS_OF), OPTIONS)) == want


def test_index_equals_the_direct_form(spark, cases):
    items, updates = cases
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/index"
    left = spark.createDataFrame(items, SCHEMA)
    assert {r.update_id for r in C.assign_by_index(path, left, F.lit(AS_OF), OPTIONS).collect()} == {None}
    frame = lambda some: spark.createDataFrame(some, UPDATES)
    C.index_updates(path, 0, frame(updates[:200]), OPTIONS)
    C.index_updates(path, 1, frame(updates), OPTIONS)  # an attempt that wrote other rows
    C.index_updates(path, 1, frame(updates[200:]), OPTIONS)
    C.index_updates(path, 2, frame([]), OPTIONS)
    assert result(C.assign_by_index(path, left, F.lit(AS_OF), OPTIONS)) == plain(items, updates, 0.7)
    first = C.assign_by_index(path, left, F.lit(AS_OF), OPTIONS, before=1)
    assert result(first) == plain(items, updates[:200], 0.7)
    moved = [(updates[0][0], updates[0][1], updates[0][2], AS_OF)]
    C.index_updates(path, 3, frame(moved), OPTIONS)
    assert result(C.assign_by_index(path, left, F.lit(AS_OF), OPTIONS)) == plain(items, moved + updates[1:], 0.7)


def test_a_probe_reads_the_days_of_its_window(spark, cases):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/index"
    C.index_updates(path, 0, spark.createDataFrame(cases[1], UPDATES), OPTIONS)
    since = G.window_start(F.lit(AS_OF), OPTIONS)
    days = C._indexed(spark, f"{path}/entries", None, since, ["day", "id"])
    plan = days._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
    assert min(r.day for r in days.select("day").distinct().collect()).isoformat() >= "2024-01-24"


def test_odd_rows_and_no_rows(spark):
    items = [(1, None, None, None, None, None), (2, "", "alpha", [], AS_OF, AS_OF), (3, "a b " * 5000, "alpha", ["alpha", " "], AS_OF, AS_OF), (3, "a b " * 5000, "alpha", ["alpha"], AS_OF, AS_OF)]
    updates = [(1, None, None, AS_OF), (2, "", "alpha", AS_OF), (3, "a b", "alpha", AS_OF), (4, "a b " * 5000, "Alpha", AS_OF), (4, "a b " * 5000, "Alpha", AS_OF)]
    left, right = spark.createDataFrame(items, SCHEMA), spark.createDataFrame(updates, UPDATES)
    found = [r[:2] for r in result(G.assign_to_updates(left.where("item_id > 1"), right, F.lit(AS_OF), OPTIONS))]
    assert found == [(2, 2), (3, 4), (3, 4)]
    assert [tuple(r)[1] for r in G.assign_to_updates(left, right.where("false"), F.lit(AS_OF)).collect()] == [None] * 4
    assert G.assign_to_updates(left.where("false"), right, F.lit(AS_OF)).count() == 0
    assert G.assign_to_updates(left.where("item_id = 1"), right, F.lit(AS_OF)).count() == 1
