"""Batch grouping against a plain one-at-a-time loop."""

import math
import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

from updatelens.operators import grouping as G
from updatelens.options import GroupingOptions

START = datetime(2024, 1, 1)
AS_OF = datetime(2024, 1, 31)
SCHEMA = (
    "item_id bigint, title string, primary_topic string, topics array<string>, observed_at timestamp, "
    "received_at timestamp"
)


def cosine(a, b):
    a, b = Counter(a.split()), Counter(b.split())
    dot = sum(n * b[t] for t, n in a.items())
    if not a and not b:
        return 1.0
    if not dot:
        return 0.0
    norm = math.sqrt(sum(n * n for n in a.values())) * math.sqrt(sum(n * n for n in b.values()))
    return min(1.0, dot / norm)


def sequential(items, hours, threshold):
    start = AS_OF - timedelta(hours=hours)
    founders, links = [], {}
    for item in sorted(items, key=lambda i: (i[5], i[0])):
        best = None
        for f in founders:
            if f[4] < start or f[2] not in item[3]:
                continue
            s = cosine(f"{item[1]} {item[2]}", f"{f[1]} {f[2]}")
            if s >= threshold and (best is None or (-s, f[0]) < best):
                best = (-s, f[0])
        if best is None:
            founders.append(item)
            links[item[0]] = (item[0], None)
        else:
            links[item[0]] = (best[1], -best[0])
    return links


def random_items(seed, n, words):
    r = random.Random(seed)
    items = []
    for i in range(n):
        title = [r.choice(words) for _ in range(r.randint(1, 6))]
        topics = list(dict.fromkeys(r.choice(["alpha", "beta", "gamma"]) for _ in range(3)))
        at = START + timedelta(hours=r.randrange(30 * 24))
        items.append((i, " ".join(title), topics[0], topics, at, START + timedelta(minutes=r.randrange(500))))
    return items


@pytest.mark.parametrize("seed,hours", [(1, 168), (2, 31 * 24), (3, 31 * 24), (4, 31 * 24)])
def test_batch_equals_one_at_a_time(spark, seed, hours):
    words = "ab cd ef gh ij".split() if seed % 2 else [f"w{i}" for i in range(14)]
    items = random_items(seed, 120, words)
    want = sequential(items, hours, 0.78)
    updates, links = G.group_items(
        spark.createDataFrame(items, SCHEMA), F.lit(AS_OF), GroupingOptions(window_hours=hours)
    )
    got = {r.item_id: (r.update_id, r.similarity) for r in links.collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    for k, (_, s) in want.items():
        assert (got[k][1] is None) == (s is None) and (s is None or abs(got[k][1] - s) < 1e-12)
    assert updates.count() == len({v[0] for v in want.values()})


def test_near_copies_of_one_text(spark):
    """Many near copies in one block, each with its own number, join the first of them."""
    items = [
        (i, f"alpha daily report number {i}", "alpha", ["alpha"], AS_OF, START + timedelta(minutes=i))
        for i in range(400)
    ]
    _, links = G.group_items(spark.createDataFrame(items, SCHEMA), F.lit(AS_OF))
    assert rows(links.select("update_id").distinct(), "update_id") == [(0,)]


def test_many_unlike_texts_in_one_block(spark):
    items = [
        (i, f"u{i} v{i} w{i} x{i} common", "alpha", ["alpha"], AS_OF, START + timedelta(minutes=i)) for i in range(150)
    ]
    _, links = G.group_items(spark.createDataFrame(items, SCHEMA), F.lit(AS_OF))
    assert links.where("update_id <> item_id").count() == 0


def test_candidates_are_the_newest_in_the_window(spark):
    updates = spark.createDataFrame(
        [(u, "t", "Alpha" if u % 2 else "beta", AS_OF - timedelta(hours=u)) for u in range(1, 300)],
        "update_id bigint, representative_title string, primary_topic string, last_observed_at timestamp",
    )
    items = spark.createDataFrame([(1, "t", "beta", ["ALPHA", "beta"], AS_OF, AS_OF)], SCHEMA)
    found = G.candidate_updates(items, updates, F.lit(AS_OF), GroupingOptions(max_comparisons=25))
    assert rows(found, "update_id") == [(u,) for u in range(1, 26)]
    found = G.candidate_updates(items, updates, F.lit(AS_OF), GroupingOptions(max_comparisons=250))
    assert rows(found, "update_id") == [(u,) for u in range(1, 169)]


def test_cosine_of_given_pairs(spark):
    texts = ["", "a b b", "a b", "c", "b a b", "!"]
    left = spark.createDataFrame(list(enumerate(texts)), "left_id bigint, text string")
    right = spark.createDataFrame(list(enumerate(texts)), "right_id bigint, text string")
    pairs = spark.createDataFrame([(i, j) for i in range(6) for j in range(6)], "left_id bigint, right_id bigint")
    for i, j, s in rows(G.cosine_pairs(left, right, pairs), "left_id", "right_id", "similarity"):
        assert s == cosine(texts[i].replace("!", ""), texts[j].replace("!", ""))


def test_equality_with_the_threshold_merges(spark):
    updates = spark.createDataFrame(
        [(1, "a b", "b", AS_OF)],
        "update_id bigint, representative_title string, primary_topic string, last_observed_at timestamp",
    )
    items = spark.createDataFrame([(9, "a c", "b", ["b"], AS_OF, AS_OF)], SCHEMA)
    s = cosine("a b b", "a c b")
    assert rows(G.assign_to_updates(items, updates, F.lit(AS_OF), GroupingOptions(merge_threshold=s)), "update_id") == [(1,)]
    above = GroupingOptions(merge_threshold=math.nextafter(s, 2))
    assert G.assign_to_updates(items, updates, F.lit(AS_OF), above).where("update_id IS NULL").count() == 1
