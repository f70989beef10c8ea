"""First-wins rules against a plain sequential loop on random small tables."""

import random
from datetime import datetime, timedelta

import pytest
from conftest import rows

from updatelens.operators import dedup as D

START = datetime(2024, 1, 1)
SCHEMA = (
    "item_id bigint, source_id string, external_id string, url_hash string, content_hash string, "
    "normalized_title string, retrieved_at timestamp"
)


def sequential(batch, stored, rules, days):
    kept = list(stored)
    out = {}
    for row in sorted(batch, key=lambda r: (r[6], r[0])):
        item, source, ext, url, digest, title, at = row
        key = {
            "external_id": (source, ext) if ext else None,
            "url": url,
            "content_hash": digest,
        }
        reason = first = None
        for rule in rules:
            if key[rule] is None:
                continue
            hits = [
                k[0] for k in kept
                if {"external_id": (k[1], k[2]) if k[2] else None, "url": k[3], "content_hash": k[4]}[rule] == key[rule]
            ]
            if hits:
                reason, first = rule, min(hits)
                break
        if reason is None and all(key[r] is None for r in rules):
            hits = [k for k in kept if k[5] == title and at - timedelta(days=days) <= k[6] <= at]
            if hits:
                reason = "title"
        out[item] = (reason, first)
        if reason is None:
            kept.append(row)
    return out


def random_rows(seed, n, first_id, span_days, keys=True):
    r = random.Random(seed)

    def maybe(p, prefix, k):
        return f"{prefix}{r.randrange(k)}" if keys and r.random() < p else None

    return [
        (
            first_id + i, f"s{r.randrange(3)}", maybe(0.4, "x", 12), maybe(0.4, "u", 12), maybe(0.4, "h", 15),
            f"T{r.randrange(4)}", START + timedelta(hours=r.randrange(span_days * 24)),
        )
        for i in range(n)
    ]


@pytest.mark.parametrize("seed", range(4))
def test_all_rules_match_a_sequential_pass(spark, seed):
    stored = [] if seed % 2 else D_stored(seed)
    batch = random_rows(seed, 70, 1000, 40)
    want = sequential(batch, stored, D.ITEM_RULES, 7)
    stored_df = spark.createDataFrame(stored, SCHEMA) if stored else None
    kept, dups = D.dedup_items(spark.createDataFrame(batch, SCHEMA), stored_df)
    assert rows(kept, "item_id") == sorted((k,) for k, v in want.items() if v[0] is None)
    got = {r.item_id: (r.reason, r.first_item_id) for r in dups.collect()}
    assert got == {k: v for k, v in want.items() if v[0] is not None}


def D_stored(seed):
    """Stored rows that could have been kept together."""
    pool = random_rows(seed + 100, 25, 0, 40)
    out = sequential(pool, [], D.ITEM_RULES, 7)
    return [p for p in pool if out[p[0]][0] is None]


def test_title_window_of_long_titles(spark):
    batch = random_rows(7, 120, 0, 120, keys=False)
    batch += [(500 + i, None, None, None, None, "L", START + timedelta(hours=5 * i)) for i in range(400)]
    batch += [(999, None, None, None, None, "L", datetime(1970, 1, 1))]
    want = sequential(batch, [], D.ITEM_RULES, 7)
    out = D.dedup_title_window(spark.createDataFrame(batch, SCHEMA))
    assert rows(out, "item_id") == sorted((k,) for k, v in want.items() if v[0] is None)


def test_a_title_over_ten_years_settles_in_few_jobs(spark):
    times = spark.range(20_000).selectExpr(
        "id AS item_id", "'L' AS normalized_title", "timestamp'2014-01-01' + make_dt_interval(0, 0, CAST(id * 263 AS INT)) AS retrieved_at"
    )
    old = spark.sql("SELECT -1L AS item_id, 'L' AS normalized_title, timestamp'1970-01-01' AS retrieved_at")
    batch = times.union(old).selectExpr("*", *[f"CAST(NULL AS STRING) AS {c}" for c in ("source_id", "external_id", "url_hash", "content_hash")])
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("ten-years", "")
    kept = D.dedup_title_window(batch).count()
    jobs = len(tracker.getJobIdsForGroup("ten-years"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    want, last = 1, None
    for i in range(20_000):
        at = i * 263 * 60
        if last is None or at > last + 7 * 86400:
            want, last = want + 1, at
    assert kept == want
    assert jobs < 150  # a job for each stage of a written table; 522 weeks do not count


def test_blank_keys_lose_no_row(spark):
    batch = [
        (1, "s", " ", None, None, "A", START),
        (2, None, "e", None, None, "A", START),
        (3, None, None, None, None, "B", START),
        (4, "s", None, "", None, "A", START),
        (5, None, "e", None, None, "C", START + timedelta(days=1)),
        (6, "s", "e", None, None, "C", START),
        (7, None, None, None, None, "A", START + timedelta(days=1)),
    ]
    df = spark.createDataFrame(batch, SCHEMA)
    kept, dups = D.dedup_items(df)
    assert rows(kept, "item_id") == [(1,), (2,), (3,), (4,), (6,)]
    assert rows(dups, "item_id", "reason") == [(5, "external_id"), (7, "title")]
    found = D.dedup_articles(df)
    assert sorted(r.item_id for r in found.collect()) == [1, 2, 3, 4, 5, 6, 7]


def test_title_window_bounds(spark):
    batch = [(i, None, None, None, None, "T", START + timedelta(days=d)) for i, d in enumerate((0, 6, 7, 8))]
    out = D.dedup_title_window(spark.createDataFrame(batch, SCHEMA))
    assert rows(out, "item_id") == [(0,), (3,)]


def test_a_dropped_item_does_not_shadow(spark):
    batch = [
        (1, "s", "e1", "u1", None, "A", START),
        (2, "s", "e1", "u2", None, "B", START + timedelta(hours=1)),
        (3, "s", "e2", "u2", None, "C", START + timedelta(hours=2)),
    ]
    kept, dups = D.dedup_items(spark.createDataFrame(batch, SCHEMA))
    assert rows(kept, "item_id") == [(1,), (3,)]
    assert rows(dups, "item_id", "reason", "first_item_id") == [(2, "external_id", 1)]


def test_one_hot_key(spark):
    """A third of the rows under one key, and one key for each of the rest."""
    batch = [
        (i, "s", "same" if i % 3 == 0 else f"e{i}", None, None, "T", START + timedelta(minutes=i)) for i in range(900)
    ]
    kept, dups = D.dedup_items(spark.createDataFrame(batch, SCHEMA))
    assert kept.count() == 601
    assert {r.first_item_id for r in dups.collect()} == {0}


@pytest.mark.parametrize("seed", [11, 12])
def test_articles_report_the_item_they_repeat(spark, seed):
    batch = random_rows(seed, 60, 0, 30)
    want = sequential(batch, [], D.ARTICLE_RULES, 7)
    by_id = {b[0]: b for b in batch}
    for r in D.dedup_articles(spark.createDataFrame(batch, SCHEMA)).collect():
        reason, first = want[r.item_id]
        assert r.is_duplicate == (reason is not None) and r.reason == reason
        if reason == "title":
            mine, other = by_id[r.item_id], by_id[r.existing_item_id]
            assert other[5] == mine[5] and mine[6] - timedelta(days=7) <= other[6] <= mine[6]
            assert want[other[0]][0] is None
        else:
            assert r.existing_item_id == first


def test_single_rules(spark):
    batch = random_rows(3, 80, 0, 20)
    df = spark.createDataFrame(batch, SCHEMA)
    for fn, key in (
        (D.dedup_external_id, lambda b: (b[1], b[2]) if b[2] else None),
        (D.dedup_url, lambda b: b[3]),
        (D.dedup_content_hash, lambda b: b[4]),
    ):
        seen, want = set(), []
        for b in sorted(batch, key=lambda b: (b[6], b[0])):
            if key(b) is None or key(b) not in seen:
                want.append((b[0],))
                seen.add(key(b))
        assert rows(fn(df), "item_id") == sorted(want)
