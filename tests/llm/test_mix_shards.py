import hashlib
from collections import defaultdict
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from updatelens.llm import common, mixing, sharding

from .made import prose


@pytest.fixture(scope="module")
def sources(spark):
    rows = [(n, prose(n, 5 + n * 7 % 90), ["a", "b", "c", "d", "hot", None][0 if n % 17 == 0 else n % 6 if n % 3 else 4]) for n in range(600)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def targets(sizes):
    """Targets by the plain rule: share by weight, cap, share what is left again."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    total = 1.5 * sum(sizes.values())
    capped = set()
    while True:
        free = [s for s in names if s not in capped]
        level = (total - sum(2 * sizes[s] for s in capped)) / max(1, sum(weight[s] for s in free))
        above = {s for s in free if weight[s] * level > 2 * sizes[s]}
        if not above:
            return {s: 2.0 * sizes[s] if s in capped else weight[s] * level for s in names}
        capped |= above


def test_mix_reaches_targets(sources):
    rows = mixing.mix(sources).collect()
    assert sorted(r.doc_id for r in rows) == list(range(600))
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        assert r.taken in (0, r["size"], 2 * r["size"])
    want = targets(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
    for s in want:
        assert abs(taken[s] - want[s]) <= 30
    assert sorted(mixing.mix(sources.repartition(5)).collect(), key=lambda r: r.doc_id) == sorted(rows, key=lambda r: r.doc_id)


def test_every_document_has_its_share(sources):
    """Over many seeds a document of a source is taken as often as the source's rate says."""
    part = sources.where("source = 'hot'").limit(60).union(sources.where("source = 'a'").limit(20))
    counts, rate = defaultdict(int), {}
    for seed in range(5):
        for r in mixing.mix(part, seed=seed).collect():
            counts[r.source] += r.copies
            rate[r.source] = r.target / r.source_size
    n = {"hot": 60, "a": 20}
    for s in n:
        assert counts[s] / (5 * n[s]) == pytest.approx(rate[s], abs=0.12)


def test_mix_of_odd_rows(odd_docs, no_docs):
    rows = mixing.mix(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert all(r.taken <= 2 * r["size"] for r in rows)
    assert {r["size"] for r in rows if r.doc_id in (3, 4)} == {0}
    assert len({r.copies for r in rows if r.doc_id == 2}) == 1
    mixed = mixing.mixed_rows(odd_docs)
    assert mixed.columns == odd_docs.columns
    assert mixed.count() == sum(r.copies for r in rows)
    assert mixing.mix(no_docs).collect() == []
    assert mixing.mixed_rows(no_docs).collect() == []


def test_attach_salts_large_tables(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "z")], "n long, k string")
    facts = spark.createDataFrame([("a", 10), ("b", 20), (None, 30)], "k string, v long")
    got = common.attach(rows, facts, "k", F.col("n")).collect()
    assert sorted((r.n, r.v) for r in got if r.v) == [(1, 10), (2, 20), (3, 30)] and len(got) == 4


def test_running_sums_over_the_table(spark):
    rows = spark.createDataFrame([(n % 5, n) for n in range(200)], "k int, v long")
    got = sorted(common.in_order(rows, ["k", "v"], {"total": "v"}).collect(), key=lambda r: r._rank)
    assert [r._rank for r in got] == list(range(1, 201))
    assert [(r.k, r.v) for r in got] == sorted((n % 5, n) for n in range(200))
    assert [r.total for r in got] == list(accumulate(r.v for r in got))


def smallest(sizes, shards):
    def fits(c):
        used, at = 1, 0
        for s in sizes:
            if at + s > c:
                used, at = used + 1, 0
            at += s
        return used <= shards

    low, high = max(max(sizes), -(-sum(sizes) // shards)), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid + 1, high)
    return low


@pytest.mark.parametrize("places", [2, 16, 4096])
def test_shards_are_minimax(sources, monkeypatch, places):
    monkeypatch.setattr(sharding, "PLACES", places)
    docs = sources.unionByName(sources.where("doc_id % 7 = 0").withColumn("doc_id", F.col("doc_id") + 1000))
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = sharding.shard(docs, 9).collect()
    assert len(rows) == len(texts)
    bytes_of, load, slots, groups, where = {}, defaultdict(int), defaultdict(list), defaultdict(int), {}
    for r in rows:
        bytes_of[r.doc_id] = len(texts[r.doc_id].encode()) + 16
        assert r["size"] == bytes_of[r.doc_id] and r.law == "bytes" and r.grown_shard is None
        load[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        digest = hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
        groups[digest] += r["size"]
        assert where.setdefault(digest, r.shard) == r.shard
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(load.values()) == smallest([groups[d] for d in sorted(groups)], 9)


def test_shards_of_odd_rows(odd_docs, no_docs):
    rows = sharding.shard(odd_docs, 40).collect()
    assert len(rows) == odd_docs.count()
    assert {r["size"] for r in rows if r.doc_id in (3, 4)} == {16}
    assert len({r.shard for r in rows if r.doc_id in (1, 2)}) == 1
    assert all(0 <= r.shard < 40 for r in rows)
    assert sharding.shard(no_docs).collect() == []
