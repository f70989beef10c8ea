"""Lookups on the path without broadcasts, with a hot key and with rows that have no key."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from updatelens.skew import lookup

SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.fixture
def no_broadcast(spark):
    before = {k: spark.conf.get(k, None) for k in SMALL}
    for k, v in SMALL.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def key(i):
    return None if i % 4 == 0 else 0 if i % 3 == 0 else i % 700


def test_lookup(no_broadcast):
    left = no_broadcast.createDataFrame([(i, key(i)) for i in range(2000)], "i int, k int")
    table = no_broadcast.createDataFrame([(k, f"v{k}", 5) for k in range(0, 700, 2)], "k int, v string, n int")
    want = [(i, key(i), None if key(i) is None or key(i) % 2 else f"v{key(i)}") for i in range(2000)]
    out = lookup(left, table, ["k"], F.col("i"), leave_out="n")
    assert out.columns == ["i", "k", "v"]
    assert rows(out.select("i", F.coalesce("k", F.lit(-1)).alias("k"), F.coalesce("v", F.lit("")).alias("v")), "i", "k", "v") == [
        (i, -1 if k is None else k, v or "") for i, k, v in want
    ]


def test_hot_keys_are_cut_at_run_time(no_broadcast, capsys):
    left = no_broadcast.range(0, 60_000, 1, 12).selectExpr("id AS i", "IF(id % 3 > 0, 7, id % 500) AS k", "uuid() AS u")
    table = no_broadcast.range(500).selectExpr("id AS k", "repeat('x', 20) AS v")
    out = lookup(left, table, ["k"], F.col("i"))
    assert out.count() == 60_000
    joined = out.groupBy("v", "u").count()
    joined.collect()
    joined.explain()
    assert "isSkew=true" in joined._jdf.queryExecution().executedPlan().toString() or "skew" in capsys.readouterr().out.lower()


def test_building_a_lookup_starts_no_job(spark):
    sc = spark.sparkContext
    left, table = spark.range(100).selectExpr("id AS i", "id % 5 AS k"), spark.range(5).selectExpr("id AS k", "id AS v")
    sc.setJobGroup("lookups", "none expected")
    out = lookup(lookup(left, table, ["k"], F.col("i")), table.withColumnRenamed("v", "w"), ["k"], F.col("i"))
    assert list(sc.statusTracker().getJobIdsForGroup("lookups")) == []
    assert out.count() == 100
    sc.setJobGroup("after", "")


def test_a_table_is_not_hinted(spark, capsys):
    lookup(spark.range(9).selectExpr("id AS k"), spark.range(9).selectExpr("id AS k", "id AS v"), ["k"], F.col("k")).explain(True)
    assert "ResolvedHint" not in capsys.readouterr().out
