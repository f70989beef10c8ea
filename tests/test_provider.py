"""What a provider of analyses may return."""

import tempfile

import pytest
from conftest import rows
from pyspark.sql import functions as F

from updatelens.operators import features as X


def test_provider_rows_are_checked(spark):
    items = spark.createDataFrame([(1, "Release one", "text"), (2, "Release two", "text")], "item_id bigint, title string, excerpt string")
    interests = spark.createDataFrame([("a", "release", "High", True), ("b", "one", "Low", True), ("c", "two", "Low", False)], "interest_id string, name string, priority string, is_active boolean")
    told = [("a", 0.5), ("a", 0.9), ("b", 1.5), ("c", 1.0), ("x", 1.0)]

    def provider(some, active):
        matches = F.array(*[F.struct(F.lit(i).alias("interest_id"), F.lit(s).alias("strength")) for i, s in told])
        found = X.deterministic_provider(some, active).withColumn("interest_matches", matches)
        return found.unionByName(found).unionByName(found.withColumn("item_id", F.col("item_id") + 10))

    got = X.analyze(items, interests, provider)
    assert rows(got, "item_id") == [(1,), (2,)]
    assert {tuple(m) for r in got.collect() for m in r.interest_matches} == {("a", 0.5)}
    none = X.analyze(items, interests.where("false"), provider)
    assert [r.interest_matches for r in none.collect()] == [[], []]
    with pytest.raises(ValueError, match="topics array<string>"):
        X.analyze(items, interests, lambda i, n: provider(i, n).drop("topics"))
    with pytest.raises(ValueError, match="impact_confidence double"):
        X.analyze(items, interests, lambda i, n: provider(i, n).withColumn("impact_confidence", F.lit("0.5")))


def test_an_item_is_analysed_once_per_version(spark):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/analyses"
    texts = [(i, f"Release {i}", "outage" if i % 2 else None) for i in range(6)]
    made = lambda some: spark.createDataFrame(some, "item_id bigint, title string, excerpt string")
    interests = spark.createDataFrame([("a", "release", "High", True)], "interest_id string, name string, priority string, is_active boolean")
    asked = []

    def provider(some, active):
        asked.append(sorted(r.item_id for r in some.collect()))
        return X.deterministic_provider(some, active)

    run = lambda some, version="v1": X.analyze_incremental(path, made(some), interests, provider, version)
    assert rows(run([]), "item_id") == []
    assert rows(run(texts[:2]), "item_id") == [(0,), (1,)]
    changed = [(1, "Other", None), (None, "No id", None), texts[2], texts[2]]
    assert rows(run(changed), "item_id", "impact_level") == [(1, "medium"), (2, "low")]
    full = run(texts)
    assert rows(full, "item_id", "impact_level") == [(i, "medium" if i % 2 else "low") for i in range(6)]
    assert rows(run(texts), *full.columns) == rows(full, *full.columns)
    assert rows(run(texts[:1], "2"), "item_id", "analyzer_version") == [(0, "2")]
    assert asked == [[], [0, 1], [2, 2], [3, 4, 5], [0]]
