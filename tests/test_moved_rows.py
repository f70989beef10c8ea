"""What queries over large logs move between tasks, read off their plans."""

import tempfile

import pytest

from updatelens.operators import interactions as J
from updatelens.session import bucketed
from updatelens.workload import adapters as A


@pytest.fixture
def sorted_joins(spark):
    """Plans as for tables that are too large to broadcast, and as they stand before they run."""
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def lines(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.range(20).selectExpr(
        "id % 5 AS l_orderkey", "id % 7 AS l_partkey", "id % 3 AS l_suppkey", "CAST(id % 2 AS INT) AS l_linenumber", "timestamp'2001-01-01' AS l_shipdate",
        "CAST(id AS DOUBLE) AS l_quantity", "CAST(id AS DOUBLE) AS l_extendedprice", "0.5D AS l_discount",
    ).write.parquet(f"{folder}/lineitem.parquet")
    return folder


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_items_and_sources_of_briefs_are_moved_once(sorted_joins):
    folder, header = lines(sorted_joins), sorted_joins.range(5).withColumnRenamed("id", "brief_id")
    for part in (A.brief_items(sorted_joins, folder), A.brief_item_sources(sorted_joins, folder)):
        # One exchange of the lines, one of the headers.
        assert plan(part.join(header, "brief_id")).count("Exchange hashpartitioning") == 2
    assert "concat" not in plan(A.brief_items(sorted_joins, folder)).split("Exchange")[1]


def test_bucketed_rows_are_not_moved_again(sorted_joins):
    folder, header = lines(sorted_joins), sorted_joins.range(5).withColumnRenamed("id", "brief_id")
    items = A.brief_items(sorted_joins, folder)
    stored = bucketed(items, "brief_id")
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, items.collect()))
    assert plan(stored.join(header, "brief_id")).count("Exchange hashpartitioning") == 1  # the headers


def test_opens_meet_links_before_these_are_made_distinct(sorted_joins):
    links = sorted_joins.createDataFrame([(1, 10), (1, 10), (2, 20), (3, None), (None, 30)], "update_id long, item_id long")
    opens = sorted_joins.createDataFrame(
        [(1, 1, 10), (2, 1, 10), (3, 2, 10), (4, 3, None), (5, None, 30), (6, 9, 9)], "event_id long, update_id long, item_id long"
    )
    good, bad = J.record_opens(opens, links)
    assert sorted(r.event_id for r in good.collect()) == [1, 2]
    assert sorted(r.event_id for r in bad.collect()) == [3, 4, 5, 6]
    assert "LeftSemi" in plan(good)
