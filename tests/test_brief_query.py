"""The brief of the registered query against its SQL on tables where completed briefs hold updates that would be picked."""

import os
import sys
import tempfile

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from updatelens.workload.oracles import ORACLES
from updatelens.workload.queries import QUERIES


def test_updates_of_completed_briefs_are_left_out(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    con = duckdb.connect()
    con.execute("CREATE TABLE part AS SELECT k::BIGINT AS p_partkey, 100.0 + k AS p_retailprice, 3 AS p_size, 'PROMO' AS p_type, 'b' AS p_brand, 'blue' AS p_name FROM range(1, 10) t(k)")
    con.execute("CREATE TABLE orders AS SELECT k::BIGINT AS o_orderkey, TIMESTAMP '2001-01-01' AS o_orderdate, CASE WHEN k < 3 THEN 'F' ELSE 'O' END AS o_orderstatus FROM range(1, 10) t(k)")
    con.execute("CREATE TABLE lineitem AS SELECT k::BIGINT AS l_orderkey, (10 - k)::BIGINT AS l_partkey, 1::BIGINT AS l_suppkey, 1 AS l_linenumber, 'R' AS l_returnflag, 50.0::DOUBLE AS l_quantity, 0.05::DOUBLE AS l_discount, 1.0::DOUBLE AS l_extendedprice, TIMESTAMP '2001-01-02' AS l_shipdate FROM range(1, 10) t(k)")
    for name in ("part", "orders", "lineitem"):
        con.execute(f"COPY {name} TO '{folder}/{name}.parquet'")
    got = QUERIES["generate_brief"](spark, folder).select("update_id", "rank").collect()
    want = con.execute(f"SELECT update_id, rank FROM ({ORACLES['generate_brief']})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and {u for u, _ in want} == {3, 4, 5, 6, 7}
