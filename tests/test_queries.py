"""Every registered query has a SQL twin; fast ones are compared here at the smallest scale."""

import math
import os
from datetime import datetime

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as entry  # noqa: E402
from updatelens.workload.oracles import ORACLES  # noqa: E402
from updatelens.workload.queries import QUERIES  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
TABLES = "orders lineitem customer supplier part events documents pages benchmark".split()
FAST = (
    "top_items collapse_ws keyword_counts canonical_url validate_messages latest_run_per_source apply_failures compose "
    "complete_brief_items brief_history clear_feedback apply_saves evaluation_summary source_distribution parse_feeds"
).split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are absent")


def norm(v):
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    return v.replace(tzinfo=None).isoformat() if isinstance(v, datetime) else repr(v)


def test_names_agree():
    assert set(ORACLES) == set(QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = entry.queries()[name](spark, FOLDER)
    found = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    got = sorted(tuple(norm(r[c]) for c in order) for r in df.collect())
    want = sorted(tuple(norm(r[names.index(c)]) for c in order) for r in found.fetchall())
    assert got == want
