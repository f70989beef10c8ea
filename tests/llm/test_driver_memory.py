from updatelens.llm import simhash as S

from .made import prose


def test_tables_of_nodes_are_not_broadcast(spark, monkeypatch):
    """Such tables grow with the input; broadcast are the tiles of whole bits (65) and what ``attach`` has counted."""
    plans = []

    def kept(df):
        plans.append(df)
        return written(df)

    written = S.materialize
    monkeypatch.setattr(S, "materialize", kept)
    rows = [(n, prose(n % 20, 300) + " changed" * (n % 2)) for n in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    first = S.first_of_each(docs)
    assert sorted(r.doc_id for r in first.collect()) == list(range(20))
    plans += [first, S.near_duplicates(docs)]
    lines = [x for df in plans for x in df._jdf.queryExecution().executedPlan().toString().split("\n")]
    assert sum("SortMergeJoin" in x for x in lines) >= 8
    assert [x for x in lines if "BroadcastHashJoin" in x and not ("tile" in x or "tb#" in x or "_key#" in x)] == []
