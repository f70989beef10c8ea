import pytest

from .made import prose

# Columns that the operators use for themselves.
EXTRA = ["size", "digest", "id", "shard", "_items", "_id", "label", "x", "copies", "_tie", "fp", "node", "g", "score"]


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text, source) with nulls, empty and long texts, ties and repeated rows."""
    base = prose(1, 120)
    return [
        (1, base, "a"),
        (2, base, "b"),
        (2, base, "b"),
        (3, None, "a"),
        (4, "", None),
        (None, prose(2, 90), "a"),
        (None, None, None),
        (5, prose(3, 20_000), "hot"),
        (6, "one two", "hot"),
        (7, "x" * 5000, "hot"),
        (8, "é # ² \t\n  ok.", "a"),
        (9, prose(4, 60) + "\n" + base, "b"),
        (2**60 + 1, prose(5, 80), "b"),
    ]


def _frame(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for c in EXTRA:
        docs = docs.selectExpr("*", f"'kept' AS `{c}`")
    return docs


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return _frame(spark, odd_rows)


@pytest.fixture(scope="session")
def no_docs(spark):
    return _frame(spark, [])
