import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from updatelens.llm import passages, repeats, substrings, windows

from .made import prose

LAST = (1 << 63) - 1


def brute(rows, task):
    """Removed spans of each row: every window of every row is looked up."""
    parts = [(LAST if i is None else i, task.read(t)) for i, t, *_ in rows]
    count, least = Counter(), {}
    cut = []
    for i, part in parts:
        first = np.arange(max(0, part.size - task.length + 1))
        keys = list(part.slices(first, first + task.length - 1))
        cut.append(keys)
        count.update(keys)
        for k in keys:
            least[k] = min(least.get(k, i), i)
    out = []
    for (i, part), keys in zip(parts, cut):
        hit = [(least[k] < i) if task.earlier else count[k] > 1 for k in keys]
        flags = bytearray(part.size)
        for p, h in enumerate(hit):
            if h:
                flags[p : p + task.length] = b"\1" * task.length
        spans, p = [], 0
        while p < part.size:
            if flags[p]:
                q = p
                while q < part.size and flags[q]:
                    q += 1
                spans.append((p, q))
                p = q
            p += 1
        out.append((i, part.size, tuple(spans), hashlib.sha256(part.without(spans)).hexdigest()))
    return sorted(out)


def found(df):
    return sorted(
        (LAST if r.doc_id is None else r.doc_id, r.size, tuple((s.start, s.end) for s in r.removed), hashlib.sha256(r.kept).hexdigest())
        for r in df.collect()
    )


@pytest.fixture(scope="module")
def tangled():
    """Texts made of shared passages, so windows repeat with many different neighbours."""
    rng = random.Random(5)
    pool = [" ".join(rng.choice(["aa", "b", "cde", "f"]) for _ in range(rng.randint(3, 40))) for _ in range(12)]
    rows = [(n, " ".join(rng.choice(pool) for _ in range(rng.randint(0, 9))), "s") for n in range(60)]
    return rows + [(60, "ab" * 400, "s"), (61, "abc" * 90, "s"), (62, "q" * 31, "s"), (None, rows[3][1], "s"), rows[4]]


def test_bytes_equal_brute_force(spark, tangled, monkeypatch):
    docs = spark.createDataFrame(tangled, "doc_id long, text string, source string")
    task = repeats.Task(repeats.Bytes, 40, 8, earlier=False)
    assert found(substrings.remove_repeated_bytes(docs, 40, 8)) == brute(tangled, task)
    monkeypatch.setattr(repeats, "BUCKET", 1)  # every bucket takes the way of the large ones
    assert found(substrings.remove_repeated_bytes(docs, 40, 8)) == brute(tangled, task)


def test_words_equal_brute_force(spark, tangled, monkeypatch):
    docs = spark.createDataFrame(tangled, "doc_id long, text string, source string")
    task = repeats.Task(repeats.Words, 10, 4, earlier=True)
    assert found(passages.remove_earlier_passages(docs, 10, 4)) == brute(tangled, task)
    monkeypatch.setattr(repeats, "BUCKET", 1)
    assert found(passages.remove_earlier_passages(docs, 10, 4)) == brute(tangled, task)


def test_odd_rows(odd_docs, odd_rows, no_docs):
    assert found(substrings.remove_repeated_bytes(odd_docs)) == brute(odd_rows, repeats.Task(repeats.Bytes, 200, 32, False))
    assert found(passages.remove_earlier_passages(odd_docs)) == brute(odd_rows, repeats.Task(repeats.Words, 50, 8, True))
    assert substrings.digest_rows(substrings.remove_repeated_bytes(no_docs), "n_bytes").collect() == []
    assert passages.remove_earlier_passages(no_docs).collect() == []


def test_paths_join_neighbouring_edges(spark):
    rows = [(d, d, g, g, g * 10, g * 10 + 9) for d in (1, 2) for g in range(6)] + [(3, 3, 2, 2, 0, 9), (3, 3, 9, 9, 10, 19)]
    edges = spark.createDataFrame(rows, "id long, digest long, g long, s long, lo int, hi int")
    spans = sorted((r.id, r.lo, r.hi) for r in passages.compact(edges).collect())
    covered = {(i, p) for i, lo, hi in spans for p in range(lo, hi + 1)}
    assert covered == {(r[0], p) for r in rows for p in range(r[4], r[5] + 1)}
    assert len(spans) < len(rows)


def test_runs_split_long_texts_without_loss(monkeypatch):
    symbols = np.frombuffer(bytes(random.Random(1).choices(b"abcd", k=3000)), np.uint8)
    monkeypatch.setattr(windows, "BLOCK", 100)
    covered = [p for _, lo, hi, _ in windows.runs(symbols, 50, 8) for a, b in zip(lo, hi) for p in range(a, b + 1)]
    assert covered == list(range(3000 - 50 + 1))


def test_thousands_of_equal_rows_without_id(spark):
    text = prose(77, 400)
    rows = [(None, text)] * 4000 + [(1, prose(78, 100)), (2, text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    for found, gone in ((substrings.remove_repeated_bytes(docs), 4001), (passages.remove_earlier_passages(docs), 4000)):
        counts = {(r.doc_id, r.n): r["count"] for r in found.selectExpr("doc_id", "size(removed) AS n").groupBy("doc_id", "n").count().collect()}
        assert sum(n for (_, spans), n in counts.items() if spans) == gone and len(counts) == 3
