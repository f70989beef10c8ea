import numpy as np
import pytest

from updatelens.llm import negatives as N


def plain(rows, positives=5, negatives=3, low=50, high=95):
    """rows: (vec_id, label, v, anchor), an id once."""
    width = max((len(v) for _, _, v, _ in rows), default=0)
    full = {i: (label, list(v) + [0] * (width - len(v))) for i, label, v, _ in rows}
    out = []
    for a, label, _, anchor in rows:
        if not anchor:
            continue
        scored = sorted((-sum(p * q for p, q in zip(full[a][1], full[i][1])), i) for i in full if i != a)
        mine = [(-s, i) for s, i in scored if full[i][0] == label][:positives]
        other = [(-s, i) for s, i in scored if full[i][0] != label]
        for ps, p in mine:
            fit = [(s, i) for s, i in other if low * ps <= 100 * s <= high * ps][:negatives]
            out += [(a, p, rank, i, ps, s) for rank, (s, i) in enumerate(fit, 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, lab, [int(c) for c in v], a) for i, lab, v, a in rows], "vec_id long, label long, v array<int>, anchor boolean")


def found(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.fixture
def small(monkeypatch):
    for name, value in {"SHARD": 60, "GROUP": 12, "STEP": 16}.items():
        monkeypatch.setattr(N, name, value)


def clustered(seed, n, width, spread=40):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 100, (6, width))
    v = np.floor(centres[rng.integers(0, 6, n)] + rng.normal(0, spread, (n, width)))
    return [(int(i), int(rng.integers(0, 3)), v[i], i % 9 == 0) for i in range(n)]


def test_negatives_equal_a_plain_search(spark, small):
    rows = clustered(1, 500, 8)
    want = plain(rows)
    assert len(want) > 500 and found(N.mine(frame(spark, rows))) == want
    assert found(N.mine(frame(spark, rows), clusters=1)) == want
    few = rows[:40]
    assert found(N.mine(frame(spark, few), 2, 4, 10, 99)) == plain(few, 2, 4, 10, 99)


def test_copies_ties_zeros_and_signs(spark, small):
    rows = clustered(2, 150, 4)
    rows += [(1000 + i, i % 2, [3, 3, 0, 0], i % 5 == 0) for i in range(300)]  # one vector in a third of all rows
    rows += [(2000 + i, i % 3, [0, 0, 0, 0], i % 2 == 0) for i in range(20)]
    rows += [(3000 + i, 7, [-100 - i, 5, 5, 5], True) for i in range(3)] + [(-7, 1, [1, 2], True), (2**60 + 1, 9, [50, 50, 1, 1], True)]
    assert found(N.mine(frame(spark, rows))) == plain(rows)


def test_the_walk_stops_early():
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (4000, 6)) * np.exp(rng.normal(0, 1.5, 4000))[:, None] * 100
    x, a = np.floor(x), np.floor(x[:20] + 5)
    ids, labels = np.arange(4000), np.zeros(4000, int)
    centre = a.mean(axis=0)
    met = []

    class Counted(np.ndarray):
        def __getitem__(self, key):
            out = super().__getitem__(key)
            if isinstance(key, np.ndarray) and key.ndim and self.ndim == 2:
                met.append(len(key))
            return np.asarray(out)

    ends = np.full((20, 1), -N._FAR), np.full((20, 1), N._FAR)
    member, _, which, score = N.walk(a, -1 - np.arange(20), np.zeros(20, int), *ends, x.view(Counted), ids, labels, centre, True, 5)
    assert sum(met) < 4000
    for m in range(20):
        s = x @ a[m]
        assert which[member == m].tolist() == np.lexsort((ids, -s))[:5].tolist()


def test_rows_that_take_part(spark):
    ok = [0.5, -0.25, 0.001]
    rows = [(0, 1, ok), (7, 9, ok), (50, 2, [-0.001, 1.0, 0.0]), (1, None, ok), (2, 1, None), (3, 1, [None, 1.0, 1.0]), (4, 1, [float("nan")] * 3)]
    rows += [(5, 1, [float("inf"), 0.0, 0.0]), (None, 1, ok), (6, 1, [])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").selectExpr("*", "1 AS v", "2 AS anchor", "3 AS cluster")
    got = sorted((r.vec_id, r.label, r.v, r.anchor) for r in N.contract_rows(df).collect())
    assert got == [(0, 2, [128, -64, 0], True), (6, 1, [], False), (7, 0, [128, -64, 0], False), (50, 2, [-1, 256, 0], True)]
    assert N.mine(N.contract_rows(df.limit(0))).collect() == []
    assert N.mine(N.contract_rows(df.where("vec_id = 7"))).collect() == []
    assert found(N.mine(N.contract_rows(df.unionAll(df)))) == found(N.mine(N.contract_rows(df)))
