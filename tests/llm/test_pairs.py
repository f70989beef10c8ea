import random
import time

import numpy as np
import pytest
import xxhash

from updatelens.llm import decontamination as D
from updatelens.llm import simhash as S

from .made import prose


def plain_print(text, width=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    width = min(width, len(words))
    hs = [xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), 42) for i in range(len(words) - width + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(rows, radius=2):
    fps = [plain_print(r[1]) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    ids = {g: min((r[0] for r, h in zip(rows, group) if h == g and r[0] is not None), default=None) for g in group}
    return [(r[0], fp, ids[g]) for r, fp, g in zip(rows, fps, group)]


def order(rows):
    return sorted(rows, key=repr)


def found(df):
    return order((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in df.collect())


@pytest.fixture(scope="module")
def near_rows():
    rng = random.Random(3)
    rows = []
    for n in range(120):
        words = prose(n % 25, 400).split(" ")
        for _ in range(n % 4):
            words[rng.randrange(len(words))] = "changed"
        rows.append((n, " ".join(words), "s"))
    return rows


def test_simhash_equals_all_pairs(spark, near_rows, odd_docs, odd_rows, no_docs, monkeypatch):
    docs = spark.createDataFrame(near_rows, "doc_id long, text string, source string")
    assert found(S.near_duplicates(docs)) == order(plain_components(near_rows))
    assert found(S.near_duplicates(odd_docs)) == order(plain_components(odd_rows))
    assert S.near_duplicates(no_docs).collect() == []
    monkeypatch.setattr(S, "TILE", 2)  # tiles of many chunks
    assert found(S.near_duplicates(docs)) == order(plain_components(near_rows))


def test_forest_keeps_connections():
    rng = np.random.default_rng(1)
    fp = rng.integers(0, 1 << 62, 40, dtype=np.uint64)
    fp = np.concatenate((fp, fp ^ np.uint64(3), fp ^ np.uint64(15)))
    rows = np.column_stack((np.arange(len(fp), dtype=np.uint64), fp))
    a, b = S._forest(rows, rows, S.Closeness())
    assert len(set(a.tolist())) == 80
    assert all(int(x) % 40 == int(y) % 40 for x, y in zip(a, b))


def test_chain_of_links_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (102, 101)], "a long, b long")
    roots = {}
    for r in S.components(edges).collect():
        roots.setdefault(r.root, set()).add(r.node)
    assert sorted(map(sorted, roots.values())) == [list(range(41)), [100, 101, 102]]
    assert S.components(edges.limit(0)).collect() == []


def test_first_of_each(odd_docs, spark):
    kept = S.first_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(1) == 1 and 2 not in ids and ids.count(3) == 1 and 4 not in ids and 2**60 + 1 in ids
    base = prose(50, 300)
    words = base.split(" ")
    edited = " ".join("other" if i in (40, 150, 260) else w for i, w in enumerate(words))
    docs = spark.createDataFrame([(1, base), (2, edited), (3, prose(51, 300))], "doc_id long, text string")
    assert sorted(r.doc_id for r in S.first_of_each(docs).collect()) == [1, 3]


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_similar_texts_equal_all_jaccards(spark):
    rows = []
    for n in range(60):
        words = prose(600 + n, (60, 200, 600)[n % 3]).split()
        size = len(words)
        more = prose(700 + n, size).split()
        # A block at the end, a block replaced, and scattered words, each just above and just below 0.8.
        k = int(size * (0.235 if n % 2 else 0.27))
        block = int(size * (0.095 if n % 2 else 0.13))
        spots = set(range(7, size, 52 if n % 2 else 38))
        other = [
            words + more[:k],
            words[:20] + more[:block] + words[20 + block :],
            ["other" if i in spots else w for i, w in enumerate(words)],
        ][n // 3 % 3]
        rows += [(2 * n, " ".join(words)), (2 * n + 1, " ".join(other) + (" x y z" * 9 if n % 5 == 0 else ""))]
    want = []
    for (i, a), (j, b) in zip(rows[::2], rows[1::2]):
        one, two = shingles(a), shingles(b)
        same = len(one & two) / len(one | two) >= 0.8
        want += [(i, i), (j, i if same else j)]
    assert 15 < sum(i != c for i, c in want) < 45
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in S.near_duplicates(docs, S.SIMILAR).collect()) == want
    assert sorted(r.doc_id for r in S.first_of_each(docs).collect()) == sorted({c for _, c in want})


def test_sets_of_one_root_in_many_chunks(spark, monkeypatch):
    base = prose(800, 300).split()
    rows = [(n, " ".join(["new" + str(n)] * (n // 2) + base[n // 2 :])) for n in range(60)]
    sets = [shingles(t) for _, t in rows]
    group = list(range(60))
    for i in range(60):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    docs = spark.createDataFrame(rows + [(60, None), (61, " "), (None, rows[0][1])], "doc_id long, text string")
    monkeypatch.setattr(S, "SETS", 7)
    got = {r.doc_id: r.component_id for r in S.near_duplicates(docs, S.SIMILAR).collect()}
    assert [got[n] for n in range(60)] == group and got[61] == got[60] == 60 and got[None] == group[0]


def edit_distance_within(segment, text):
    """Fewest edits of the segment against any substring, by the full table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(segment, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def plain_leaks(text, items, leak):
    data = D.normal(text)
    return sorted(
        {i for i, t in items for s in leak.segments(D.normal(t)) if edit_distance_within(s, data) <= leak.edits(len(s))}
    )


def mutated(text, edits, rng):
    out = list(text)
    for _ in range(edits):
        p = rng.randrange(len(out))
        out[p : p + 1] = rng.choice([[], ["z"], [out[p], "q"]])
    return "".join(out)


def test_leaks_equal_full_alignment(spark, no_docs, odd_docs):
    rng = random.Random(9)
    items = [(n, prose(200 + n, 30)) for n in range(8)] + [(8, "short one here"), (9, ""), (10, "tiny"), (11, prose(300, 7))]
    texts = []
    for n in range(40):
        _, item = items[n % 8]
        shown = mutated(item, n % 12, rng)
        texts.append(prose(400 + n, 20) + " " + (shown if n % 5 else shown[: len(shown) // 3]) + " " + prose(500 + n, 20))
    texts += ["It is SHORT, one here!", items[11][1].upper(), None, "", "x" * 3000]
    leak = D.Leak()
    index = D.Index([(i, D.normal(t)) for i, t in items], leak)
    want = [plain_leaks(t, items, leak) for t in texts]
    assert index.leaks([D.normal(t) for t in texts]) == want
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([*items, (None, "x"), (12, None)], "item_id long, text string")
    got = {r.doc_id: r["items"] for r in D.find_leaks(docs, bench, block_chars=300).collect()}
    assert [got[n] for n in range(len(texts))] == want
    assert D.find_leaks(no_docs, bench).collect() == []
    assert D.find_leaks(docs, bench.limit(0)).where("contaminated").isEmpty()
    assert D.clean_rows(odd_docs, bench).count() == odd_docs.count()
    kept = D.clean_rows(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [n for n, w in enumerate(want) if not w]


def test_long_texts_are_read_in_pieces(monkeypatch):
    item = prose(1, 40)
    index = D.Index([(1, D.normal(item))], D.Leak())
    monkeypatch.setattr(D, "PIECE", 64)
    for before in range(0, 120, 7):
        assert index.leaks([D.normal("w" * before + " " + item + " " + prose(2, 50))])[0] == [1]


def test_every_stretch_of_an_item_is_a_leak():
    item = D.normal(prose(900, 40))
    index = D.Index([(1, item)], D.Leak())
    around = (prose(901, 20) + " q", "q " + prose(902, 20))
    for at in range(len(item) - 79):
        shown = item[at : at + 80].decode()
        assert index.leaks([D.normal(shown.join(around))])[0] == [1]
        assert index.leaks([D.normal(shown[:40].join(around))])[0] == []
    rng = random.Random(5)
    for at in range(3, len(item) - 79, 23):
        text = D.normal(mutated(item[at : at + 80].decode(), 7, rng).join(around))
        near = any(edit_distance_within(s, text) <= 8 for s in D.Leak().segments(item[max(0, at - 2) : at + 82]))
        assert near and index.leaks([text])[0] == [1]


def test_short_items_are_whole_words():
    index = D.Index([(1, b"tiny"), (2, b"short one here"), (3, b""), (4, b"a b"), (5, b"tiny"), (2, b"short one here")], D.Leak())
    assert index.leaks([b"some tiny thing"])[0] == [1, 5] and index.leaks([b"tinyish atiny"])[0] == []
    assert index.leaks([b"short one here"])[0] == [2] and index.leaks([b"short one hereby a b"])[0] == [4]
    assert index.leaks([b""])[0] == []


def test_repeating_texts(monkeypatch):
    rng = random.Random(6)
    items = [b"ab " * 60, b"a" * 90, b"ab ac abd " * 12]
    texts = [b"ab " * 100, b"ab ab ac ab abb cab " * 15, b"a" * 300, b"ab ac abd " * 30, b"".join(rng.choice([b"ab ", b"ac ", b"a"]) for _ in range(200))]
    texts += [b"".join(item[:45] + b" xyzzy quux zzz " for _ in range(5)) for item in items]
    texts = [D.normal(t.decode())[:160] for t in texts]
    for item in items:
        data = D.normal(item.decode())
        index = D.Index([(1, data)], D.Leak())
        want = [[1] if any(edit_distance_within(s, t) <= 8 for s in set(D.Leak().segments(data))) else [] for t in texts]
        for hits in (1 << 18, 500):  # whole and in parts
            monkeypatch.setattr(D, "HITS", hits)
            assert index.leaks(texts) == want


def test_long_repeating_texts_take_little_time():
    index = D.Index([(1, b"ab " * 333), (2, b"a" * 500)], D.Leak())
    for n in (6_000, 60_000, 1_000_000):
        start = time.perf_counter()
        assert index.leaks([(b"ab " * n)[:n], b"a" * n]) == [[1], [2]]
        assert time.perf_counter() - start < 4
