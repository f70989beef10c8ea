import hashlib
import random
import zlib

import pytest

from updatelens.llm import manifest as M


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h("".join(last[i : i + 16])) for i in range(0, len(last), 16)])
    return levels


def plain_proof(levels, i):
    out = []
    for nodes in levels[:-1]:
        run = list(range(i // 16 * 16, min(i // 16 * 16 + 16, len(nodes))))
        out.append(([nodes[j] for j in run if j < i], [nodes[j] for j in run if j > i]))
        i //= 16
    return out


def plain_rows(rows):
    """rows: (doc_id, source, leaf, tampered) -> the whole result, the slow way."""
    by_source = {}
    for r in rows:
        by_source.setdefault(r[1], []).append(r)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in order:
        by_source[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
        trees.append(plain_levels([r[2] for r in by_source[s]]))
    top = plain_levels([t[-1][0] for t in trees]) if trees else []
    out = []
    for g, s in enumerate(order):
        for i, (doc_id, _, leaf, tampered) in enumerate(by_source[s]):
            proof = plain_proof(trees[g], i) + plain_proof(top, g)
            folded = tampered or leaf
            for left, right in proof:
                folded = h("".join([*left, folded, *right]))
            root = top[-1][0]
            told = h("".join("".join(a + b) for a, b in proof))
            out.append((doc_id, leaf, trees[g][-1][0], root, told, folded, folded == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("n", [1, 2, 16, 17, 256, 257, 5000])
def test_missing_nodes_are_few_and_enough(n):
    leaves = [h(str(i)) for i in range(n)]
    levels = plain_levels(leaves)
    for low, high in ((0, 1), (0, n), (n - 1, n), (n // 3, n // 2 + 1), (max(0, n - 20), n)):
        asked = M.missing(range(low, high), 0, n)
        assert len(set(asked)) == len(asked) and len(asked) <= 30 * len(levels)
        known = {(0, i): leaves[i] for i in range(low, high)} | {(k, i): levels[k][i] for k, i in asked}
        for k in range(len(levels) - 1):  # what is asked for and what is held give the whole way up
            for i in range(low // 16**k, (high - 1) // 16**k + 1):
                run = range(i // 16 * 16, min(i // 16 * 16 + 16, len(levels[k])))
                known[k + 1, i // 16] = h("".join(known[k, j] for j in run))
        assert known[len(levels) - 1, 0] == levels[-1][0]
        # None of those asked for follows from the others.
        assert all(not (low // 16**k <= i <= (high - 1) // 16**k) for k, i in asked)


def leaf_rows(counts):
    rng = random.Random(3)
    rows = []
    for s, n in counts.items():
        for i in range(n):
            leaf = h(f"{s} {i}")
            rows.append((rng.randrange(10**12), s, leaf, h(leaf) if rng.random() < 0.2 else None))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(
    "counts",
    [{"only": 1}, {"a": 1, "b": 1}, {None: 3, "": 17, "é": 40, "z": 256, "Z": 1, "hot": 9000}, {f"s{i}": 1 + i % 3 for i in range(300)}],
)
def test_proofs_equal_a_plain_tree(spark, counts):
    rows = leaf_rows(counts)
    df = spark.createDataFrame(rows, "doc_id long, source string, leaf string, tampered string").repartition(5)
    got = sorted((tuple(r) for r in M.prove(df).collect()), key=repr)
    assert got == plain_rows(rows)
    assert any(not r[-1] for r in got) or len(rows) < 10


def test_leaves_of_documents(spark):
    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    rows = [(n, "Téxt ABC " * n, "en", f"s{n % 2}", 7) for n in range(40)]
    rows += [(None, None, None, None, None), (-5, "", "", "", 0), (2**60 + 1, "X" * 200_000, None, "s1", None), rows[3], rows[3]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 AS leaf", "2 AS _g")
    want = []
    for doc_id, text, lang, source, n in rows:
        head = "".join(map(field, (doc_id, source, lang, n)))
        low = text and "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        chosen = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0
        want.append((doc_id, source, h(head + field(text)), h(head + field(low)) if chosen else None))
    leaves = M.document_leaves(df)
    assert sorted(map(tuple, leaves.collect()), key=repr) == sorted(want, key=repr)
    assert sorted((tuple(r) for r in M.prove(leaves).collect()), key=repr) == plain_rows(want)
    assert M.prove(leaves.limit(0)).collect() == []
