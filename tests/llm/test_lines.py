import hashlib
from collections import Counter

import xxhash

from updatelens.llm import lines
from updatelens.session import scratch_dir

from .made import prose

SPACE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def plain(texts, min_docs, min_chars=1):
    split = [(t or "").split("\n") for t in texts]
    docs = Counter(k for own in split for k in {key(x) for x in own} if len(k) >= min_chars)
    common = {k for k, n in docs.items() if n >= min_docs}
    kept = [[x for x in own if key(x) not in common] for own in split]
    return [(len(own), len(own) - len(k), "\n".join(k)) for own, k in zip(split, kept)]


def found(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in df.collect()), key=repr)


def test_lines_equal_a_plain_count(spark):
    texts = ["Menu\nFirst text %d\n  MENU\t\n\nSecond\r" % (n % 3) for n in range(7)]
    texts += ["menu", "É one", "é one", "\x0b\x0cTail", "tail\n\n", "a\x1cb\nA\x1cB", "\xa0menu", "menu " * 3]
    texts += ["\n".join("row %d" % (i % 9) for i in range(500)), None, "", "\n\n\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for min_docs, min_chars in ((2, 1), (3, 1), (7, 1), (2, 6), (1, 1)):
        want = sorted(((i, *w) for i, w in enumerate(plain(texts, min_docs, min_chars))), key=repr)
        assert found(lines.remove_common_lines(df, min_docs, min_chars, batches=3)) == want


def test_odd_rows_of_lines(odd_docs, odd_rows, no_docs):
    for min_docs in (2, 3):
        want = sorted(((i, *w) for (i, _, _), w in zip(odd_rows, plain([t for _, t, _ in odd_rows], min_docs))), key=repr)
        assert found(lines.remove_common_lines(odd_docs, min_docs)) == want
    assert lines.remove_common_lines(no_docs).collect() == []


def test_thousands_of_equal_rows_without_id(spark):
    df = spark.range(20_000).selectExpr("CAST(NULL AS LONG) AS doc_id", "'one\ntwo\none' AS text")
    rows = lines.remove_common_lines(df)
    assert rows.groupBy("n_lines", "n_dropped", "kept_text").count().collect() == [(3, 3, "", 20_000)]


def test_a_long_text_of_many_lines(spark):
    text = "\n".join(f"l{i}" for i in range(100_000)) + "\nshared"
    df = spark.createDataFrame([(1, text), (2, "Shared\nl7")], "doc_id long, text string")
    got = {r.doc_id: r for r in lines.remove_common_lines(df, min_docs=2).collect()}
    assert got[1].n_dropped == 2 and got[1].kept_text == "\n".join(f"l{i}" for i in range(100_000) if i != 7)
    assert got[2].kept_text == ""


def test_runs_are_merged_by_levels_and_found_again(spark):
    folder = f"{scratch_dir(spark)}/runs-{hashlib.md5(b'levels').hexdigest()}"
    store = lines.LineRuns(spark, folder, fanout=2)
    assert store.common(1).collect() == []
    batches = [[(n, f"all\nbatch {n // 4}\n{prose(n, 8)}") for n in range(b, b + 4)] for b in range(0, 28, 4)]
    for at, batch in enumerate(batches):
        docs = spark.createDataFrame(batch, "doc_id long, text string")
        store.add(at, lines.line_keys(docs))
    assert sorted(store.live) == [(0, 6, 6), (1, 4, 5), (2, 0, 3)]
    digest = bytearray.fromhex(xxhash.xxh3_128_hexdigest(b"all"))
    assert [(r.k, r.docs) for r in store.common(20).collect()] == [(digest, 28)]
    again = lines.LineRuns.open(spark, folder)
    assert sorted(again.live) == sorted(store.live)
    # A batch that comes twice replaces itself.
    again.add(6, lines.line_keys(spark.createDataFrame(batches[6], "doc_id long, text string")))
    assert [r.docs for r in again.common(20).collect()] == [28]
    assert again.common(4).count() == 8
