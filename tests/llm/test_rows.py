import os
import random

import numpy as np
import pytest

from updatelens.llm import quality, rules, tokens

from .made import prose

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
FOLDER = "/root/testdata/sf0.001"


def by_id(df, key="doc_id"):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- token counts ---


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(public_tokenizers.path(tokens.VOCABULARY))


def test_counts_equal_the_library(library):
    counter = tokens.Counter(tokens.read_vocabulary(public_tokenizers.path(tokens.VOCABULARY)))
    rng = random.Random(2)
    parts = ["ab", " ", "  ", "'s", "'ll", "²", "Ⅷ", "\x1c", "\n", "\r\n", "\x85", "é", "一", "<|endoftext|>", "12", "३", "_", "🙂", "́", "　", "​", "un" * 60]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(1500)] + [prose(1, 500)]
    assert [counter.count(t) for t in texts] == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_whole_tokens_are_proved(library):
    vocabulary = tokens.read_vocabulary(public_tokenizers.path(tokens.VOCABULARY))
    assert len(vocabulary["whole"]) > 45_000
    some = random.Random(1).sample(sorted(vocabulary["whole"]), 400)
    assert all(len(library.encode(t, add_special_tokens=False).ids) == 1 for t in some)


def test_merging_short_and_long_agree(library):
    ranks = tokens.read_vocabulary(public_tokenizers.path(tokens.VOCABULARY))["ranks"]
    for n in (1, 2, 5, 47, 48, 49, 300):
        letters = "".join(random.Random(n).choices("abehtinrs", k=n))
        long = tokens.merged_length(letters + "", ranks) if n > tokens.SHORT else None
        assert tokens._merged_short(list(letters), ranks) == (long or tokens.merged_length(letters, ranks))


def test_token_rows(odd_docs, odd_rows, no_docs, library):
    path = public_tokenizers.path(tokens.VOCABULARY)
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t, _ in odd_rows]
    assert by_id(tokens.count_tokens(odd_docs, path)) == sorted(want, key=repr)
    assert tokens.count_tokens(no_docs, path).collect() == []


# --- line rules ---


def plain_repeats(words):
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    return len({p for i, w in enumerate(windows) if windows.count(w) > 1 for p in range(i, i + 5)})


def test_base_counts():
    rng = random.Random(4)
    for n in (0, 3, 5, 6, 30, 120):
        words = rng.choices([b"a", b"b", b"cc"], k=n)
        assert rules.repeated_words(words) == plain_repeats(words)
    found = rules.judge("a #b\n\na #b\n \nc | d\v$ é")
    assert (found["n_words"], found["word_chars"], found["n_symbols"], found["n_dup_lines"]) == (9, 11, 4, 1)


def test_lines_fail_by_rule():
    good = "The first line is a whole sentence, and it says something about the matter."
    bad = ["Home | News | About us | Contact | More", "word### other### third### more### and###", "GO!! NOW!! BUY!! THIS!!", "Accept cookies to continue.", "Read more"]
    other = "Another one follows here, with words of its own that appear nowhere else in this text."
    found = rules.judge("\n".join([good, *bad, other]))
    assert found["clean_text"].split("\n") == [good, other]
    assert found["n_lines_removed"] == 5 and found["kept"]
    assert not rules.judge("\n".join(bad * 3 + ["It ends here, and it has some words more."]))["kept"]


def test_rule_rows(odd_docs, odd_rows, no_docs):
    df = rules.clean_lines(odd_docs)
    got = {(r.doc_id, r.n_words): r.kept for r in df.collect()}
    assert got == {(i, len((t or "").encode().split())): rules.judge(t)["kept"] for i, t, _ in odd_rows}
    assert rules.clean_lines(no_docs).collect() == []


# --- quality ---


def test_scores_equal_plain_densities(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate((rng.normal(0, 1, (60, quality.SIZE)), rng.normal(1, 2, (90, quality.SIZE))))
    y = np.array([0] * 60 + [1] * 90)
    rows = spark.createDataFrame([(int(b), a.tolist()) for a, b in zip(x, y)], "label int, x array<double>")
    model = quality.fit(rows, 0.3, 0.1)
    cov = [np.cov(x[y == c].T, bias=True) for c in (0, 1)]
    pooled = (60 * cov[0] + 90 * cov[1]) / 150
    logs = []
    for c, share in ((0, 0.4), (1, 0.6)):
        s = 0.6 * cov[c] + 0.3 * pooled + 0.1 * np.diag(np.diag(pooled)) + 1e-9 * np.eye(quality.SIZE)
        d = x - x[y == c].mean(axis=0)
        logs.append(np.log(share) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d))
    assert np.allclose(model.log_odds(x), logs[1] - logs[0])


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are absent")
def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    found = quality.score_quality(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (found.predicted == found.quality).mean() >= 0.9


def test_quality_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(n, n % 2, 0) for n in range(12)] + [(None, 1, 0), (1, None, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")
    rows = quality.score_quality(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 and r.held_out is not None for r in rows)
    assert quality.score_quality(no_docs, labels).collect() == []
    assert {r.score for r in quality.score_quality(odd_docs, labels.limit(0)).collect()} == {0.5}
    kept = quality.good_rows(odd_docs, labels)
    assert kept.schema == odd_docs.schema
    assert kept.count() == sum(r.predicted for r in rows)
    assert quality.good_rows(odd_docs, labels.limit(0)).count() == odd_docs.count()
    assert {r.doc_id for r in quality.good_rows(odd_docs, labels.limit(0)).collect()} >= {None, 2**60 + 1}
