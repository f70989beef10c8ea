"""Quality scores by a regularised quadratic discriminant over statistics of the text.

Each class has a mean and a covariance of transformed document statistics. The covariances are
shrunk towards the pooled one and towards its diagonal, factored once by Cholesky, and a score is
the posterior that follows from the two Mahalanobis distances, log determinants and class shares.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from updatelens.llm.common import filter_batches, map_batches, session, utf8
from updatelens.session import materialize

FOLDS = 5
SYMBOLS = "#*$%&|<>{}[]\\^~=_@+"
NAMES = (
    "words",
    "word_chars",
    "symbols",
    "bangs",
    "bars",
    "upper",
    "digits",
    "ends",
    "commas",
    "distinct_words",
    "repeated_next",
    "top_word",
    "repeated_lines",
    "line_words",
    "decorated",
    "single_chars",
    "repeated_pairs",
    "wide_chars",
)
SIZE = len(NAMES)


def _share(part: float, whole: float) -> float:
    """A share as a log-odds with half a count added on both sides, so 0 and 1 stay finite."""
    part = min(part, whole)
    return float(np.log((part + 0.5) / (whole - part + 0.5)))


def statistics(text: str | None) -> list[float]:
    """Transformed statistics of a whole text; a null text is empty."""
    text = text or ""
    words = utf8(text).split()
    n, chars = len(words), len(text)
    lines = [line for line in text.split("\n") if line.strip(" \t\r\v\f")]
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    pairs = len(set(zip(words, words[1:])))
    upper = sum(map(str.isupper, text.split())) if text else 0
    return [
        float(np.log1p(n)),
        float(np.log1p(sum(map(len, words)) / max(1, n))),
        _share(sum(map(text.count, SYMBOLS)), chars),
        _share(text.count("!"), chars),
        _share(counts.get(b"|", 0), n),
        _share(upper, n),
        _share(sum(map(text.count, "0123456789")), chars),
        _share(text.count(".") + text.count("?"), n),
        _share(text.count(","), n),
        _share(len(counts), n),
        _share(sum(map(bytes.__eq__, words, words[1:])), n),
        _share(max(counts.values(), default=0), n),
        _share(len(lines) - len(set(lines)), len(lines)),
        float(np.log1p(n / max(1, len(lines)))),
        _share(sum(w[-1] in b"#*$%&!|>" for w in words), n),
        _share(sum(len(w) == 1 for w in words), n),
        _share(max(0, n - 1 - pairs), n),
        _share(len(utf8(text)) - chars, chars + 1),
    ]


def features(docs: DataFrame) -> DataFrame:
    """doc_id and ``x``, the statistics of the whole text, for every row."""

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        batch["x"] = [statistics(t) for t in batch["text"]]
        return batch[["doc_id", "x"]]

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, x array<double>")


@dataclass(frozen=True)
class Discriminant:
    """Per class: mean, inverse Cholesky factor and the constant of the log density with its share."""

    means: np.ndarray
    whiteners: np.ndarray
    constants: np.ndarray
    default: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = []
        for mean, whitener, constant in zip(self.means, self.whiteners, self.constants):
            z = (x - mean) @ whitener.T
            out.append(constant - 0.5 * np.einsum("ij,ij->i", z, z))
        return out[1] - out[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.means):
            return np.full(len(x), self.default)
        return 1.0 / (1.0 + np.exp(-np.clip(self.log_odds(x), -60.0, 60.0)))


def _partial_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per class: count, sums and sums of products of the rows of a partition."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        x = np.stack(batch["x"].to_numpy()) if len(batch) else np.zeros((0, SIZE))
        for label in (0, 1):
            own = np.column_stack((np.ones(len(x)), x))[batch["label"].to_numpy() == label]
            sums[label] = sums.get(label, 0) + own.T @ own
    for label, total in sums.items():
        flat = total.ravel()
        yield pd.DataFrame({"label": label, "at": np.arange(len(flat)), "value": flat})


def fit(rows: DataFrame, to_pooled: float = 0.5, to_diagonal: float = 0.05) -> Discriminant:
    """Learn from rows with ``label`` 0 or 1 and ``x``; all of them are summed, none is sampled.

    ``to_pooled`` and ``to_diagonal`` are the weights of the pooled covariance and of its diagonal.
    Without rows of both classes every score is the share of label 1, or 0.5 without any row.
    """
    sums = rows.select("label", "x").mapInPandas(_partial_sums, "label int, at int, value double")
    found = sums.groupBy("label", "at").agg(F.sum("value").alias("value")).collect()  # 2 * (SIZE + 1) ** 2 rows
    total = np.zeros((2, (SIZE + 1) ** 2))
    for r in found:
        total[r["label"], r["at"]] = r["value"]
    total = total.reshape(2, SIZE + 1, SIZE + 1)
    counts = total[:, 0, 0]
    share = counts[1] / counts.sum() if counts.sum() else 0.5
    if counts.min() < 2:
        return Discriminant(np.zeros((0, SIZE)), np.zeros((0, SIZE, SIZE)), np.zeros(0), float(share))
    means = total[:, 0, 1:] / counts[:, None]
    scatter = total[:, 1:, 1:] - counts[:, None, None] * np.einsum("ci,cj->cij", means, means)
    pooled = scatter.sum(axis=0) / counts.sum()
    diagonal = np.diag(np.maximum(np.diag(pooled), 1e-6))
    whiteners, constants = [], []
    for label in (0, 1):
        own = scatter[label] / counts[label]
        shrunk = (1 - to_pooled - to_diagonal) * own + to_pooled * pooled + to_diagonal * diagonal
        factor = np.linalg.cholesky(shrunk + 1e-9 * np.eye(SIZE))
        whiteners.append(np.linalg.inv(factor))
        constants.append(np.log(counts[label] / counts.sum()) - np.log(np.diag(factor)).sum())
    return Discriminant(means, np.array(whiteners), np.array(constants), float(share))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % F.lit(FOLDS) == 0, F.lit(False))


def learn(known: DataFrame, labels: DataFrame) -> Discriminant:
    """Fit on the rows of ``known`` (doc_id, x) that have a label and are not held out."""
    marks = labels.where(F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").alias("_id"))
    marks = marks.agg(F.max("quality").cast("int").alias("label"))
    return fit(known.where(~held_out()).join(marks, F.col("doc_id") == F.col("_id")))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score and predicted.

    Learns from labelled rows that are not held out; a null label or id teaches nothing, and a
    document labelled more than once counts as 1 if any label is 1. Null and empty texts are scored like
    others. Only the text enters a score. Statistics are computed once and written. Repeated rows
    get equal scores; an empty table gives an empty result.
    """
    session(docs.sparkSession)
    known = materialize(features(docs))
    model = learn(known, labels)

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        batch["score"] = model.score(np.stack(batch["x"].to_numpy()))
        return batch[["doc_id", "held_out", "score"]]

    kind = docs.schema["doc_id"].dataType.simpleString()
    marked = known.select("doc_id", held_out().alias("held_out"), "x")
    scored = map_batches(marked, run, f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= F.lit(threshold)).cast("int"))


def good_rows(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject. The text is scored where it lies."""
    session(docs.sparkSession)
    model = learn(features(docs), labels)

    def keep(texts: list[str | None]) -> list[bool]:
        return list(model.score(np.array([statistics(t) for t in texts])) >= threshold)

    return filter_batches(docs, keep)
