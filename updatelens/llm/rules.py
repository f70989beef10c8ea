"""Rule-based cleaning that judges lines first and documents by what their lines leave."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from updatelens.llm.common import map_batches, utf8

SYMBOLS = "#*$%&|<>"
# Openings and phrases of lines that belong to a page, not to its text.
BOILERPLATE = (
    "accept cookies",
    "all rights reserved",
    "click here",
    "cookie policy",
    "enable javascript",
    "follow us",
    "log in",
    "lorem ipsum",
    "privacy policy",
    "read more",
    "share this",
    "sign up",
    "skip to content",
    "subscribe",
    "terms of service",
    "terms of use",
)
_BOILERPLATE = re.compile("|".join(map(re.escape, BOILERPLATE)), re.IGNORECASE)
_ENDS = (".", "!", "?", ":", ";", "…", "。", "！", "？", "؟", "।")
_CLOSERS = "\"'”’»)]}"
_SEPARATORS = frozenset((b"|", b">", b"/", b"-", "»".encode(), "›".encode(), "•".encode(), "·".encode()))


@dataclass(frozen=True)
class LineRules:
    """Limits of the rules. A line fails by symbols or shouting (punctuation), by separators
    (navigation), or by a phrase in a line of few words (boilerplate)."""

    symbol_share: float = 0.1  # of the line's characters
    shout_share: float = 0.5  # of the line's words, ending in "!!"
    separator_share: float = 0.2  # of the line's words
    unended_words: int = 4  # a line of up to so many words must end a sentence
    phrase_words: int = 20
    lost_share: float = 0.5  # of the document's words


def failed_rule(line: str, words: list[bytes], rules: LineRules) -> str | None:
    """Which rule a line with words fails, or None."""
    n = len(words)
    if sum(map(line.count, SYMBOLS)) > rules.symbol_share * len(line):
        return "navigation" if sum(w in _SEPARATORS for w in words) >= rules.separator_share * n else "punctuation"
    if sum(w.endswith(b"!!") for w in words) > rules.shout_share * n:
        return "punctuation"
    if sum(w in _SEPARATORS for w in words) >= rules.separator_share * n:
        return "navigation"
    if n <= rules.phrase_words and _BOILERPLATE.search(line):
        return "boilerplate"
    if n <= rules.unended_words and not line.rstrip().rstrip(_CLOSERS).endswith(_ENDS):
        return "punctuation"
    return None


def repeated_words(words: list[bytes], size: int = 5) -> int:
    """Words in windows of ``size`` words that stand at least twice in the text."""
    n = len(words)
    if n <= size:
        return 0
    ids: dict[bytes, int] = {}
    first = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    rank = first
    for ahead in range(1, size):  # rank numbers the distinct windows of ahead + 1 words
        pairs = rank[: n - ahead] * len(ids) + first[ahead:]
        distinct, rank = np.unique(pairs, return_inverse=True)
        if len(distinct) == len(pairs):
            return 0
    again = np.flatnonzero(np.bincount(rank)[rank] > 1)
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, again, 1)
    np.add.at(edges, again + size, -1)
    return int((np.cumsum(edges[:n]) > 0).sum())


def judge(text: str | None, rules: LineRules = LineRules()) -> dict:
    text = text or ""
    words = utf8(text).split()
    n = len(words)
    seen: set[str] = set()
    kept: list[str] = []
    duplicates = lost = failed = 0
    for line in text.split("\n"):
        in_line = utf8(line).split()
        if in_line:
            duplicates += line in seen
            seen.add(line)
            if failed_rule(line, in_line, rules):
                lost += len(in_line)
                failed += 1
                continue
        kept.append(line)
    repeats = repeated_words(words)
    base_failed = n < 10 or 100 * repeats > 20 * n
    return {
        "n_words": n,
        "word_chars": len(text) - sum(map(text.count, " \t\n\v\f\r")),
        "n_symbols": sum(map(text.count, SYMBOLS)),
        "n_dup_lines": duplicates,
        "n_repeat_words": repeats,
        "base_failed": base_failed,
        "kept": not base_failed and lost <= rules.lost_share * n,
        "n_lines_removed": failed,
        "n_words_removed": lost,
        "clean_text": "\n".join(kept),
    }


FIELDS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, n_lines_removed long, n_words_removed long"
)


def clean_lines(
    docs: DataFrame, rules: LineRules = LineRules(), key: str = "doc_id", with_text: bool = True
) -> DataFrame:
    """Per row: ``key``, the counts, ``base_failed``, ``kept`` and, if asked for, ``clean_text``.

    A null or empty text has no words and is not kept. Rows are judged alone, where they lie;
    repeated rows give repeated results; other columns are not read.
    """
    names = ["key", *(f.split()[0] for f in FIELDS.split(", ")), *["clean_text"] * with_text]

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        found: Iterable[dict] = [judge(t, rules) for t in batch["text"]]
        out = pd.DataFrame(found)
        out["key"] = batch["key"].array
        return out[names]

    rows = docs.select(F.col(key).alias("key"), "text")
    kind = rows.schema["key"].dataType.simpleString()
    schema = f"key {kind}, {FIELDS}" + ", clean_text string" * with_text
    return map_batches(rows, run, schema).withColumnRenamed("key", key)
