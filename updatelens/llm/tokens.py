"""Token counts with a byte-level vocabulary.

Most words of a text are one token. Which strings encode alone as one token is proved once, on the
driver, over the vocabulary; a word of a text that is such a string counts 1 by a lookup. Only the
other words are merged, and each worker remembers a bounded number of merged words.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from updatelens.llm.common import map_batches, n_bytes

VOCABULARY = "byte_bpe_50k.json"
REMEMBERED = 1_000_000  # merged words kept by a worker, about 150 bytes each
SHORT = 48
NEVER = 1 << 60

# Fixed value: how this vocabulary cuts a text into pre-tokens.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PIECES = regex.compile(PIECES.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
# The same cut by the faster module. It differs only where a text has one of the _ODD characters.
_FAST = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


def _odd() -> frozenset[str]:
    """Characters that the two patterns class differently."""
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    kinds = (
        (r"\p{L}", r"[^\W\d_]"),
        (r"\p{N}", r"\d"),
        (r"\p{White_Space}", r"\s"),
    )
    text = "".join(every)
    out: set[str] = set()
    for theirs, ours in kinds:
        out ^= set(regex.findall(theirs, text)) ^ set(re.findall(ours, text))
    return frozenset(out | {c for c in every if unicodedata.category(c) in ("Nl", "No")})


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: printable Latin-1 bytes stand for
    themselves, the others take the letters from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def _merged_short(parts: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """As below, for a few letters, where looking at all pairs is faster than a heap."""
    found = [ranks.get(pair, NEVER) for pair in zip(parts, parts[1:])]
    while found and (best := min(found)) < NEVER:
        i = found.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del found[i]
        if i:
            found[i - 1] = ranks.get((parts[i - 1], parts[i]), NEVER)
        if i < len(found):
            found[i] = ranks.get((parts[i], parts[i + 1]), NEVER)
    return len(parts)


def merged_length(letters: str, ranks: dict[tuple[str, str], int]) -> int:
    """The number of tokens after all merges, the lowest rank first and the leftmost of equals."""
    n = len(letters)
    if n <= SHORT:
        return _merged_short(list(letters), ranks)
    parts: list[str | None] = list(letters)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    heap = [(r, i, a + b) for i, (a, b) in enumerate(zip(letters, letters[1:])) if (r := ranks.get((a, b))) is not None]
    heapq.heapify(heap)
    left = n
    while heap:
        _, i, whole = heapq.heappop(heap)
        j = after[i]
        if parts[i] is None or j >= n or parts[i] + parts[j] != whole:
            continue  # one side has been merged meanwhile
        parts[i], parts[j] = whole, None
        left -= 1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := ranks.get((whole, parts[k]))) is not None:
                heapq.heappush(heap, (r, i, whole + parts[k]))
        if (h := before[i]) >= 0 and (r := ranks.get((parts[h], whole))) is not None:
            heapq.heappush(heap, (r, h, parts[h] + whole))
    return left


def read_vocabulary(path: str) -> dict:
    """Ranks of merges, special strings and the strings proved to be one token alone."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    ranks = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(spec["model"]["merges"])}
    bytes_of = {c: b for b, c in enumerate(byte_letters())}
    special = [t["content"] for t in spec["added_tokens"]]
    whole = {}
    for token in spec["model"]["vocab"]:
        if not set(token) <= bytes_of.keys():
            continue
        try:
            text = bytes(bytes_of[c] for c in token).decode("utf-8")
        except UnicodeDecodeError:
            continue
        if _PIECES.findall(text) == [text] and merged_length(token, ranks) == 1:
            whole[text] = 1
    return {"ranks": ranks, "special": special, "whole": whole, "odd": _odd()}


class Costs(dict):
    """Tokens of each pre-token: whole tokens and a bounded number of merged ones."""

    def __init__(self, vocabulary: dict):
        super().__init__(vocabulary["whole"])
        self.ranks, self.room = vocabulary["ranks"], REMEMBERED
        self.letters = byte_letters()

    def __missing__(self, piece: str) -> int:
        letters = self.letters
        n = merged_length("".join([letters[b] for b in piece.encode("utf-8")]), self.ranks)
        if self.room > 0 and len(piece) < 64:
            self.room -= 1
            self[piece] = n
        return n


class Counter:
    def __init__(self, vocabulary: dict):
        self.costs, self.odd = Costs(vocabulary), vocabulary["odd"]
        special = sorted(vocabulary["special"], key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None

    def count(self, text: str | None) -> int:
        """Tokens of a whole text; a special string inside it is one token, null is empty."""
        if not text:
            return 0
        parts = self.special.split(text) if self.special else [text]
        total = len(parts) - 1
        cost = self.costs.__getitem__
        for part in parts:
            cut = _FAST if self.odd.isdisjoint(set(part)) else _PIECES
            total += sum(map(cost, cut.findall(part)))
        return total


_counters: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, path: str, limit: int = 512, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``key``, ``n_bytes``, ``n_tokens`` and ``over_limit``, with the vocabulary file at ``path``.

    A null or empty text has 0 tokens. No row is dropped or joined; extra columns are not read. The
    vocabulary, a file of bounded size, is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def count(batch: pd.DataFrame) -> pd.DataFrame:
        if path not in _counters:
            _counters[path] = Counter(shared.value)
        counter = _counters[path]
        batch["n_tokens"] = [counter.count(t) for t in batch["text"]]
        return batch[["key", "n_bytes", "n_tokens"]]

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), n_bytes(text).alias("n_bytes"))
    kind = rows.schema["key"].dataType.simpleString()
    counted = map_batches(rows, count, f"key {kind}, n_bytes long, n_tokens long")
    return counted.select(
        F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
