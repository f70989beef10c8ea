"""Benchmark decontamination by q-gram counts in diagonal bands and banded alignment.

Every stretch of ``m`` characters of a benchmark item is a segment. A place of a text within ``k`` edits
of a segment shares at least ``m - q + 1 - k * q`` q-grams with it, all near one diagonal.
Q-grams shared with whole items are counted in diagonal bands that overlap by half, so each such place
lies whole within one band; segments that reach the bound in a band are verified by an alignment within it.

Texts are compared as the UTF-8 bytes of their lower-case letters and digits, other ASCII characters
being one space.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from updatelens.llm.common import filter_batches, map_batches, session, utf8
from updatelens.llm.windows import gram_hashes

Place = tuple[int, np.ndarray, int]  # an item, starts of segments and the diagonal of the band
_KEPT = bytes(c if chr(c).isalnum() and c < 128 or c >= 128 else 32 for c in range(256))
GRAM = 8  # a q-gram fills one 64-bit number
FILTER_BITS = 22
PIECE = 1 << 20  # bytes of a text looked at together
HITS = 1 << 18  # q-gram hits of a piece, unless it is as short as a few segments
ALIGNED = 4096  # segments aligned together
_ODD = np.uint64(0x9E3779B97F4A7C15)


def normal(text: str | None) -> bytes:
    return b" ".join(utf8((text or "").lower()).translate(_KEPT).split())


@dataclass(frozen=True)
class Leak:
    """What counts as a leak: any ``segment`` characters of an item, or a shorter item of at least
    ``least``, within ``rate`` edits a character. An item below ``least`` characters is looked for as
    a whole, between words and without edits."""

    segment: int = 80
    least: int = 40
    rate: float = 0.1

    def segments(self, item: bytes) -> list[bytes]:
        if len(item) <= self.segment:
            return [item] if item else []
        return [item[s : s + self.segment] for s in range(len(item) - self.segment + 1)]

    def edits(self, m: int) -> int:
        """The budget, cut to what the q-gram bound can still see."""
        k = int(m * self.rate) if m >= self.least else 0
        return max(0, min(k, (m - GRAM) // GRAM))


def _names(data: bytes, size: int) -> np.ndarray:
    """A number for the ``size`` letters from every position, by their content: equal segments have one name."""
    span = 1 << (size.bit_length() - 1)
    h = gram_hashes(np.frombuffer(data, np.uint8), span)
    return h[: len(data) - size + 1] * _ODD ^ h[size - span :]


def grams(data: bytes) -> np.ndarray:
    """The q-gram at every position as a number."""
    if len(data) < GRAM:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(raw, GRAM).copy().view(np.uint64).ravel()


def aligned(segments: list[bytes], windows: list[bytes], budgets: np.ndarray, band: int) -> np.ndarray:
    """Which segments lie within their budgets of edits of a substring of their windows, along the diagonals
    (position in the window less that in the segment) from 0 to ``band``.

    All segments are aligned together, a character of each at a time.
    """
    longest, width = max(map(len, segments)), band + 1
    letters = np.zeros((len(segments), longest), np.uint8)
    # A window that ends early goes on with a letter that matches nothing.
    texts = np.full((len(segments), longest + width), -1, np.int16)
    lengths = np.array([len(s) for s in segments])
    for row, (s, w) in enumerate(zip(segments, windows)):
        letters[row, : len(s)] = np.frombuffer(s, np.uint8)
        texts[row, : min(len(w), longest + width)] = np.frombuffer(w, np.uint8)[: longest + width]
    ends = np.array([len(w) for w in windows])
    ahead = np.arange(width, dtype=np.int16)
    # cost[c, d]: fewest edits of the first i characters against a substring that ends at i + d
    cost = np.where(ahead <= ends[:, None], 0, longest + 1).astype(np.int16)
    best = np.full(len(segments), longest + 1)
    for i in range(1, longest + 1):
        new = cost + (texts[:, i - 1 : i - 1 + width] != letters[:, i - 1, None])
        np.minimum(new[:, :-1], cost[:, 1:] + 1, out=new[:, :-1])
        cost = np.minimum.accumulate(new - ahead, axis=1) + ahead
        ended = lengths == i
        if ended.any():
            best[ended] = cost[ended].min(axis=1)
    return best <= budgets


class Index:
    """A block of benchmark items with a filter and postings of their q-grams; short items by their first word."""

    def __init__(self, items: list[tuple[int, bytes]], leak: Leak):
        self.leak = leak
        self.short: dict[bytes, list[tuple[int, bytes]]] = {}
        self.items: list[tuple[int, bytes]] = []
        for item_id, data in dict.fromkeys(items):
            if len(data) >= max(leak.least, GRAM):
                self.items.append((item_id, data))
            elif data:
                self.short.setdefault(data.split(b" ")[0], []).append((item_id, b" " + data + b" "))
        gram = [grams(data) for _, data in self.items]
        owner = np.repeat(np.arange(len(gram)), [len(g) for g in gram])
        place = np.concatenate([np.arange(len(g)) for g in gram]) if gram else np.zeros(0, np.int64)
        value = np.concatenate(gram) if gram else np.zeros(0, np.uint64)
        order = np.argsort(value, kind="stable")
        self.owner, self.place = owner[order], place[order]
        self.values, self.first, self.times = np.unique(value[order], return_index=True, return_counts=True)
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self._spot(self.values)] = True
        lengths = np.array([len(data) for _, data in self.items], np.int64)
        self.sizes = np.minimum(lengths, leak.segment)
        self.budgets = np.array([leak.edits(m) for m in self.sizes.tolist()], np.int64)
        self.bounds = self.sizes - GRAM + 1 - GRAM * self.budgets
        self.names = [_names(data, int(m)) for (_, data), m in zip(self.items, self.sizes)]
        # Half a band holds all diagonals of one place: twice the edits, and one more.
        self.half = 2 * (int(self.budgets.max()) if len(self.budgets) else 0) + 1
        self.margin = (int(lengths.max()) if len(lengths) else 0) // self.half + 1

    @staticmethod
    def _spot(values: np.ndarray) -> np.ndarray:
        return (values * _ODD) >> np.uint64(64 - FILTER_BITS)

    def leaks(self, texts: list[bytes]) -> list[list[int]]:
        """For each text the items of which a segment is in it."""
        found: list[set[int]] = [set() for _ in texts]
        memo: dict[tuple[bytes, bytes], bool] = {}
        waiting = []
        over = 2 * (self.leak.segment + 2 * self.half)
        for text, own in zip(texts, found):
            if self.short:
                whole = b" " + text + b" "
                for word in self.short.keys() & set(text.split(b" ")):
                    own |= {item_id for item_id, data in self.short[word] if data in whole}
            if not self.items:
                continue
            for start in range(0, max(1, len(text) - over), PIECE):
                piece = text[start : start + PIECE + over]
                at, k = self._met(piece)
                if self.times[k].sum() > HITS:
                    self._parts(piece, at, k, over, own, memo)
                elif len(at):
                    waiting.append((piece, own, *self._places(piece, at, k, own)))
        # The fullest segment of a band mostly settles its item.
        for which in (2, 3):
            self._fit([(w[which], w[0], w[1]) for w in waiting], memo)
        return [sorted(own) for own in found]

    def _met(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The positions of the text at which a q-gram of an item begins, and which one it is."""
        value = grams(text)
        at = np.flatnonzero(self.filter[self._spot(value)])
        k = np.searchsorted(self.values, value[at])
        k[k == len(self.values)] = 0
        real = self.values[k] == value[at]
        return at[real], k[real]

    def _parts(self, text: bytes, at: np.ndarray, k: np.ndarray, over: int, found: set[int], memo: dict) -> None:
        """A text whose q-grams meet very often, such as one of a short period, in parts of about ``HITS`` hits that
        overlap by ``over``. Items that are found are not looked for in later parts."""
        while len(at):
            hits = np.cumsum(self.times[k])
            end = max(int(at[min(np.searchsorted(hits, HITS), len(at) - 1)]), int(at[0]) + 3 * over)
            part, before = int(np.searchsorted(at, end, "right")), len(found)
            best, others = self._places(text, at[:part], k[:part], found)
            self._fit([(best, text, found)], memo)
            self._fit([(others, text, found)], memo)
            if part == len(at):
                return
            rest = int(np.searchsorted(at, end - over))
            at, k = at[rest:], k[rest:]
            if len(found) > before:
                gone = np.array([item_id in found for item_id, _ in self.items])
                alive = np.logical_or.reduceat(~gone[self.owner], self.first)[k]
                at, k = at[alive], k[alive]

    def _places(self, text: bytes, at: np.ndarray, k: np.ndarray, found: set[int]) -> tuple[list[Place], list[Place]]:
        """Segments that reach the bound, the fullest of each band and the others."""
        times = self.times[k]
        offset = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        posting = np.repeat(self.first[k], times) + offset
        owner = self.owner[posting]
        place, at = self.place[posting], np.repeat(at, times)
        if found:
            new = ~np.array([item_id in found for item_id, _ in self.items])[owner]
            owner, place, at = owner[new], place[new], at[new]
            if not len(owner):
                return
        bands = len(text) // self.half + self.margin + 4
        key = owner * bands + (at - place + self.margin * self.half) // self.half
        order = np.argsort(key, kind="stable")
        key, at, place = key[order], at[order], place[order]
        # A band is two halves: hits of a half count for the band it begins and for the one before.
        begin = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1))
        halves, counts = key[begin], np.diff(np.append(begin, len(key)))
        follow = np.append(np.diff(halves) == 1, False)
        both = counts + np.where(follow, np.append(counts[1:], 0), 0)
        good = np.flatnonzero(both >= self.bounds[halves // bands])
        best, others = [], []
        for h in good.tolist():
            a, b = begin[h], begin[h] + both[h]
            item, band = divmod(int(halves[h]), bands)
            bound, size = int(self.bounds[item]), int(self.sizes[item])
            # Equal q-grams may meet many times; a place needs as many different ones on both sides.
            own = np.unique(place[a:b])
            if len(own) < bound or len(set(at[a:b].tolist())) < bound:
                continue
            # A segment that holds the q-grams from ``first`` to ``last`` starts at or before the first.
            first, last = own[: len(own) - bound + 1], own[bound - 1 :]
            near = last - first <= size - GRAM
            if not near.any():
                continue
            low = np.maximum(last[near] - (size - GRAM), 0)
            high = np.minimum(first[near], len(self.items[item][1]) - size)
            some = low <= high
            if not some.any():
                continue
            far = len(self.items[item][1]) + 2
            inside = np.bincount(low[some], minlength=far) - np.bincount(high[some] + 1, minlength=far)
            starts = np.flatnonzero(np.cumsum(inside) > 0)
            held = np.searchsorted(own, starts + size - GRAM, "right") - np.searchsorted(own, starts)
            top = int(held.argmax())
            diagonal = (band - self.margin) * self.half
            best.append((item, starts[top : top + 1], diagonal))
            others.append((item, np.delete(starts, top), diagonal))
        return best, others

    def _fit(self, work: list[tuple[list[Place], bytes, set[int]]], memo: dict[tuple[bytes, bytes], bool]) -> None:
        """For every (places, text, found) of ``work`` add to ``found`` the items of which a segment is in the text.

        Segments are aligned with stretches of the text that begin at multiples of half a band. Equal segments that
        meet one stretch on several diagonals are aligned once, which is what a repeating item comes to.
        """
        asked: list[tuple[int, tuple[bytes, bytes], set[int]]] = []
        todo: dict[tuple[bytes, bytes], int] = {}

        def settle() -> None:
            if len(memo) > 16 * ALIGNED:
                memo.clear()
            if todo:
                budgets = self.budgets[list(todo.values())]
                memo.update(zip(todo, aligned([s for s, _ in todo], [w for _, w in todo], budgets, 3 * self.half).tolist()))
            for i, key, found in asked:
                if memo[key]:
                    found.add(self.items[i][0])
            asked.clear()
            todo.clear()

        for places, text, found in work:
            places = [p for p in places if self.items[p[0]][0] not in found]
            if not places:
                continue
            lengths = [len(s) for _, s, _ in places]
            item = np.repeat([i for i, _, _ in places], lengths)
            start = np.concatenate([s for _, s, _ in places])
            cell = np.maximum(start + np.repeat([d for _, _, d in places], lengths), 0) // self.half
            name = np.concatenate([self.names[i][s] for i, s, _ in places])
            _, first = np.unique((name + cell.astype(np.uint64)) * _ODD ^ item.astype(np.uint64), return_index=True)
            for i, s, c in zip(item[first].tolist(), start[first].tolist(), cell[first].tolist()):
                item_id, data = self.items[i]
                if item_id in found:
                    continue
                size, at = int(self.sizes[i]), c * self.half
                key = data[s : s + size], text[at : at + 3 * self.half + size]
                if key not in memo:
                    todo[key] = i
                asked.append((i, key, found))
                if len(todo) >= ALIGNED or len(asked) >= 16 * ALIGNED:
                    settle()
        settle()


def blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple[int, bytes]]]:
    """Items in blocks of a bounded number of characters, read one partition at a time."""
    held: list[tuple[int, bytes]] = []
    size = 0
    rows = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text")
    for row in rows.toLocalIterator():
        data = normal(row["text"])
        if held and size + len(data) > block_chars:
            yield held
            held, size = [], 0
        held.append((row["item_id"], data))
        size += len(data)
    if held:
        yield held


def find_leaks(docs: DataFrame, benchmark: DataFrame, leak: Leak = Leak(), block_chars: int = 4_000_000) -> DataFrame:
    """Per row: doc_id, contaminated, n_items and ``items``, the ids of the benchmark items found, ascending.

    The benchmark is a stated query set: it is broadcast in blocks of ``block_chars`` characters, and
    each block is looked for in all texts where they lie. Null and empty texts have no leak; items without
    a text or id are skipped. Repeated rows and items give repeated and equal results. Other
    columns are not read.
    """
    session(docs.sparkSession)
    rows = docs.select("doc_id", "text").withColumn("items", F.array().cast("array<long>"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    for items in blocks(benchmark, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(Index(items, leak))

        def look(batch: pd.DataFrame, shared=shared) -> pd.DataFrame:
            more = shared.value.leaks([normal(t) for t in batch["text"]])
            batch["items"] = [sorted({*a, *b}) for a, b in zip(batch["items"], more)]
            return batch

        rows = map_batches(rows, look, f"doc_id {kind}, text string, items array<long>")
    n_items = F.size("items").cast("long")
    return rows.select("doc_id", (n_items > 0).alias("contaminated"), n_items.alias("n_items"), "items")


def clean_rows(docs: DataFrame, benchmark: DataFrame, leak: Leak = Leak(), block_chars: int = 4_000_000) -> DataFrame:
    """The rows of ``docs`` without a leak, block by block of the benchmark."""
    for items in blocks(benchmark, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(Index(items, leak))

        def keep(texts: list[str | None], shared=shared) -> list[bool]:
            return [not found for found in shared.value.leaks([normal(t) for t in texts])]

        docs = filter_batches(docs, keep)
    return docs
