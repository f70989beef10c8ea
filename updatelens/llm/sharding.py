"""Shards of near equal bytes: a minimax cut of the ordered groups, with DataFrame operations only.

Rows with equal texts are one group. Groups stand in the order of a digest of their text; running
sums of their sizes give the places where a cut is allowed. The smallest capacity for which a greedy
walk needs no more than the given number of shards is found by binary search. The walk needs few
places exactly: it starts from a bounded table of places, which gives a lower and an upper bound for
the capacity, and asks for finer places only where cuts can still lie, until both bounds meet.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from updatelens.llm.common import in_order, n_bytes, session
from updatelens.session import materialize

PLACES = 4096  # places asked for at once, about


@dataclass
class Cuts:
    """Sorted places known so far. ``inner[i]`` tells that more places lie before ``ends[i]``,
    after the place known before it."""

    ends: list[int]
    inner: list[bool]
    total: int

    def walk(self, capacity: int, shards: int, loose: bool = False) -> list[int]:
        """Ends of greedy shards; ``loose`` allows any place inside a stretch with unknown ones."""
        out, at = [], 0
        while at < self.total and len(out) < shards:
            most = at + capacity
            k = bisect_right(self.ends, most) - 1
            to = self.ends[k] if k >= 0 else 0
            if loose and k + 1 < len(self.ends) and self.inner[k + 1]:
                to = most
            if to <= at:
                break
            out.append(min(to, self.total))
            at = out[-1]
        return out

    def smallest(self, shards: int, low: int, loose: bool = False) -> int:
        """The smallest capacity that reaches the end, by binary search."""
        high = max(low, self.total)
        while low < high:
            mid = (low + high) // 2
            done = self.walk(mid, shards, loose)
            if done and done[-1] == self.total:
                high = mid
            else:
                low = mid + 1
        return low

    def backward(self, capacity: int, shards: int) -> list[int]:
        """For each cut, the first place from which the rest still fits."""
        out, at = [], self.total
        for _ in range(shards - 1):
            k = bisect_left(self.ends, at - capacity)
            at = 0 if at <= capacity else self.ends[k]
            out.append(at)
        return out[::-1]

    def even(self, capacity: int, shards: int) -> list[int]:
        """Cuts within the capacity, each the nearest to an equal share."""
        first, out, at = self.backward(capacity, shards), [], 0
        for j, earliest in enumerate(first):
            latest = at + capacity
            goal = min(max(self.total * (j + 1) // shards, earliest), latest)
            k = bisect_left(self.ends, goal)
            near = [p for p in self.ends[max(0, k - 1) : k + 1] if max(earliest, at) <= p <= latest]
            at = min(near, key=lambda p: abs(p - goal)) if near else at
            out.append(at)
        return out


def _places(groups: DataFrame, width: int, windows: list[tuple[int, int]] | None) -> list[tuple[int, bool]]:
    """The last place in every stretch of ``width`` bytes and whether the stretch has others."""
    if windows is not None:
        inside = F.lit(False)
        for a, b in windows:
            inside = inside | ((F.col("place") > a) & (F.col("place") <= b))
        groups = groups.where(inside)
    found = groups.groupBy(F.floor(F.col("place") / F.lit(width)).alias("k")).agg(
        F.max("place").alias("place"), (F.count("*") > 1).alias("inner")
    )
    return [(r["place"], r["inner"]) for r in found.orderBy("place").collect()]


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """The smallest capacity and ``shards - 1`` cuts, from ``groups`` with ``place`` (running sum) and ``size``."""
    row = groups.agg(F.max("place").alias("total"), F.max("size").alias("largest")).first()
    total = row["total"] or 0
    if not total:
        return 0, [0] * (shards - 1)
    low = max(-(-total // shards), row["largest"])
    width = max(1, total // PLACES)
    known = dict(_places(groups, width, None))
    while True:
        ends = sorted(known)
        cuts = Cuts(ends, [known[p] for p in ends], total)
        high = cuts.smallest(shards, low)
        low = cuts.smallest(shards, low, loose=True)
        if low >= high or width == 1:
            return high, cuts.even(high, shards)
        early, late = cuts.walk(low, shards), cuts.walk(high, shards, loose=True)
        windows, at = [], 0  # (after a known place, up to a known place)
        early += [early[-1] if early else 0] * (shards - len(early))
        late += [total] * (shards - len(late))
        for a, b in zip(early, late):
            k = bisect_left(ends, a) - 1
            a = max(ends[k] if k >= 0 else 0, at)
            b = ends[min(len(ends) - 1, bisect_left(ends, b))]
            if a < b:
                windows.append((a, b))
                at = b
        width = max(1, min(width // 2, sum(b - a for a, b in windows) // PLACES))
        kept = {p: i for p, i in known.items() if not any(a < p <= b for a, b in windows)}
        known = kept | dict(_places(groups, width, windows))


def shard(docs: DataFrame, shards: int = 40, overhead: int = 16) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law ``bytes``, shard, slot and a null grown_shard.

    ``size`` is the UTF-8 bytes of the text plus ``overhead``; a null text has none, and null texts
    are one group. Rows of equal texts share a shard. ``slot`` counts from 0 without gaps within a
    shard. With fewer groups than shards some shards stay empty; an empty table gives an empty
    result. Other columns are not read. Rows of a large group are spread over many tasks by their ids.
    """
    session(docs.sparkSession)
    rows = docs.select(
        "doc_id",
        (n_bytes() + F.lit(overhead)).alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.coalesce(F.sha2(F.col("text").cast("binary"), 256), F.lit("")).alias("digest"),
    )
    placed = materialize(in_order(rows, ["digest", "doc_id"], {"until": "size"}))
    groups = placed.groupBy("digest").agg(F.max("until").alias("place"), F.sum("size").alias("size"))
    groups = materialize(groups.select("place", "size").sort("place"))  # a scan can skip what lies outside
    _, cuts = minimax_cuts(groups, shards)
    number = sum(((F.col("until") > F.lit(c)).cast("int") for c in cuts), F.lit(0)).alias("shard")
    placed = placed.select("*", number)
    first = {r["shard"]: r["at"] for r in placed.groupBy("shard").agg(F.min("_rank").alias("at")).collect()}
    at = F.lit(0)
    for k, rank in first.items():  # at most one for each shard
        at = F.when(F.col("shard") == k, F.lit(rank)).otherwise(at)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("_rank") - at).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
