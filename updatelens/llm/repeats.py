"""Long repeated strings: which windows of every text also start elsewhere.

Shared by the byte and the word operator; they differ in the symbols and in what makes a window
repeated. A document is read once into runs of windows that share their least q-gram (``windows``).
Then:

1. buckets: runs by q-gram. A q-gram that stands in one run only, and once in it, has no repeated window.
2. classes: runs of a bucket with the same content. A class settles all windows of its runs at once.
3. open runs: what their class does not settle may still share single windows with other classes
   of the bucket. A run of each class of such a bucket gives its text, and windows are compared
   by 128-bit digests within the bucket. A bucket of more than ``BUCKET`` classes or ``WINDOWS`` windows is
   compared in a shuffle of its windows instead, so no task receives it whole.

Every step moves rows of runs; only step 3 and the last step move texts, once each, by document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from updatelens.llm import windows
from updatelens.llm.common import map_batches, session, utf8
from updatelens.session import materialize

# Classes that are compared within one task; at a few hundred bytes and windows each, about 100 MB.
BUCKET = 16_384
WINDOWS = 1 << 20  # windows of such classes, at 16 bytes of digest each; a run of one letter has as many
NO_ID = (1 << 63) - 1  # a document without an id comes after all others
SPANS = "array<struct<lo:int,hi:int>>"


class _Digests(dict):
    """Digests of words, a bounded number of them remembered."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < 500_000:
            self[word] = value
        return value


_digests = _Digests()


class Bytes:
    """A text as its UTF-8 bytes."""

    def __init__(self, text: str | None):
        self.data = utf8(text)
        self.size = len(self.data)

    def symbols(self) -> np.ndarray:
        return np.frombuffer(self.data, np.uint8)

    def slices(self, first: np.ndarray, last: np.ndarray) -> Iterator[bytes]:
        """The strings from symbol ``first`` to symbol ``last`` inclusive."""
        data = self.data
        return (data[a : b + 1] for a, b in zip(first.tolist(), last.tolist()))

    def without(self, removed: list[tuple[int, int]]) -> bytes:
        kept, at = [], 0
        for a, b in removed:
            kept.append(self.data[at:a])
            at = b
        return b"".join([*kept, self.data[at:]])


class Words:
    """A text as its words; a slice joins them by one space."""

    def __init__(self, text: str | None):
        self.words = utf8(text).split()
        self.size = len(self.words)
        self.data = b" ".join(self.words)
        self.ends = np.cumsum(np.fromiter(map(len, self.words), np.int64, self.size) + 1) - 1
        self.starts = np.concatenate(([0], self.ends[:-1] + 1)).astype(np.int64)

    def symbols(self) -> np.ndarray:
        return np.fromiter(map(_digests.__getitem__, self.words), np.uint64, self.size)

    def slices(self, first: np.ndarray, last: np.ndarray) -> Iterator[bytes]:
        data = self.data
        return (data[a:b] for a, b in zip(self.starts[first].tolist(), self.ends[last].tolist()))

    def without(self, removed: list[tuple[int, int]]) -> bytes:
        kept, at = [], 0
        for a, b in removed:
            kept += self.words[at:a]
            at = b
        return b" ".join([*kept, *self.words[at:]])


@dataclass(frozen=True)
class Task:
    """What is looked for. ``earlier``: a window counts if it also starts in a document with a
    smaller id; otherwise if it also starts anywhere else."""

    read: Callable[[str | None], Bytes | Words]
    length: int
    gram: int
    earlier: bool


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def _keyed(docs: DataFrame) -> DataFrame:
    """``id`` and ``digest`` name a row; rows that agree in both are equal."""
    doc_id = F.col("doc_id").cast("long")
    return docs.select(
        F.coalesce(doc_id, F.lit(NO_ID)).alias("id"),
        F.xxhash64("text", F.isnull("doc_id")).alias("digest"),
        doc_id.alias("doc_id"),
        "text",
    )


def run_table(docs: DataFrame, task: Task) -> DataFrame:
    """All runs of all documents: q-gram ``g``, id, digest, first and last window, content digest ``s``
    and whether a window may stand ``twice`` in the run itself."""

    def read(batch: pd.DataFrame) -> pd.DataFrame:
        owner, grams, first, last, inside, content = [], [], [], [], [], []
        for row, text in enumerate(batch["text"]):
            part = task.read(text)
            if part.size < task.length:
                continue
            for g, lo, hi, twice in windows.runs(part.symbols(), task.length, task.gram):
                owner.append(np.full(len(g), row))
                grams.append(g)
                first.append(lo)
                last.append(hi)
                inside.append(twice)
                content += map(xxhash.xxh3_64_intdigest, part.slices(lo, hi + task.length - 1))
        if not owner:
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("g", "id", "digest", "lo", "hi", "s")}).assign(twice=True)
        at = np.concatenate(owner)
        return pd.DataFrame({
            "g": np.concatenate(grams), "id": batch["id"].to_numpy(np.int64)[at], "digest": batch["digest"].to_numpy(np.int64)[at],
            "lo": np.concatenate(first), "hi": np.concatenate(last), "s": _signed(content),
            "twice": np.concatenate(inside),
        })

    schema = "g long, id long, digest long, lo int, hi int, s long, twice boolean"
    return map_batches(_keyed(docs).drop("doc_id"), read, schema)


def _window_digests(task: Task, content: bytes) -> bytes:
    """A digest of 16 bytes for each window of a run's content."""
    part = _content(task, content)
    first = np.arange(part.size - task.length + 1)
    return b"".join(map(xxhash.xxh3_128_digest, part.slices(first, first + task.length - 1)))


def _marked(rows: pd.DataFrame, task: Task) -> pd.DataFrame:
    """The repeated windows of the open runs among ``rows``, which hold whole buckets."""
    digests = [_window_digests(task, c) for c in rows["content"]]
    times = np.array([len(d) // 16 for d in digests], np.int64)
    keys = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)
    owner = np.repeat(np.arange(len(rows)), times)
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    same = keys[order]
    begin = np.flatnonzero(np.concatenate(([True], (same[1:] != same[:-1]).any(axis=1))))
    group = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(order))))
    ids = rows["id"].to_numpy(np.int64)
    hit = np.zeros(len(owner), bool)
    if task.earlier:
        hit[order] = np.minimum.reduceat(ids[owner[order]], begin)[group] < ids[owner[order]]
    else:
        hit[order] = np.add.reduceat(rows["weight"].to_numpy(np.int64)[owner[order]], begin)[group] > 1
    ends = np.cumsum(times)
    found = [(k, a, b) for k in np.flatnonzero(rows["open"].to_numpy(bool)) for a, b in _stretches(hit[ends[k] - times[k] : ends[k]])]
    k, a, b = np.array(found, np.int64).reshape(-1, 3).T
    lo = rows["lo"].to_numpy(np.int64)[k]
    return pd.DataFrame({"id": ids[k], "digest": rows["digest"].to_numpy(np.int64)[k], "lo": lo + a, "hi": lo + b - 1})


def _compare(task: Task) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Comparison of the windows of whole buckets; the rows come sorted by bucket."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            g = batch["g"].to_numpy()
            cut = int(np.searchsorted(g, g[-1]))  # the last bucket may go on
            if held and held[-1]["g"].iloc[-1] != g[-1]:
                yield _marked(pd.concat([*held, batch.iloc[:cut]], ignore_index=True), task)
                held = []
            elif cut:
                yield _marked(batch.iloc[:cut].reset_index(drop=True), task)
            held.append(batch.iloc[cut:])
        if held:
            yield _marked(pd.concat(held, ignore_index=True), task)

    return compare


def _content(task: Task, content: bytes) -> Bytes | Words:
    part = task.read("")
    if isinstance(part, Bytes):
        part.data, part.size = content, len(content)
        return part
    return task.read(content.decode("utf-8", "surrogatepass"))


def _stretches(hit: np.ndarray) -> Iterator[tuple[int, int]]:
    """(start, end) of every maximal run of true values, the end exclusive."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return zip(edges[::2].tolist(), edges[1::2].tolist())


def _open_windows(docs: DataFrame, reps: DataFrame, task: Task) -> DataFrame:
    """Repeated windows (id, digest, lo, hi) of open runs. ``reps``: a run of each class of the open buckets."""
    spark = docs.sparkSession
    listed = reps.groupBy("id", "digest").agg(
        F.collect_list(F.struct("g", "lo", "hi", "open", "weight", "many")).alias("runs")
    )
    texts = _keyed(docs).select("id", "digest", "text").join(listed, ["id", "digest"])

    def cut(batch: pd.DataFrame) -> pd.DataFrame:
        out, seen = [], set()
        for id_, digest, text, runs in batch[["id", "digest", "text", "runs"]].itertuples(index=False, name=None):
            if (id_, digest) in seen:  # an equal row
                continue
            part = task.read(text)
            lo = np.array([r["lo"] for r in runs])
            hi = np.array([r["hi"] for r in runs])
            for r, content in zip(runs, part.slices(lo, hi + task.length - 1)):
                out.append((r["g"], id_, digest, r["lo"], r["open"], r["weight"], content, r["many"]))
        return pd.DataFrame(out, columns=["g", "id", "digest", "lo", "open", "weight", "content", "many"])

    schema = "g long, id long, digest long, lo int, open boolean, weight int, content binary, many boolean"
    cuts = materialize(map_batches(texts, cut, schema).dropDuplicates(["g", "id", "digest", "lo"]))
    few = cuts.where(~F.col("many")).drop("many")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    near = few.repartition(tasks, "g").sortWithinPartitions("g")
    found = near.mapInPandas(_compare(task), "id long, digest long, lo int, hi int")

    def spread(batch: pd.DataFrame) -> pd.DataFrame:
        digests = [_window_digests(task, c) for c in batch["content"]]
        times = np.array([len(d) // 16 for d in digests], np.int64)
        a, b = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2).T
        owner = np.repeat(np.arange(len(batch)), times)
        place = np.concatenate([np.arange(n) for n in times])
        out = {c: batch[c].to_numpy()[owner] for c in ("id", "digest", "lo", "open", "weight")}
        out["lo"] = out["lo"].astype(np.int64) + place
        return pd.DataFrame({"a": a, "b": b, **out})

    each = map_batches(
        cuts.where("many").drop("many"), spread, "a long, b long, id long, digest long, lo int, open boolean, weight int"
    )
    each = materialize(each)
    best = each.groupBy("a", "b").agg((F.min("id") if task.earlier else F.sum("weight")).alias("best"))
    best = best if task.earlier else best.where("best > 1")
    hit = F.col("best") < F.col("id") if task.earlier else F.col("best") > 1
    wide = each.where("open").join(best, ["a", "b"]).where(hit).select("id", "digest", "lo", F.col("lo").alias("hi"))
    return found.union(wide)


def repeated(docs: DataFrame, task: Task, settle: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(id, digest, lo, hi): stretches of repeated windows of every document; they may touch.

    ``settle`` may rewrite the settled runs (id, digest, g, s, lo, hi) before they are gathered.
    """
    table = materialize(run_table(docs, task))
    least, most = F.min("id"), F.max("id")
    one = F.count("*") == 1
    more = (least < most) if task.earlier else ~one | F.max("twice")
    mixed = (F.min("s") != F.max("s")) if task.earlier else (F.min("s") != F.max("s")) | one
    buckets = table.groupBy("g").agg(more.alias("more"), least.alias("first"), mixed.alias("mixed"))
    buckets = materialize(buckets.where("more").drop("more"))
    runs = materialize(table.join(buckets, "g"))
    plain = runs.where(~F.col("mixed"))
    if task.earlier:
        plain = plain.where("id > first")
    mixed = runs.where("mixed")
    place = F.struct("id", "digest", "lo", "hi")
    classes = mixed.groupBy("g", "s").agg(
        F.least(F.count("*"), F.lit(2)).cast("int").alias("weight"), F.min(place).alias("rep"), F.first("first").alias("first")
    )
    still = F.col("rep.id") > F.col("first") if task.earlier else F.col("weight") == 1
    classes = materialize(classes.withColumn("open", still))
    kept = classes.select("g", "s", F.col("rep.id").alias("owner"), "weight")
    same = mixed.join(kept, ["g", "s"]).where("id > owner" if task.earlier else "weight > 1")
    settled = plain.select("id", "digest", "g", "s", "lo", "hi").union(same.select("id", "digest", "g", "s", "lo", "hi"))
    many = (F.count("*") > BUCKET) | (F.sum(F.col("rep.hi") - F.col("rep.lo") + 1) > WINDOWS)
    wide = classes.groupBy("g").agg(F.max("open").alias("any"), many.alias("many")).where("any")
    if task.earlier:  # the first document of a class may hold it at several places
        own = classes.select("g", "s", F.col("rep.id").alias("owner"), "open", "weight")
        reps = mixed.join(own, ["g", "s"]).where("id = owner").select("g", "id", "digest", "lo", "hi", "open", "weight")
        reps = reps.distinct()
    else:
        reps = classes.select("g", "rep.*", "open", "weight")
    reps = reps.join(wide, "g").select("g", "id", "digest", "lo", "hi", "open", "weight", "many")
    found = _open_windows(docs, materialize(reps), task)
    # Rows that agree in id and text have the same marks, however many they are.
    return (settle(settled) if settle else settled).select("id", "digest", "lo", "hi").union(found).distinct()


def remove(docs: DataFrame, task: Task, settle: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Per row: doc_id, ``size`` in symbols, ``removed`` spans [start, end) and ``kept``, the bytes that stay."""
    session(docs.sparkSession)
    marks = repeated(docs, task, settle)
    listed = marks.groupBy("id", "digest").agg(F.collect_list(F.struct("lo", "hi")).alias("marks"))
    rows = _keyed(docs).join(listed, ["id", "digest"], "left").select("doc_id", "text", "marks")

    def cut(batch: pd.DataFrame) -> pd.DataFrame:
        sizes, spans, kept = [], [], []
        for text, marks_ in zip(batch["text"], batch["marks"]):
            part = task.read(text)
            removed = _merged(marks_, task.length)
            sizes.append(part.size)
            spans.append([{"start": a, "end": b} for a, b in removed])
            kept.append(part.without(removed))
        return pd.DataFrame({"doc_id": batch["doc_id"].array, "size": sizes, "removed": spans, "kept": kept})

    schema = "doc_id long, size long, removed array<struct<start:long,end:long>>, kept binary"
    return map_batches(rows, cut, schema)


def _merged(marks, length: int) -> list[tuple[int, int]]:
    if marks is None or not len(marks):
        return []
    lo = np.array([m["lo"] for m in marks])
    hi = np.array([m["hi"] for m in marks]) + length
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    starts = np.concatenate(([True], lo[1:] > hi[:-1]))
    ends = np.concatenate((np.flatnonzero(starts)[1:] - 1, [len(lo) - 1]))
    return list(zip(lo[starts].tolist(), hi[ends].tolist()))
