"""Removal of lines that many documents share, by levelled sorted runs of line keys.

A run holds the digests of line keys, sorted, each with the number of documents it was met in. Every batch
of documents adds a run of level 0; ``fanout`` runs of one level are merged into one of the next,
so a key lies in few runs however many batches came. Lines are merge-anti-joined with the keys that the runs
hold often enough.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from updatelens.llm.common import map_batches, session, utf8
from updatelens.session import materialize, scratch_dir

MIN_DOCS = 10
MIN_CHARS = 1
BATCHES = 4
FANOUT = 2
# At most so many keys can each hold this part of all lines; they are looked up by a broadcast of 2 MB or less.
HOT = 1 << 16
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_RUN = re.compile(r"/level=(\d+)/first=(\d+)/last=(\d+)/")


def _row(doc_id: str, text: str) -> Column:
    """Rows that agree in id and text lose the same lines, so they need no other name."""
    parts = [F.coalesce(F.col(doc_id).cast("string"), F.lit("-")), F.coalesce(F.col(text), F.lit(""))]
    return F.unhex(F.md5(F.concat_ws("\n", *parts)))


def _keys(text: str | None, min_chars: int) -> Iterator[tuple[int, bytes]]:
    """(place, digest of the key) of every line that has a key. ``strip`` of bytes takes just the six white spaces."""
    for place, line in enumerate(utf8(text).split(b"\n")):
        key = line.strip().translate(_LOWER)
        if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "surrogatepass")) >= min_chars):
            yield place, xxhash.xxh3_128_digest(key)


def line_keys(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(r, p, k, first) per line with a key: row, place from 0, digest of the key, whether the row's first with it."""
    session(docs.sparkSession)
    schema = pa.schema([("r", pa.binary()), ("p", pa.int32()), ("k", pa.binary()), ("first", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, places, keys, first = [], [], [], []
            for row, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                met: set[bytes] = set()
                for place, key in _keys(own, min_chars):
                    owner.append(row)
                    places.append(place)
                    keys.append(key)
                    first.append(key not in met)
                    met.add(key)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip((owner, places, keys, first), schema)], schema=schema
            )

    return docs.select(_row(doc_id, text), F.col(text)).mapInArrow(run, "r binary, p int, k binary, first boolean")


class LineRuns:
    """Sorted runs of (k, docs) below ``folder``, one per batch and merged by levels.

    A batch that is added again replaces its run; a merged run stands for all runs of its batches. Runs
    are found by listing the folder, so the store can be opened again.
    """

    def __init__(self, spark: SparkSession, folder: str, fanout: int = FANOUT):
        self.spark, self.folder, self.fanout = spark, folder.rstrip("/"), fanout
        self.live: list[tuple[int, int, int]] = []

    @classmethod
    def open(cls, spark: SparkSession, folder: str, fanout: int = FANOUT) -> LineRuns:
        """The store as an earlier session left it; runs that a larger one covers are passed over."""
        out = cls(spark, folder, fanout)
        files = spark.read.schema("k binary, docs long").parquet(out.folder).inputFiles()
        found = {tuple(map(int, m.groups())) for f in files if (m := _RUN.search(f))}
        for run in sorted(found, reverse=True):
            if not any(a <= run[1] and run[2] <= b for _, a, b in out.live):
                out.live.append(run)
        out.live.sort(key=lambda run: run[1])
        return out

    def _path(self, run: tuple[int, int, int]) -> str:
        return "{}/level={}/first={}/last={}".format(self.folder, *run)

    def _write(self, counts: DataFrame, run: tuple[int, int, int]) -> None:
        counts.sortWithinPartitions("k").write.mode("overwrite").parquet(self._path(run))
        self.live = [r for r in self.live if not (run[1] <= r[1] and r[2] <= run[2])] + [run]

    def read(self) -> DataFrame:
        """(k, docs) of all live runs; a key may stand in several."""
        if not self.live:
            return self.spark.createDataFrame([], "k binary, docs long")
        return self.spark.read.schema("k binary, docs long").parquet(*[self._path(r) for r in self.live])

    def add(self, batch: int, lines: DataFrame) -> None:
        """Count the keys of a batch's ``lines`` (see ``line_keys``) as run ``batch`` and merge full levels."""
        self._write(lines.where("first").groupBy("k").agg(F.count("*").alias("docs")), (0, batch, batch))
        level = 0
        while len(full := sorted(r for r in self.live if r[0] == level)) >= self.fanout:
            merged = (level + 1, full[0][1], full[-1][2])
            runs = self.spark.read.schema("k binary, docs long").parquet(*[self._path(r) for r in full])
            self._write(runs.groupBy("k").agg(F.sum("docs").alias("docs")), merged)
            level += 1

    def common(self, min_docs: int = MIN_DOCS) -> DataFrame:
        """(k, docs) of the keys met in at least ``min_docs`` documents."""
        return self.read().groupBy("k").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)


def common_places(lines: DataFrame, common: DataFrame) -> DataFrame:
    """(r, gone): the places of each row whose keys are common, in order.

    ``lines`` and ``common`` are written tables. Keys that hold at least a 65,536th of all lines are at most so
    many: they meet their lines by a broadcast. Every other key has too few lines to fill a task.
    """
    hot = F.col("docs") * F.lit(HOT) >= F.lit(lines.count())
    often = common.where(hot).select("k", F.lit(True).alias("_hot"))
    seldom = common.where(~hot).select("k")
    marked = lines.select("r", "p", "k").join(F.broadcast(often), "k", "left")
    gone = marked.where("_hot").select("r", "p").union(
        marked.where("_hot IS NULL").join(materialize(seldom), "k", "left_semi").select("r", "p")
    )
    return gone.distinct().groupBy("r").agg(F.sort_array(F.collect_list("p")).alias("gone"))


def without_places(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, gone) as doc_id, n_lines, n_dropped and kept_text."""

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        sizes, dropped, kept = [], [], []
        for text, gone in zip(batch["text"], batch["gone"]):
            lines = (text or "").split("\n")
            out = set() if gone is None else set(gone.tolist())
            sizes.append(len(lines))
            dropped.append(len(out))
            kept.append("\n".join([x for p, x in enumerate(lines) if p not in out]) if out else text or "")
        return pd.DataFrame({"doc_id": batch["doc_id"].array, "n_lines": sizes, "n_dropped": dropped, "kept_text": kept})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs, run, f"doc_id {kind}, n_lines long, n_dropped long, kept_text string")


def remove_common_lines(
    docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, batches: int = BATCHES, fanout: int = FANOUT
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_lines, n_dropped and kept_text.

    A text's lines are parted by \\n; a null or empty text is one empty line. A line's key is the line without
    white space (space and \\t to \\r) at its ends and with A-Z in lower case. Lines whose key has at
    least ``min_chars`` code points and stands in at least ``min_docs`` documents go from all of them. Every row is a
    document, also where rows or ids repeat or are null; equal rows get equal results. A text of any length is read
    whole, inside its row. An empty table gives an empty result; other columns are not read.

    Keys are told apart by 128 bits of a digest. The rows are counted in ``batches``, each a run of ``LineRuns``.
    """
    spark = session(docs.sparkSession)
    base = f"{scratch_dir(spark)}/lines-{uuid.uuid4().hex}"
    found = line_keys(docs, min_chars=min_chars)
    found = found.withColumn("batch", F.pmod(F.xxhash64("r"), F.lit(batches)).cast("int"))
    found.write.partitionBy("batch").parquet(f"{base}/lines")
    lines = spark.read.schema("r binary, p int, k binary, first boolean, batch int").parquet(f"{base}/lines")
    runs = LineRuns(spark, f"{base}/runs", fanout)
    for batch in range(batches):
        runs.add(batch, lines.where(F.col("batch") == batch))
    gone = materialize(common_places(lines, materialize(runs.common(min_docs))))
    named = docs.select("doc_id", "text", _row("doc_id", "text").alias("r"))
    return without_places(named.join(gone, "r", "left").select("doc_id", "text", "gone"))
