"""Near duplicates by SimHash: exact comparison of fingerprints in tiles.

Fingerprints are computed from whole texts and made distinct. A tile holds fingerprints with the
same population counts in each of a few equal parts of the 64 bits. Two fingerprints within the
radius differ by at most the radius in the sum of those counts, so all other tile pairs are
skipped; the remaining ones are compared whole by exclusive-or and bit counts. A tile of more
rows than fit a comparison is cut into chunks, each pair of which is compared. A comparison returns
a spanning forest of the links it found, which keeps every connection.

Where texts are to share a stated part of their shingles, such links only propose: the texts that they
connect are compared by their whole sets of shingles, and sets that agree in that part are linked.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from updatelens.llm.common import attach, map_batches, session, unused, utf8
from updatelens.session import materialize

BITS = 64
TILE = 4096  # rows of one side of a comparison
WIDE_TILE = 32_768  # the same where nearly all tiles meet, which sends a row to fewer comparisons
STEP = 100_000  # shingles hashed at once
NEAR = 1 << 17  # pairs compared at once, about a megabyte of differences
SETS = 1024  # sets of one side of a comparison of sets
SET_SIZE = 1 << 19  # shingles of one side of a comparison of sets


@dataclass(frozen=True)
class Closeness:
    """When two texts are linked: fingerprints of shingles of ``width`` words within ``radius`` bits
    and, if ``check_width`` is given, a longer sketch of shingles of that many words within ``check_bits``.

    With ``share``, these are the sketches of the set of shingles of ``width`` words and only propose;
    texts are linked whose sets have a Jaccard similarity of ``share`` or more."""

    width: int = 3
    radius: int = 2
    check_width: int = 0
    check_bits: int = 0
    share: float = 0.0


# Sets that agree in 0.8 differ in about 10 of 64 bits (spread 3) and 39 of 256 (spread 6), the shortest in 12 and 48.
SIMILAR = Closeness(width=5, radius=24, check_width=5, check_bits=80, share=0.8)
CHECKS = ["c0", "c1", "c2", "c3"]


def _shingles(words: list[bytes], width: int) -> tuple[bytes, list[int], list[int]]:
    """The words in one, and where each shingle of ``width`` words begins and ends in it."""
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(width, len(words))
    return whole, starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The digests of the different shingles of ``width`` words of a text, ascending; a 0 without words."""
    words = utf8(text).lower().split()
    if not words:
        return np.zeros(1, np.uint64)
    whole, first, last = _shingles(words, width)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(whole[a:b], 42) for a, b in zip(first, last)), np.uint64, len(first)))


def set_sketch(values: np.ndarray, seeds: int = 5) -> list[int]:
    """SimHash of a set of digests, 64 bits for each of ``seeds`` ways to mix them."""
    out = []
    for seed in range(seeds):
        ones = np.zeros(BITS, np.int64)
        for at in range(0, len(values), STEP):
            x = values[at : at + STEP] + np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(31)
            ones += np.unpackbits(x.view(np.uint8)).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
        out.append(int.from_bytes(np.packbits(2 * ones > len(values)).tobytes(), "big", signed=True))
    return out


def sketch(text: str | None, width: int, seeds: tuple[int, ...] = (42,)) -> list[int]:
    """SimHash of the shingles of ``width`` words of a text, 64 bits for each seed; 0 without words."""
    words = utf8(text).lower().split()
    if not words:
        return [0] * len(seeds)
    whole, first, last = _shingles(words, width)
    ones = np.zeros((len(seeds), BITS), np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(first), STEP):
        cut = [whole[a:b] for a, b in zip(first[at : at + STEP], last[at : at + STEP])]
        for row, seed in enumerate(seeds):
            packed = np.array([digest(c, seed) for c in cut], dtype=">u8").view(np.uint8)
            ones[row] += np.unpackbits(packed).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return [int.from_bytes(np.packbits(row).tobytes(), "big", signed=True) for row in 2 * ones > len(first)]


def fingerprint(text: str | None, width: int = 3) -> int:
    return sketch(text, width)[0]


def fingerprints(docs: DataFrame, close: Closeness = Closeness()) -> DataFrame:
    """doc_id, a digest of the text, ``fp``, the fingerprint as a signed long, and ``node`` of every row.

    With a longer sketch, c0 to c3 hold it; ``node`` names fingerprint and sketch together, or the
    set of shingles where sets are compared.
    """
    checks = CHECKS if close.check_width else []

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        batch["fp"] = np.array([fingerprint(t, close.width) for t in batch["text"]], np.int64)
        if checks:
            found = [sketch(t, close.check_width, (1, 2, 3, 4)) for t in batch["text"]]
            batch[checks] = np.array(found, np.int64).reshape(-1, len(checks))
        return batch[["doc_id", "digest", "fp", *checks]]

    def run_sets(batch: pd.DataFrame) -> pd.DataFrame:
        sets = [shingle_set(t, close.width) for t in batch["text"]]
        batch[["fp", *CHECKS]] = np.array([set_sketch(s) for s in sets], np.int64).reshape(-1, 1 + len(CHECKS))
        batch["node"] = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
        return batch[["doc_id", "digest", "fp", *CHECKS, "node"]]

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("digest"))
    schema = ", ".join([f"doc_id {kind}, digest long, fp long", *(f"{c} long" for c in checks)])
    if close.share:
        return map_batches(rows, run_sets, f"{schema}, node long")
    node = F.xxhash64("fp", *checks) if checks else F.col("fp")
    return map_batches(rows, run, schema).withColumn("node", node)


def _shuffled(df: DataFrame) -> DataFrame:
    """``df`` as the side of a join that is shuffled, whatever its size: a table with a row for each node or
    text grows with the input, and a broadcast would gather it in the driver."""
    return df.hint("merge")


def parts_for(rows: int, radius: int) -> int:
    """Into how many parts the bits are cut so that a tile meets about a tile's rows at this table size.
    A wide radius meets nearly all tiles however they are cut; then the bits stay whole."""
    if radius > 4:
        return 1
    for parts in (4, 8):
        bits = BITS // parts
        equal = math.comb(2 * bits, bits) / 4.0**bits  # chance that two random parts have equal counts
        if rows * equal**parts <= TILE / 4:
            return parts
    return 8


def _counts(fp: Column, parts: int) -> Column:
    """The population counts of the parts, six bits each."""
    bits, out = BITS // parts, F.lit(0).cast("long")
    mask = F.lit((1 << bits) - 1 if parts > 1 else -1).cast("long")
    for i in range(parts):
        count = F.bit_count(F.shiftrightunsigned(fp, i * bits).bitwiseAND(mask)).cast("long")
        out = out + count * F.lit(1 << (6 * i)).cast("long")
    return out


def _steps(parts: int, radius: int) -> list[int]:
    """Differences of counts within the radius, of each pair of opposite ones the first."""
    changes: set[tuple[int, ...]] = {(0,) * parts}
    for _ in range(radius):
        changes |= {c[:i] + (c[i] + d,) + c[i + 1 :] for c, i, d in product(changes, range(parts), (-1, 1))}
    within = [c for c in changes if sum(map(abs, c)) <= radius and c >= (0,) * parts]
    return sorted(sum(v << (6 * i) if v >= 0 else -(-v << (6 * i)) for i, v in enumerate(c)) for c in within)


def _forest(left: np.ndarray, right: np.ndarray, close: Closeness) -> tuple[np.ndarray, np.ndarray]:
    """Links between two lists of rows (node, fingerprint, sketch) that connect all that are close."""
    both = np.concatenate((left, right))
    label = np.arange(len(both))
    one, other = np.ascontiguousarray(left[:, 1]), np.ascontiguousarray(right[:, 1])
    rows = max(1, NEAR // len(right))
    for at in range(0, len(left), rows):
        near = np.bitwise_count(one[at : at + rows, None] ^ other[None, :]) <= close.radius
        found = np.flatnonzero(near.ravel())
        if not len(found):
            continue
        i, j = found // len(right) + at, found % len(right) + len(left)
        if close.check_width and len(i):
            same = np.bitwise_count(both[i, 2:] ^ both[j, 2:]).sum(axis=1, dtype=np.int64) <= close.check_bits
            i, j = i[same], j[same]
        while True:
            low = np.minimum(label[i], label[j])
            if (low == label[i]).all() and (low == label[j]).all():
                break
            np.minimum.at(label, label[i], low)
            np.minimum.at(label, label[j], low)
            np.minimum.at(label, i, low)
            np.minimum.at(label, j, low)
            while (label != label[label]).any():
                label = label[label]
    moved = np.flatnonzero(label != np.arange(len(both)))
    a, b = both[moved, 0], both[label[moved], 0]
    return a[a != b], b[a != b]


def _set_forest(left: np.ndarray, right: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Links between two lists of rows (node, set) that connect all sets that agree in ``share`` or more."""
    nodes = np.concatenate((left[:, 0], right[:, 0])).astype(np.int64)
    sets = [*left[:, 1], *right[:, 1]]
    _, number = np.unique(np.concatenate(sets), return_inverse=True)
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    n = len(left)
    others, begin, theirs = number[starts[n] :], starts[n:] - starts[n], sizes[n:]
    mine = np.zeros(int(number.max()) + 1, bool)
    _, label = np.unique(nodes, return_inverse=True)
    a, b = [], []
    for i in range(n):
        own = number[starts[i] : starts[i] + sizes[i]]
        mine[own] = True
        common = np.add.reduceat(mine[others], begin, dtype=np.int64)
        mine[own] = False
        near = n + np.flatnonzero(common >= share * (sizes[i] + theirs - common) - 1e-9)
        groups, one = np.unique(label[near], return_index=True)
        new = groups != label[i]
        if new.any():
            a += [nodes[i]] * int(new.sum())
            b += nodes[near[one[new]]].tolist()
            label[np.isin(label, groups)] = label[i]
    return np.array(a, np.int64).view(np.uint64), np.array(b, np.int64).view(np.uint64)


def _compare(forest, values: list[str]):
    """``forest`` of sorted runs of rows with equal pair keys; a run may go on in the next batch."""

    def emit(run: pd.DataFrame) -> pd.DataFrame:
        low = run["side"].to_numpy() == 0
        rows = run[values].to_numpy()
        edges = np.flatnonzero(np.any(np.diff(run[["p", "ca", "cb"]].to_numpy(), axis=0) != 0, axis=1)) + 1
        none = np.zeros(0, np.uint64)
        found = [(none, none)]
        for a, b in zip([0, *edges], [*edges, len(run)]):
            left, right = rows[a:b][low[a:b]], rows[a:b][~low[a:b]]
            if len(left) and len(right):
                found.append(forest(left, right))
        a, b = (np.concatenate(x) for x in zip(*found))
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            key = batch[["p", "ca", "cb"]].to_numpy()
            cut = len(batch) - int((key == key[-1]).all(axis=1).sum())
            if held and (held[-1][["p", "ca", "cb"]].to_numpy()[-1] != key[-1]).any():
                yield emit(pd.concat([*held, batch.iloc[:cut]], ignore_index=True))
                held = []
            elif cut:
                yield emit(batch.iloc[:cut].reset_index(drop=True))
            held.append(batch.iloc[cut:])
        if held:
            yield emit(pd.concat(held, ignore_index=True))

    return compare


def links(distinct: DataFrame, close: Closeness) -> DataFrame:
    """Pairs (a, b) of different nodes that connect all close ones.

    ``distinct`` is a written table with a row for each node: node, fp and the sketch, if there is one.
    """
    spark = session(distinct.sparkSession)
    values = ["node", "fp", *(CHECKS if close.check_width else [])]
    parts = parts_for(distinct.count(), close.radius)
    rows = TILE if parts > 1 else WIDE_TILE
    marked = distinct.select(*values, _counts(F.col("fp"), parts).alias("tile"))
    tiles = materialize(marked.groupBy("tile").agg(F.ceil(F.count("*") / F.lit(rows)).cast("int").alias("chunks")))
    steps = F.array(*[F.lit(s).cast("long") for s in _steps(parts, close.radius)])
    near = tiles.select(F.col("tile").alias("ta"), F.col("chunks").alias("na"), F.explode(steps).alias("step"))
    near = near.withColumn("tb", F.col("ta") + F.col("step"))
    other = tiles.select(F.col("tile").alias("tb"), F.col("chunks").alias("nb"))
    # A pair of tiles is told by its first tile and the step to the second.
    # Whole bits give 65 tiles at most; those of parts grow with the rows.
    side = F.broadcast if parts == 1 else _shuffled
    pairs = near.join(side(other), "tb").withColumn("p", F.xxhash64("ta", "step")).select("ta", "tb", "na", "nb", "p")
    pairs = materialize(pairs)
    chunk = F.xxhash64("node", F.lit(1))
    first = marked.join(side(pairs.withColumnRenamed("ta", "tile")), "tile").select(
        "p", F.pmod(chunk, F.col("na")).cast("int").alias("ca"),
        F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("cb"), F.lit(0).alias("side"), *values,
    )
    second = marked.join(side(pairs.withColumnRenamed("tb", "tile")), "tile").select(
        "p", F.explode(F.sequence(F.lit(0), F.col("na") - 1)).alias("ca"),
        F.pmod(chunk, F.col("nb")).cast("int").alias("cb"), F.lit(1).alias("side"), *values,
    )
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = first.union(second).repartition(tasks, "p", "ca", "cb").sortWithinPartitions("p", "ca", "cb")

    def forest(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _forest(left.view(np.uint64), right.view(np.uint64), close)

    return dealt.mapInPandas(_compare(forest, values), "a long, b long").distinct()


def set_links(docs: DataFrame, prints: DataFrame, proposed: DataFrame, close: Closeness) -> DataFrame:
    """Pairs (a, b) of nodes that connect all whose sets of shingles agree in ``close.share`` or more,
    among the nodes with one root in ``proposed`` (node, root).

    A set is made from one text of each such node. All sets of a root are compared; those of a root with
    many are cut into chunks, each pair of which is compared.
    """
    spark = session(docs.sparkSession)
    texts = prints.select("node", "digest", "doc_id").join(_shuffled(proposed), "node")
    chosen = texts.groupBy("node", "root").agg(F.min(F.struct("digest", "doc_id")).alias("k"))
    chosen = materialize(chosen.select("k.digest", F.col("k.doc_id").alias("_first"), "node", "root"))
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("digest"))
    rows = attach(rows, chosen, "digest", F.col("doc_id")).where("node IS NOT NULL AND doc_id <=> _first")

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        batch["words"] = [shingle_set(t, close.width).view(np.int64) for t in batch["text"]]
        return batch[["node", "root", "words"]]

    sets = map_batches(rows.select("node", "root", "text"), run, "node long, root long, words array<long>")
    sets = materialize(sets.groupBy("node", "root").agg(F.first("words").alias("words")))
    many = F.greatest(F.ceil(F.count("*") / F.lit(SETS)), F.ceil(F.sum(F.size("words")) / F.lit(SET_SIZE))).cast("int")
    cut = attach(sets, materialize(sets.groupBy("root").agg(many.alias("chunks"))), "root", F.col("node"))
    cut = cut.withColumn("at", F.pmod(F.xxhash64("node", F.lit(1)), F.col("chunks")).cast("int"))
    first = cut.select(
        F.col("root").alias("p"), F.col("at").alias("ca"),
        F.explode(F.sequence(F.col("at"), F.col("chunks") - 1)).alias("cb"), F.lit(0).alias("side"), "node", "words",
    )
    second = cut.select(
        F.col("root").alias("p"), F.explode(F.sequence(F.lit(0), F.col("at"))).alias("ca"), F.col("at").alias("cb"),
        F.lit(1).alias("side"), "node", "words",
    )
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = first.union(second).repartition(tasks, "p", "ca", "cb").sortWithinPartitions("p", "ca", "cb")
    share = close.share
    return dealt.mapInPandas(
        _compare(lambda left, right: _set_forest(left, right, share), ["node", "words"]), "a long, b long"
    ).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is one node of its connected component.

    Each node takes the smallest of itself and its neighbours, chains of such choices are shortened
    to their ends, and the edges between ends are the next round's. Rounds and shortenings grow with
    the logarithm of a component. Every step is written, so a lost executor repeats little.
    """
    out: DataFrame | None = None
    edges = materialize(edges)
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).union(edges.select("b", "a"))
        up = both.groupBy("node").agg(F.min("to").alias("to"))
        up = materialize(up.select("node", F.least("node", "to").alias("root")))
        while True:
            above = up.select(F.col("node").alias("root"), F.col("root").alias("above"))
            jumped = up.join(_shuffled(above), "root", "left")
            jumped = materialize(jumped.select("node", "above", (F.col("above") != F.col("root")).alias("moved")))
            up = jumped.select("node", F.col("above").alias("root"))
            if jumped.where("moved").isEmpty():
                break
        if out is None:
            out = up
        else:
            higher = up.select(F.col("node").alias("root"), F.col("root").alias("above"))
            out = materialize(
                out.join(_shuffled(higher), "root", "left").select("node", F.coalesce("above", "root").alias("root"))
            )
        root_a = up.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        root_b = up.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        moved = edges.join(_shuffled(root_a), "a").join(_shuffled(root_b), "b").where("ra != rb")
        edges = materialize(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    if out is None:
        out = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return out


def _named(docs: DataFrame, close: Closeness) -> tuple[DataFrame, DataFrame]:
    """The fingerprints of every row and (node, root, component_id) of every node, both written."""
    prints = materialize(fingerprints(docs, close))
    values = [c for c in prints.columns if c not in ("doc_id", "digest", "node")]
    distinct = prints.groupBy("node").agg(F.min("doc_id").alias("first"), *[F.min(c).alias(c) for c in values])
    distinct = materialize(distinct)
    roots = components(links(distinct, close))
    if close.share:
        roots = components(set_links(docs, prints, roots, close))
    roots = roots.withColumnRenamed("node", "_node")
    linked = distinct.join(_shuffled(roots), distinct["node"] == roots["_node"], "left")
    linked = linked.select("node", "first", F.coalesce("root", "node").alias("root"))
    # Written, so that the join below can split a component of many nodes.
    linked = materialize(linked)
    least = materialize(linked.groupBy("root").agg(F.min("first").alias("component_id")))
    return prints, materialize(linked.join(_shuffled(least), "root").select("node", "root", "component_id"))


def near_duplicates(docs: DataFrame, close: Closeness = Closeness()) -> DataFrame:
    """Per row: doc_id, ``fp`` and ``component_id``, the smallest id that links reach.

    Texts without words, null ones included, have the fingerprint 0 and link like others. Rows with
    equal fingerprints are one component; a component whose ids are all null has a null id. An
    empty table gives an empty result. Other columns are not read.
    """
    prints, named = _named(docs, close)
    return prints.join(_shuffled(named), "node").select("doc_id", "fp", "component_id")


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def first_of_each(docs: DataFrame, close: Closeness = SIMILAR) -> DataFrame:
    """One row of each component, with the columns of ``docs``: that with the smallest id (null last),
    of equal ids that with the smaller digest of its text, of equal rows one. Texts without words are one component."""
    prints, named = _named(docs, close)
    place = F.struct(F.isnull("doc_id").alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "digest")
    kept = prints.join(_shuffled(named), "node").groupBy("root").agg(F.min(place).alias("k")).select("k.*")
    keys = unused(docs, "_none", "_id", "_digest")
    kept = kept.select(*[F.col(c).alias(k) for c, k in zip(("none", "id", "digest"), keys)]).distinct()
    own = (F.isnull("doc_id"), F.coalesce("doc_id", F.lit(0)), F.xxhash64("text"))
    marked = docs.select("*", *[c.alias(k) for c, k in zip(own, keys)])
    return marked.join(_shuffled(kept), keys, "left_semi").dropDuplicates(keys).select(*docs.columns)
