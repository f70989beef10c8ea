"""Hard negatives by shared candidate lists of anchor clusters.

Anchors are clustered by direction, and all rows lie in shards of one cluster each. A group of anchors of one
cluster meets a shard as two packed rows; the shard is sorted once by the highest score that any member can
reach with each candidate (from its angle to the centre less the widest angle of a member), and every member walks
this list until what follows cannot enter its result. Each search goes first through the shards of the anchors' own
cluster. The scores reached there are the floor of the walk through all other shards, which then yields few rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from updatelens.llm.common import session
from updatelens.session import materialize

POSITIVES, NEGATIVES = 5, 3
LOWEST, HIGHEST = 50, 95  # hundredths of the positive's score
CLUSTERS = 8
FIT_ROWS = 20_000  # anchors, those with the least digests, from which the centres are learnt
GROUP = 1024  # anchors that walk together, about
SHARD = 8192  # rows of a shard, about
SALTS = 4  # tasks among which the shards of a cluster are dealt
STEP = 512  # candidates between two looks at the floor
LARGEST = 1 << 20  # of a component; inner products of WIDEST such are below 2^53, where doubles hold whole numbers exactly
WIDEST = 1 << 13
_FAR = 1 << 62


def whole_vectors(rows: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, label, v): rows that take part, each component x as floor(scale * x).

    A null label, id or vector, a null or non-finite component, one of 2^20 or more when scaled, and more than
    8,192 components take a row out.
    """
    x = F.col("embedding")
    scaled = F.transform(x, lambda c: F.floor(c.cast("double") * F.lit(float(scale))))
    sound = F.forall(x, lambda c: c.isNotNull() & (F.abs(c.cast("double") * scale) < LARGEST))  # NaN is above all numbers
    fit = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & (F.size(x) <= WIDEST)
    return rows.where(fit & sound).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        F.transform(scaled, lambda c: c.cast("int")).alias("v"),
    )


def contract_rows(embeddings: DataFrame) -> DataFrame:
    """Rows of ``embeddings`` as whole vectors, labels of every seventh id moved on, every fiftieth an anchor."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = whole_vectors(embeddings.select("vec_id", "label", "embedding").withColumn("label", label))
    return rows.withColumn("anchor", F.col("vec_id") % 50 == 0)


# --- in memory ---------------------------------------------------------------------------------------


def centres_of(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Unit centres of at most ``k`` clusters of directions; at least one, also of no rows."""
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    if not len(unit):
        return np.zeros((1, x.shape[1]))
    chosen = [0]
    near = unit @ unit[0]
    while len(chosen) < min(k, len(unit)):  # each time the row farthest from those chosen
        chosen.append(int(near.argmin()))
        near = np.maximum(near, unit @ unit[chosen[-1]])
    centres = unit[chosen]
    for _ in range(rounds):
        of = (unit @ centres.T).argmax(axis=1)
        sums = np.stack([unit[of == c].sum(axis=0) for c in range(len(centres))])
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 1e-9, sums / np.maximum(norms, 1e-9), centres)
    return centres


def _angles(x: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms of the rows and their angles to ``centre``; a zero row or centre stands at a right angle."""
    norms = np.linalg.norm(x, axis=1)
    length = np.linalg.norm(centre)
    return norms, np.arccos(np.clip(x @ centre / np.maximum(norms * length, 1e-12), -1, 1))


def walk(
    a: np.ndarray, a_ids: np.ndarray, a_labels: np.ndarray, low: np.ndarray, high: np.ndarray,
    x: np.ndarray, x_ids: np.ndarray, x_labels: np.ndarray, centre: np.ndarray, same: bool, k: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every member of ``a`` and every of its ranges the ``k`` best candidates with low <= score <= high.

    ``low`` and ``high`` have a row for each member and a column for each range; ``same`` asks for candidates of the
    member's label, else of others. All members walk one list: the candidates by the highest score a member of
    length 1 can have with them. A member stops where this bound times its length is below all its floors, which
    rise with the k-th best score it has met. Returns (member, range, candidate, score).
    """
    x_norms, x_angles = _angles(x, centre)
    a_norms, a_angles = _angles(a, centre)
    bound = x_norms * np.cos(np.maximum(0.0, x_angles - a_angles.max(initial=0)))
    bound = bound + 1e-9 * x_norms + 1e-9  # rounding
    order = np.argsort(-bound, kind="stable")
    low = low.astype(np.float64)
    best = np.full((*low.shape, k), -np.inf)
    none = np.empty(0, np.int64)
    found: list[tuple[np.ndarray, ...]] = [(none, none, none, none)]
    for at in range(0, len(order), STEP):
        ahead = np.nonzero(a_norms * bound[order[at]] >= low.min(axis=1, initial=np.inf))[0]
        if not len(ahead):
            break
        some = order[at : at + STEP]
        score = a[ahead] @ x[some].T
        fit = (a_labels[ahead, None] == x_labels[some]) == same
        fit &= a_ids[ahead, None] != x_ids[some]
        for r in range(low.shape[1]):
            ok = fit & (score >= low[ahead, r, None]) & (score <= high[ahead, r, None])
            met = np.nonzero(ok.any(axis=1))[0]
            if not len(met):
                continue
            mine = np.where(ok[met], score[met], -np.inf)
            who = ahead[met]
            top = np.partition(np.concatenate((best[who, r], mine), axis=1), -k, axis=1)[:, -k:]
            best[who, r] = top
            low[who, r] = np.maximum(low[who, r], top.min(axis=1))
            m, c = np.nonzero(mine >= low[who, r, None])
            found.append((who[m], np.full(len(m), r), some[c], mine[m, c].astype(np.int64)))
    member, slot, which, score = (np.concatenate(part) for part in zip(*found))
    keep = score >= low[member, slot]
    member, slot, which, score = member[keep], slot[keep], which[keep], score[keep]
    rank = np.lexsort((x_ids[which], -score, slot, member))
    member, slot, which, score = member[rank], slot[rank], which[rank], score[rank]
    starts = np.r_[True, (member[1:] != member[:-1]) | (slot[1:] != slot[:-1])] if len(member) else np.empty(0, bool)
    place = np.arange(len(member)) - np.maximum.accumulate(np.where(starts, np.arange(len(member)), 0))
    top = place < k
    return member[top], slot[top], which[top], score[top]


# --- packed rows ---------------------------------------------------------------------------------------


def _packed(rows: DataFrame, key: list[str], lists: list[str]) -> DataFrame:
    """One row per ``key``: ids, labels and vectors of its rows as bytes, and ``lists`` (arrays of longs) too."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        out = {c: [group[c].iloc[0]] for c in key}
        out["ids"] = [group["vec_id"].to_numpy(np.int64).tobytes()]
        out["labels"] = [group["label"].to_numpy(np.int64).tobytes()]
        out["vectors"] = [b"".join(group["v"])]
        for c in lists:
            out[c] = [b"".join(np.asarray(v, np.int64).tobytes() for v in group[c])]
        return pd.DataFrame(out)

    names = ", ".join(f"{c} int" for c in key) + ", ids binary, labels binary, vectors binary"
    return rows.groupBy(*key).applyInPandas(run, names + "".join(f", {c} binary" for c in lists))


def _matrix(data: bytes, n: int, kind: str) -> np.ndarray:
    return np.frombuffer(data, kind).reshape(n, -1).astype(np.float64)


def _search(anchors: DataFrame, shards: DataFrame, centres: np.ndarray, kind: str, own: bool, same: bool, k: int) -> DataFrame:
    """(anchor_id, slot, id, score): the best candidates of each anchor in each shard of its own cluster, or of all others.

    ``anchors`` has vec_id, label, v, cluster, part, low and high.
    """
    n = len(centres)
    groups = materialize(_packed(anchors, ["cluster", "part"], ["low", "high"]))
    groups = groups.select(*[F.col(c).alias(f"a_{c}") for c in groups.columns])
    others = F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda c: c != F.col("a_cluster"))
    met = groups.withColumn("cluster", F.col("a_cluster") if own else F.explode(others))
    met = met.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    pairs = shards.join(met, ["cluster", "salt"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                a_ids, x_ids = np.frombuffer(row.a_ids, np.int64), np.frombuffer(row.ids, np.int64)
                a_labels, x_labels = np.frombuffer(row.a_labels, np.int64), np.frombuffer(row.labels, np.int64)
                low, high = (np.frombuffer(b, np.int64).reshape(len(a_ids), -1) for b in (row.a_low, row.a_high))
                a, x = _matrix(row.a_vectors, len(a_ids), kind), _matrix(row.vectors, len(x_ids), kind)
                member, slot, which, score = walk(
                    a, a_ids, a_labels, low, high, x, x_ids, x_labels, centres[row.a_cluster], same, k
                )
                yield pd.DataFrame({"anchor_id": a_ids[member], "slot": slot, "id": x_ids[which], "score": score})

    return pairs.mapInPandas(run, "anchor_id long, slot int, id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor_id", "slot").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _top(anchors: DataFrame, shards: DataFrame, centres: np.ndarray, kind: str, same: bool, k: int) -> DataFrame:
    """(anchor_id, slot, id, score, rank): the ``k`` best of all shards for each anchor and range."""
    first = materialize(_best(_search(anchors, shards, centres, kind, True, same, k), k))
    if len(centres) == 1:
        return first
    # What the own cluster gave is the floor elsewhere; equal scores may still win by their id.
    full = first.where(F.col("rank") == k).groupBy("anchor_id").agg(
        F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("_floor")
    )
    raised = F.transform("low", lambda v, i: F.greatest(v, F.element_at("_floor", i)))
    known = anchors.join(full, anchors["vec_id"] == full["anchor_id"], "left")
    known = known.select("vec_id", "label", "v", "cluster", "part", raised.alias("low"), "high")
    rest = _search(known, shards, centres, kind, False, same, k)
    return materialize(_best(first.drop("rank").unionByName(rest), k))


def _parts(n: Column, size: int) -> Column:
    return F.greatest(F.ceil(n / F.lit(size)), F.lit(1)).cast("int")


def mine(
    rows: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, lowest: int = LOWEST, highest: int = HIGHEST,
    clusters: int = CLUSTERS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score per hard negative.

    rows: vec_id, label, v (whole numbers), anchor (see ``whole_vectors``). Scores are inner products; shorter vectors
    count as ended by zeros. Higher scores come first, ties by the smaller id. Positives of an anchor are its first
    other rows of its label, negatives of the pair the first rows of other labels whose score is between
    ``lowest`` and ``highest`` hundredths of the positive's. Rows of one id count as one, that with the least label and
    then vector. No rows, or no anchors, give no result.

    The result is exact. Centres are learnt from at most ``FIT_ROWS`` anchors; they only order the lists. Of rows that
    agree in label and vector only the first ``positives`` + 1 ids are walked: the others cannot come before them.
    """
    session(rows.sparkSession)
    chosen = rows.groupBy("vec_id").agg(F.min(F.struct("label", "v", "anchor")).alias("m"))
    base = materialize(chosen.select("vec_id", "m.*"))
    size = base.agg(
        F.max(F.size("v")), F.max(F.array_max(F.transform("v", lambda c: F.abs(c))))
    ).first()
    width, kind = max(size[0] or 0, 1), "<i2" if (size[1] or 0) < 1 << 15 else "<i4"
    fit = base.where("anchor").orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS).select("v").toPandas()["v"]

    def matrix(vectors: pd.Series) -> np.ndarray:
        out = np.zeros((len(vectors), width))
        for i, v in enumerate(vectors):
            out[i, : len(v)] = v
        return out

    centres = centres_of(matrix(fit), clusters)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = matrix(batch["v"])
            batch["cluster"] = (x @ centres.T).argmax(axis=1) if len(x) else np.empty(0, int)
            batch["v"] = [v.tobytes() for v in x.astype(kind)]
            yield batch

    placed = materialize(base.mapInPandas(assign, "vec_id long, label long, v binary, anchor boolean, cluster int"))
    counts = placed.groupBy("cluster").agg(  # a row for each cluster
        _parts(F.count("*"), SHARD).alias("shards"), _parts(F.count_if("anchor"), GROUP).alias("groups")
    )
    placed = placed.join(F.broadcast(counts), "cluster")
    alike = Window.partitionBy("label", "v").orderBy("vec_id")
    first = placed.withColumn("_n", F.row_number().over(alike)).where(F.col("_n") <= max(positives + 1, negatives))
    shard = F.pmod(F.xxhash64("vec_id"), F.col("shards")).cast("int")
    shards = materialize(
        _packed(first.withColumn("shard", shard), ["cluster", "shard"], []).withColumn("salt", F.col("shard") % SALTS)
    )
    part = F.pmod(F.xxhash64("vec_id"), F.col("groups")).cast("int")
    anchors = placed.where("anchor").select("vec_id", "label", "v", "cluster", part.alias("part"))
    anchors = materialize(anchors.withColumn("low", F.array(F.lit(-_FAR))).withColumn("high", F.array(F.lit(_FAR))))

    near = _top(anchors, shards, centres, kind, True, positives)
    near = materialize(near.select("anchor_id", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    # Ranges of whole scores; a range that is empty, or a positive that is not there, asks for nothing.
    score = F.col("positive_score").cast("decimal(20,0)")
    ends = near.select(
        "anchor_id", "slot",
        F.ceil(score * lowest / 100).cast("long").alias("low"), F.floor(score * highest / 100).cast("long").alias("high"),
    )
    listed = ends.groupBy("anchor_id").agg(
        F.map_from_entries(F.collect_list(F.struct("slot", F.struct("low", "high")))).alias("_m")
    )
    slots = F.sequence(F.lit(0), F.lit(positives - 1))
    of = F.transform(slots, lambda i: F.element_at("_m", i))
    wanted = anchors.drop("low", "high").join(listed, anchors["vec_id"] == listed["anchor_id"]).select(
        "vec_id", "label", "v", "cluster", "part",
        F.transform(of, lambda e: F.when(e["low"] <= e["high"], e["low"]).otherwise(F.lit(_FAR))).alias("low"),
        F.transform(of, lambda e: F.coalesce(e["high"], F.lit(-_FAR))).alias("high"),
    )
    hard = _top(materialize(wanted), shards, centres, kind, False, negatives)
    return hard.join(near, ["anchor_id", "slot"]).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
