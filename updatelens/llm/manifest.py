"""A Merkle manifest of a dataset, with a proof for every row by octopus multiproofs.

The rows of a source are the leaves of its tree, 16 nodes to a parent; the roots of the sources are the leaves
of one tree more. Leaves are cut into blocks of whole subtrees. A block computes its nodes where it lies, so
only one node of each block is shuffled to build what stands above. For the proofs a block derives which node
coordinates its leaves miss that its own subtree does not give, each once (the octopus), fetches these and
expands the proof of each leaf.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from updatelens.llm.common import attach, in_order, session
from updatelens.session import materialize

WIDTH = 16
BLOCK_LEVELS = 3
BLOCK = WIDTH**BLOCK_LEVELS  # leaves of a block, which one task reads whole
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def H(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode("ascii")).hexdigest()


# --- trees in memory ------------------------------------------------------------------------------

# The siblings of a node, as the digests left and right of it, each joined to one text.
Siblings = tuple[str, str]


def H(text: str) -> str:
    return hashlib.sha256(text.encode("ascii")).hexdigest()


def n_levels(n: int) -> int:
    """How far the root lies above ``n`` leaves."""
    up = 0
    while n > 1:
        n, up = -(-n // WIDTH), up + 1
    return up


def grow(nodes: list[str], up: int) -> list[list[str]]:
    """``nodes`` and the ``up`` levels above them."""
    out = [nodes]
    for _ in range(up):
        out.append([H("".join(out[-1][i : i + WIDTH])) for i in range(0, len(out[-1]), WIDTH)])
    return out


def block_levels(n: int) -> int:
    """Levels that a block of a tree with ``n`` leaves gives by itself."""
    return min(n_levels(n), BLOCK_LEVELS)


def missing(known: range, level: int, n: int) -> list[tuple[int, int]]:
    """The coordinates (level, place) that a holder of the nodes ``known`` of ``level`` needs to reach the root
    of a tree with ``n`` leaves: each once, and none that follows from others."""
    size, out = -(-n // WIDTH**level), []
    first, last = known.start, known.stop - 1
    while size > 1:
        low, high = first // WIDTH * WIDTH, min((last // WIDTH + 1) * WIDTH, size)
        out += [(level, i) for i in range(low, first)] + [(level, i) for i in range(last + 1, high)]
        first, last, size, level = first // WIDTH, last // WIDTH, -(-size // WIDTH), level + 1
    return out


def climb(place: int, level: int, n: int, nodes: dict[tuple[int, int], str]) -> list[Siblings]:
    """Siblings of a node and of all nodes above it, from ``nodes`` by coordinate."""
    size, out = -(-n // WIDTH**level), []
    while size > 1:
        low, high = place // WIDTH * WIDTH, min((place // WIDTH + 1) * WIDTH, size)
        out.append(
            ("".join(nodes[level, i] for i in range(low, place)), "".join(nodes[level, i] for i in range(place + 1, high)))
        )
        place, size, level = place // WIDTH, -(-size // WIDTH), level + 1
    return out


def expand(levels: list[list[str]], upper: list[Siblings]) -> list[list[Siblings]]:
    """The proof of every leaf of a block: siblings inside the block, then those above, which all leaves share."""
    out = []
    for place in range(len(levels[0])):
        proof, at = [], place
        for nodes in levels[:-1]:
            low = at // WIDTH * WIDTH
            proof.append(("".join(nodes[low:at]), "".join(nodes[at + 1 : low + WIDTH])))
            at //= WIDTH
        out.append(proof + upper)
    return out


def fold(leaf: str, proof: list[Siblings]) -> str:
    """The root that a leaf and its siblings give."""
    for left, right in proof:
        leaf = H(left + leaf + right)
    return leaf


# --- leaves -----------------------------------------------------------------------------------------


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(columns: list[Column]) -> Column:
    """H of the columns' values: ``-`` for null, else the bytes of the value, a colon and the value."""
    return F.sha2(F.concat(*[_field(c) for c in columns]), 256)


def document_leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, source, leaf, tampered) per document; other columns are not read.

    Where 5 divides the crc32 of the id (never for a null one), ``tampered`` is the leaf with A-Z of the text in lower
    case; elsewhere it is null. Texts of any length are hashed where they lie.
    """
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    chosen = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return docs.select(
        "doc_id",
        "source",
        leaf_digest([*fields, F.col("text")]).alias("leaf"),
        F.when(chosen, leaf_digest([*fields, F.translate("text", _UPPER, _LOWER)])).alias("tampered"),
    )


# --- trees of many rows -------------------------------------------------------------------------------

_NODE = "_g long, _level int, _i long, digest string, _m long"


def _tops(rows: DataFrame) -> DataFrame:
    """The top node of each block: group, level, place, digest and how many nodes the level has.

    rows: _g (group), _i (place of the leaf in it), _n (leaves of the group), leaf.
    """

    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("_i")
        n, up = int(block["_n"].iloc[0]), block_levels(int(block["_n"].iloc[0]))
        top = grow(block["leaf"].tolist(), up)[-1][0]
        g, place = int(block["_g"].iloc[0]), int(block["_i"].iloc[0]) // WIDTH**up
        return pd.DataFrame([(g, up, place, top, -(-n // WIDTH**up))], columns=["_g", "_level", "_i", "digest", "_m"])

    blocks = rows.select("_g", "_i", "_n", "leaf", _block().alias("_b"))
    return blocks.groupBy("_g", "_b").applyInPandas(run, _NODE)


def _block() -> Column:
    return F.floor(F.col("_i") / BLOCK).cast("long")


def build(rows: DataFrame) -> DataFrame:
    """All nodes from the tops of blocks to the roots: _g, _level, _i, digest, _m; roots have _m 1."""
    levels = [materialize(_tops(rows))]
    while not (below := levels[-1].where("_m > 1")).isEmpty():
        run = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_i", "digest"))), lambda x: x["digest"]), "")
        up = below.groupBy("_g", "_level", F.floor(F.col("_i") / WIDTH).cast("long").alias("_up")).agg(
            F.sha2(run, 256).alias("digest"), F.ceil(F.max("_m") / WIDTH).cast("long").alias("_m")
        )
        levels.append(
            materialize(up.select("_g", (F.col("_level") + 1).alias("_level"), F.col("_up").alias("_i"), "digest", "_m"))
        )
    return reduce(DataFrame.unionByName, levels)


def _fetched(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """(_g, _b, _nodes): what each block misses above its own top, asked for by coordinate and fetched once."""
    blocks = rows.groupBy("_g", _block().alias("_b")).agg(F.max("_n").alias("_n"))

    def run(batches):
        for batch in batches:
            asked = []
            for g, b, n in zip(batch["_g"], batch["_b"], batch["_n"]):
                up = block_levels(n)
                own = b if n > BLOCK else 0
                asked += [(g, b, level, i) for level, i in missing(range(own, own + 1), up, n)]
            yield pd.DataFrame(asked, columns=["_g", "_b", "_level", "_i"])

    asked = blocks.mapInPandas(run, "_g long, _b long, _level int, _i long")
    found = asked.join(nodes.select("_g", "_level", "_i", "digest"), ["_g", "_level", "_i"])
    listed = found.groupBy("_g", "_b").agg(F.collect_list(F.struct("_level", "_i", "digest")).alias("_nodes"))
    return materialize(blocks.select("_g", "_b").join(listed, ["_g", "_b"], "left"))


_PROOF = "array<struct<l:string,r:string>>"


def _proofs(rows: DataFrame, fetched: DataFrame, out: str, shape) -> DataFrame:
    """``shape`` of every block of ``rows`` with the proofs of its leaves. ``fetched`` has a row for each block."""

    def run(block: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("_i", ignore_index=True)
        n = int(block["_n"].iloc[0])
        up = block_levels(n)
        got = asked["_nodes"].iloc[0]
        nodes = {(x["_level"], x["_i"]): x["digest"] for x in (got if got is not None else [])}
        upper = climb(int(block["_i"].iloc[0]) // WIDTH**up, up, n, nodes)
        return shape(block, expand(grow(block["leaf"].tolist(), up), upper), asked)

    left = rows.withColumn("_b", _block()).groupBy("_g", "_b")
    return left.cogroup(fetched.groupBy("_g", "_b")).applyInPandas(run, out)


def _pairs(proof) -> list[Siblings]:
    return [(x["l"], x["r"]) for x in proof]


def prove(leaves: DataFrame) -> DataFrame:
    """Per row of ``leaves`` (doc_id, source, leaf, tampered): doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    The leaves of a source are ordered by doc_id, null first, rows of one id by their digest; sources by their
    bytes, null first. 16 nodes in order, or what is left at the end, make their parent; a lone node is a root.
    ``proof_sha256`` is H of all siblings on the way to the root, ``folded_root`` what the tampered leaf (the leaf
    itself where there is none) gives with the siblings of the untampered tree. An empty table gives an empty result.
    """
    session(leaves.sparkSession)
    kind = leaves.schema["doc_id"].dataType.simpleString()
    # Written first: the range sort reads its input twice.
    slim = materialize(leaves.select("doc_id", "source", "leaf", "tampered"))
    ranked = materialize(in_order(slim, ["source", "doc_id", "leaf"], {}))
    sources = ranked.groupBy("source").agg(F.min("_rank").alias("_low"), F.count("*").alias("_n"))
    sources = in_order(sources, ["source"], {})
    sources = materialize(sources.select("source", (F.col("_rank") - 1).alias("_g"), "_low", "_n"))
    # Whole numbers with nulls would lose digits in pandas, so ids pass as text.
    rows = attach(ranked, sources, "source", F.col("_rank")).select(
        F.col("doc_id").cast("string").alias("doc_id"), "leaf", "tampered", "_g", (F.col("_rank") - F.col("_low")).alias("_i"), "_n"
    )
    rows = materialize(rows)
    nodes = materialize(build(rows))

    # The roots of the sources are the leaves of one tree more.
    subroots = nodes.where("_m = 1").select("_g", F.col("digest").alias("leaf"))
    n_sources = subroots.count()
    top_rows = subroots.select(
        F.lit(0).cast("long").alias("_g"), F.col("_g").alias("_i"), F.lit(n_sources).cast("long").alias("_n"), "leaf"
    )
    top = materialize(build(top_rows))

    def source_proofs(block: pd.DataFrame, proofs: list[list[Siblings]], asked: pd.DataFrame) -> pd.DataFrame:
        told = [[{"l": left, "r": right} for left, right in p] for p in proofs]
        roots = [fold(leaf, p) for leaf, p in zip(block["leaf"], proofs)]
        return pd.DataFrame({"_g": block["_i"], "subroot": block["leaf"], "root": roots, "_top": told})

    tops = _proofs(top_rows, _fetched(top, top_rows), f"_g long, subroot string, root string, _top {_PROOF}", source_proofs)
    fetched = materialize(_fetched(nodes, rows).join(tops, "_g"))

    def row_proofs(block: pd.DataFrame, proofs: list[list[Siblings]], asked: pd.DataFrame) -> pd.DataFrame:
        above = _pairs(asked["_top"].iloc[0])
        subroot, root = asked["subroot"].iloc[0], asked["root"].iloc[0]
        digests, folded = [], []
        for leaf, tampered, proof in zip(block["leaf"], block["tampered"], proofs):
            whole = proof + above
            digests.append(H("".join(left + right for left, right in whole)))
            folded.append(fold(tampered if isinstance(tampered, str) else leaf, whole))
        return pd.DataFrame(
            {
                "doc_id": block["doc_id"], "leaf": block["leaf"], "subroot": subroot, "root": root, "proof_sha256": digests,
                "folded_root": folded, "verified": [f == root for f in folded],
            }
        )

    out = "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    proved = _proofs(rows, fetched, out, row_proofs)
    return proved.withColumn("doc_id", F.col("doc_id").cast(kind))
