"""Mixing sources to target weights by dependent rounding, with DataFrame operations only.

Every document of a source should be taken the same fractional number of times. The whole part is
taken as it is. The fractions of two documents are settled against each other: a random transfer,
which keeps the expected copies of both and the words of the pair, goes on until one of the two is
0 or 1. The other carries the rest on. Blocks of documents settle within a task; the one document
that each leaves over meets those of other blocks, level by level, so a source ends with a single
random choice. Its words then miss the target by part of one document, and one more exchange with a
document of about that size takes most of this away.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from updatelens.llm.common import attach, in_order, n_words, session, unused
from updatelens.session import materialize

BLOCK = 128  # documents that meet in one fold, on average


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def _uniform(*columns: Column) -> Column:
    """A number in [0, 1) fixed by the columns."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(float(1 << 53))


def _settle(state: Column, unit: Column, seed: int) -> Column:
    """Settle the carried unit against the next one; one of the two becomes 0 or 1."""
    i, j = state["rest"], unit
    ratio = j["size"] / i["size"]
    bounds = F.struct(
        (1 - i["p"]).alias("a1"),
        (j["p"] * ratio).alias("a2"),
        i["p"].alias("b1"),
        ((1 - j["p"]) * ratio).alias("b2"),
        ratio.alias("ratio"),
        _uniform(i["doc_id"], i["digest"], j["doc_id"], j["digest"], F.lit(seed)).alias("u"),
    )

    def carried(base: Column, p: Column) -> Column:
        kept = F.least(F.lit(1.0), F.greatest(F.lit(0.0), p))
        return F.struct(base["size"].alias("size"), base["doc_id"].alias("doc_id"), base["digest"].alias("digest"), kept.alias("p"))

    def settled(b: Column) -> Column:
        alpha, beta = F.least(b["a1"], b["a2"]), F.least(b["b1"], b["b2"])

        def done(first: bool, one: bool) -> Column:
            of, other = (i, j) if first else (j, i)
            amount = {(True, True): -b["a1"] / b["ratio"], (True, False): b["b1"] / b["ratio"]}.get(
                (first, one), -b["b2"] if one else b["a2"]
            )
            result = F.struct(*[of[c].alias(c) for c in ("doc_id", "digest", "size")], F.lit(int(one)).alias("up"))
            return F.struct(carried(other, other["p"] + amount).alias("rest"), result.alias("done"))

        up = b["u"] * (alpha + beta) < beta
        return (
            F.when(up & (b["a1"] <= b["a2"]), done(True, True))
            .when(up, done(False, False))
            .when(b["b1"] <= b["b2"], done(True, False))
            .otherwise(done(False, True))
        )

    return _let(
        _let(bounds, settled),
        lambda s: F.struct(s["rest"].alias("rest"), F.concat(state["done"], F.array(s["done"])).alias("done")),
    )


def _fold(units: DataFrame, seed: int) -> DataFrame:
    """One row for each (source, block): the unit left over and the settled ones. Equal sizes meet first."""
    grouped = units.groupBy("source", "block").agg(
        F.array_sort(F.collect_list(F.struct("size", "doc_id", "digest", "p"))).alias("units")
    )
    none = F.array().cast("array<struct<doc_id:bigint,digest:bigint,size:bigint,up:int>>")
    start = F.struct(F.col("units")[0].alias("rest"), none.alias("done"))
    rest = F.slice("units", 2, F.greatest(F.size("units") - 1, F.lit(0)))
    folded = F.aggregate(rest, start, lambda state, unit: _settle(state, unit, seed))
    return grouped.select("source", "block", folded.alias("f")).select("source", "block", "f.rest", "f.done")


def _balanced(done: DataFrame, last: DataFrame) -> DataFrame:
    """All choices, after one more exchange in each source.

    The last unit of a source is rounded alone, which moves the words of the source by part of its
    size. The settled unit that comes closest to this difference is turned the other way, if that helps.
    """
    over = materialize(last.select("source", ((F.col("up") - F.col("p")) * F.col("size")).alias("over")))
    near = F.abs(F.col("size") - F.abs("over"))
    other = attach(done, over, "source", F.col("digest")).where(
        (F.col("up") == (F.col("over") > 0).cast("int")) & (near < F.abs("over"))
    )
    best = other.groupBy("source").agg(F.min(F.struct(near.alias("near"), "doc_id", "digest")).alias("best"))
    best = materialize(best.select("source", F.col("best.doc_id").alias("_doc"), F.col("best.digest").alias("_digest")))
    found = attach(done, best, "source", F.col("digest"))
    turned = F.col("doc_id").eqNullSafe(F.col("_doc")) & F.col("digest").eqNullSafe(F.col("_digest"))
    up = F.when(turned, 1 - F.col("up")).otherwise(F.col("up")).alias("up")
    columns = ["source", "doc_id", "digest", "size"]
    return found.select(*columns, up).union(last.select(*columns, "up"))


def source_targets(sized: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """Per source: its words, its units and its target.

    Sources by code point, null last, take the weights in turn. A target stops at ``cap`` times the
    source's words; what is above goes to the others by weight until none is above.
    """
    sums = sized.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count("*").alias("rows"), F.isnull("source").alias("_last")
    )
    ranked = in_order(sums, ["_last", "source"], {})
    place = F.pmod(F.col("_rank") - 1, F.lit(len(weights))).cast("int") + 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place)
    facts = materialize(ranked.select("source", "source_size", "rows", weight.alias("weight")))
    most = F.col("source_size") * F.lit(float(cap))
    level, capped = 0.0, -1
    while True:
        above = F.col("weight") * F.lit(level) > most
        row = facts.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(above, F.col("source_size")).otherwise(0)).alias("full"),
            F.sum(F.when(above, 0.0).otherwise(F.col("weight"))).alias("weight"),
            F.sum(F.when(above, 1).otherwise(0)).alias("n"),
        ).first()
        if not row["weight"] or row["n"] == capped:
            break
        level, capped = (share * row["all"] - cap * row["full"]) / row["weight"], row["n"]
        if capped == 0 and level == 0:
            break
    target = F.least(F.col("weight") * F.lit(level), most)
    return facts.select("source", "source_size", "rows", target.alias("target"))


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 20,
) -> DataFrame:
    """Per row of ``docs``: doc_id, digest, size, source_size, target, copies and taken.

    ``size`` is the number of words; ``taken`` is ``size`` times ``copies``. Sources differ by name,
    and null is a source. A null or empty text has size 0; such rows are copied by a choice of their
    own. Rows that agree in id, source and text get the same copies. Every choice is a hash of ids,
    texts and the seed, so reruns agree. An empty table gives an empty result; other columns are not read.
    """
    session(docs.sparkSession)
    rows = materialize(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            "source",
            n_words().alias("size"),
            F.xxhash64("text").alias("digest"),
        )
    )
    facts = materialize(source_targets(rows, weights, share, cap))
    units = rows.groupBy("doc_id", "source", "digest").agg(F.first("size").alias("one"), F.count("*").alias("times"))
    units = attach(units, facts, "source", F.col("digest"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    units = units.withColumn("rate", rate).withColumn("whole", F.floor("rate").cast("int"))
    units = units.withColumn("p", F.col("rate") - F.col("whole"))
    spot = F.xxhash64("doc_id", "digest", F.lit(seed))
    blocks = F.ceil(F.col("rows") / F.lit(BLOCK)).cast("long")
    units = materialize(
        units.select(
            "doc_id", "source", "digest", "p", (F.col("one") * F.col("times")).alias("size"), "whole",
            F.pmod(spot, blocks).alias("block"), blocks.alias("blocks"),
        )
    )
    open_units = units.where((F.col("p") > 0) & (F.col("size") > 0)).select("source", "block", "size", "doc_id", "digest", "p")
    wide = units.agg(F.max("blocks")).first()[0] or 1
    done: list[DataFrame] = []
    while True:
        folded = materialize(_fold(open_units, seed))
        done.append(folded.select("source", F.explode("done").alias("d")).select("source", "d.*"))
        left = folded.select("source", F.floor(F.col("block") / F.lit(BLOCK)).alias("block"), "rest.*")
        if wide <= 1:
            break
        wide, open_units = -(-wide // BLOCK), left
    last = (_uniform(F.col("doc_id"), F.col("digest"), F.lit(seed)) < F.col("p")).cast("int").alias("up")
    choices = _balanced(reduce(DataFrame.union, done), left.select("*", last))
    empty = units.where((F.col("size") == 0) & (F.col("p") > 0)).select("source", "doc_id", "digest", "size", last)
    choices = choices.union(empty).select(
        F.col("source").alias("s"), F.col("doc_id").alias("i"), F.col("digest").alias("d"), "up"
    )
    found = attach(rows, facts, "source", F.col("digest"))
    same = found["doc_id"].eqNullSafe(choices["i"]) & (found["digest"] == choices["d"]) & found["source"].eqNullSafe(choices["s"])
    found = found.join(choices, same, "left")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = (F.floor(rate) + F.coalesce("up", F.lit(0))).cast("int")
    found = found.select("doc_id", "source", "digest", "size", "source_size", "target", copies.alias("copies"))
    return found.withColumn("taken", F.col("size") * F.col("copies"))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with the columns of ``docs``."""
    copies = mix(docs, **options).groupBy("doc_id", "source", "digest").agg(F.first("copies").alias("copies"))
    i, s, d, n, h, each = unused(docs, "_id", "_source", "_digest", "_copies", "_hash", "_each")
    names = {"doc_id": i, "source": s, "digest": d, "copies": n}
    copies = copies.where("copies > 0").select(*[F.col(c).alias(new) for c, new in names.items()])
    marked = docs.withColumn(h, F.xxhash64("text"))
    same = marked["doc_id"].eqNullSafe(copies[i]) & (marked[h] == copies[d]) & marked["source"].eqNullSafe(copies[s])
    joined = marked.join(copies, same).withColumn(each, F.explode(F.array_repeat(F.lit(1), F.col(n))))
    return joined.select(*docs.columns)
