"""Removal of passages that an earlier document has, by a compacted graph of word k-mers.

Nodes are the least k-mers of the 50-word windows; a run of windows is an edge from its k-mer to the
next, labelled by its words. Edges that repeat are linked where one always follows the other and
nothing else does; such nonbranching paths are compacted by pointer doubling. The source coordinates
of a path's edges must join without gaps before they become one long span.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from updatelens.llm.repeats import Task, Words, remove
from updatelens.session import materialize


def _links(edges: DataFrame) -> DataFrame:
    """(e, before): edges of which ``before`` is the only predecessor and which are its only successor."""
    ahead = edges.select("id", "digest", (F.col("hi") + 1).alias("lo"), F.col("e").alias("before"))
    pairs = edges.join(ahead, ["id", "digest", "lo"], "left").select("e", "before")
    behind = pairs.groupBy("e").agg(
        F.min("before").alias("before"), F.max("before").alias("other"), F.count("*").alias("n"), F.count("before").alias("m")
    )
    single = materialize(behind.select("e", "n", F.when((F.col("before") == F.col("other")) & (F.col("n") == F.col("m")), F.col("before")).alias("before")))
    ahead_of = single.where("before IS NOT NULL")
    # The predecessor must have as many occurrences: each of them then goes on to this edge.
    sizes = single.select(F.col("e").alias("before"), F.col("n").alias("times"))
    linked = ahead_of.join(sizes, "before").where("n = times").select("e", "before")
    return single.select("e").join(linked, "e", "left")


def _heads(links: DataFrame) -> DataFrame:
    """(e, head): the first edge of the path of every edge. An edge on a closed path heads itself."""
    state = materialize(links.select("e", F.coalesce("before", "e").alias("head"), F.isnull("before").alias("done")))
    left = state.where(~F.col("done")).count()
    while left:
        above = state.select(F.col("e").alias("head"), F.col("head").alias("above"), F.col("done").alias("ended"))
        state = materialize(state.join(above, "head", "left").select(
            "e", F.when(F.col("done"), F.col("head")).otherwise(F.col("above")).alias("head"), (F.col("done") | F.col("ended")).alias("done")
        ))
        still = state.where(~F.col("done")).count()
        if still == left:  # closed paths only
            break
        left = still
    return state.select("e", F.when(F.col("done"), F.col("head")).otherwise(F.col("e")).alias("head"))


def compact(settled: DataFrame) -> DataFrame:
    """Occurrences (id, digest, lo, hi) of whole paths in place of those of their edges."""
    edges = materialize(settled.select("id", "digest", "lo", "hi", F.xxhash64("g", "s").alias("e")).distinct())
    headed = edges.join(_heads(_links(edges)), "e")
    # Neighbours on one path lie in one document: an occurrence begins where the run before is of another path.
    listed = headed.groupBy("id", "digest", "head").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("runs"))
    first = F.slice("runs", 1, 1)
    joined = F.aggregate(
        F.slice("runs", 2, F.greatest(F.size("runs") - 1, F.lit(0))),
        first,
        lambda spans, run: F.when(
            F.element_at(spans, -1)["hi"] + 1 == run["lo"],
            F.concat(
                F.slice(spans, 1, F.size(spans) - 1),
                F.array(F.struct(F.element_at(spans, -1)["lo"].alias("lo"), run["hi"].alias("hi"))),
            ),
        ).otherwise(F.concat(spans, F.array(run))),
    )
    return listed.select("id", "digest", F.explode(joined).alias("span")).select("id", "digest", "span.lo", "span.hi")


def remove_earlier_passages(docs: DataFrame, length: int = 50, gram: int = 8) -> DataFrame:
    """Per row: doc_id, size in words, ``removed`` spans [start, end) of words and ``kept``, the other words.

    A word is removed if a window of ``length`` words over it also starts in a document with a smaller
    id. A null id comes after all others; rows with equal ids do not remove from each other. A null
    text has no words. An empty table gives an empty result; other columns are not read.
    """
    return remove(docs, Task(Words, length, gram, earlier=True), compact)
