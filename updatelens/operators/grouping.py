"""Similarity of texts and grouping of items into updates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from updatelens import constants as K
from updatelens.functions import text as T
from updatelens.functions.links import url_host
from updatelens.functions.values import observed_at
from updatelens.operators.features import with_counts
from updatelens.operators.tiles import side, similar
from updatelens.options import GroupingOptions
from updatelens.session import materialize
from updatelens.skew import lookup

# --- cosine similarity --------------------------------------------------------------------------


def dot_product(left: Column, right: Column) -> Column:
    """Inner product of two (token, tf) arrays with distinct tokens: after one sort of both
    together, equal tokens are neighbours."""
    both = F.sort_array(F.concat(left, right))
    start = F.struct(
        F.lit(None).cast("string").alias("token"),
        F.lit(0).cast("bigint").alias("tf"),
        F.lit(0).cast("bigint").alias("dot"),
    )

    def step(acc: Column, x: Column) -> Column:
        same = F.coalesce(acc["token"] == x["token"], F.lit(False))
        gain = F.when(same, acc["tf"] * x["tf"]).otherwise(F.lit(0).cast("bigint"))
        return F.struct(x["token"].alias("token"), x["tf"].alias("tf"), (acc["dot"] + gain).alias("dot"))

    return F.aggregate(both, start, step, lambda acc: acc["dot"])


def squared_norm(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("bigint"), lambda acc, x: acc + x["tf"] * x["tf"])


def cosine(dot: Column, left_norm: Column, right_norm: Column) -> Column:
    """Cosine from integer parts: two empty texts are alike, one empty text matches nothing."""
    value = dot / (F.sqrt(left_norm) * F.sqrt(right_norm))
    return (
        F.when((left_norm == 0) & (right_norm == 0), F.lit(1.0))
        .when((left_norm == 0) | (right_norm == 0) | (dot == 0), F.lit(0.0))
        .otherwise(F.least(F.lit(1.0), value))
    )


def text_vectors(df: DataFrame, id_col: str, text: Column | str) -> DataFrame:
    """Token counts and squared norm per text: (id, counts, norm)."""
    base = df.select(id_col, T.tokenize(text).alias("_tokens"))
    counted = with_counts(base, "_tokens", "counts")
    return counted.select(id_col, "counts", squared_norm(F.col("counts")).alias("norm"))


def cosine_pairs(left: DataFrame, right: DataFrame, pairs: DataFrame) -> DataFrame:
    """Similarity of the given pairs only. left: (left_id, text), right: (right_id, text)."""
    lv = text_vectors(left, "left_id", "text").withColumnsRenamed({"counts": "_lc", "norm": "_ln"})
    rv = text_vectors(right, "right_id", "text").withColumnsRenamed({"counts": "_rc", "norm": "_rn"})
    return _similarity(pairs, lv, rv, "left_id", "right_id")


def _similarity(
    pairs: DataFrame, lv: DataFrame, rv: DataFrame, left_id: str, right_id: str, at_least: float | None = None
) -> DataFrame:
    """Similarity per pair; with ``at_least`` only of pairs that reach it.

    A pair costs far more work than bytes, so the list, ids only, is spread over all cores first.
    """
    pairs = pairs.repartition(pairs.sparkSession.sparkContext.defaultParallelism, left_id, right_id)
    rows = lookup(pairs, lv, [left_id], F.col(right_id))
    rows = lookup(rows, rv, [right_id], F.col(left_id))
    value = T.let(
        dot_product(F.col("_lc"), F.col("_rc")), lambda dot: cosine(dot, F.col("_ln"), F.col("_rn"))
    )
    if at_least is None:
        return rows.select(*pairs.columns, value.alias("similarity"))
    # The outer form keeps the planner from computing the similarity once more for a filter.
    reached = F.filter(F.array(value), lambda s: s >= at_least)
    return rows.select(*pairs.columns, F.explode_outer(reached).alias("similarity")).where("similarity IS NOT NULL")


# --- items against stored updates ---------------------------------------------------------------


def topic_keys(topics: Column, primary: Column) -> Column:
    """Distinct lower-case topics of an item, its primary topic included."""
    present = F.filter(topics, lambda t: T.trim_ws(t) != "")
    return F.array_distinct(
        F.concat(F.transform(present, lambda t: F.lower(T.trim_ws(t))), F.array(F.lower(primary)))
    )


def probe_text(title: Column, topic: Column) -> Column:
    return F.concat_ws("\n", title, topic)


def representative_text(title: Column, topic: Column) -> Column:
    """Text an update keeps from its founding; title and topic are cut as they are stored."""
    return F.concat_ws(
        "\n", T.clamp_trimmed(title, K.REPRESENTATIVE_TITLE_MAX), T.clamp_trimmed(topic, K.TOPIC_MAX)
    )


def window_start(as_of: Column, options: GroupingOptions) -> Column:
    return as_of - F.make_dt_interval(hours=F.lit(options.window_hours))


def _recent_updates(updates: DataFrame, as_of: Column, options: GroupingOptions) -> DataFrame:
    """Updates in the window, with a limit the newest of each topic only: (update_id, last_observed_at, topic)."""
    recent = updates.where(F.col("last_observed_at") >= window_start(as_of, options)).select(
        "update_id", "last_observed_at", F.lower("primary_topic").alias("topic")
    )
    if options.max_comparisons is None:
        return recent
    order = W.partitionBy("topic").orderBy(F.col("last_observed_at").desc(), "update_id")
    ranked = recent.withColumn("_n", F.row_number().over(order))
    return ranked.where(F.col("_n") <= options.max_comparisons).drop("_n")


def candidate_updates(
    items: DataFrame, updates: DataFrame, as_of: Column, options: GroupingOptions = GroupingOptions()
) -> DataFrame:
    """Updates in the window that share a topic with each item, newest first: (item_id, update_id, position).

    With ``max_comparisons`` only so many of an item's newest candidates are given. They are among the
    newest of each of its topics, so each topic then contributes no more than that many updates.
    """
    cap = options.max_comparisons
    newest = [F.col("last_observed_at").desc(), F.col("update_id")]
    recent = _recent_updates(updates, as_of, options)
    wanted = items.select(
        "item_id", F.explode_outer(topic_keys(F.col("topics"), F.col("primary_topic"))).alias("topic")
    )
    found = wanted.join(recent, "topic")
    placed = found.withColumn("position", F.row_number().over(W.partitionBy("item_id").orderBy(*newest)))
    if cap is not None:
        placed = placed.where(F.col("position") <= cap)
    return placed.select("item_id", "update_id", "position")


def best_match(scored: DataFrame) -> DataFrame:
    """Most similar update per item, the smaller id on equal similarity."""
    order = W.partitionBy("item_id").orderBy(F.col("similarity").desc(), "update_id")
    return scored.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def assign_to_updates(
    items: DataFrame, updates: DataFrame, as_of: Column, options: GroupingOptions = GroupingOptions()
) -> DataFrame:
    """Merge target of each item among stored updates: (item_id, update_id, similarity), null when
    the item founds its own.

    Without ``max_comparisons`` all updates of the window count, and only those that can reach the threshold are compared.
    """
    if options.max_comparisons is None:
        from updatelens.operators.candidates import assign_among_all

        return assign_among_all(items, updates, as_of, options)
    # Few updates of a topic can be candidates, so all its items meet them in tiles; pairs carry ids only.
    probes = items.select(
        F.col("item_id").cast("string").alias("id"), topic_keys(F.col("topics"), F.col("primary_topic")).alias("_topics"),
        T.tokenize(probe_text(F.col("title"), F.col("primary_topic"))).alias("_p"),
    )
    probes = with_counts(probes, "_p", "probe").select(
        "id", "probe", squared_norm(F.col("probe")).alias("probe_norm"), F.explode("_topics").alias("_topic")
    )
    recent = _recent_updates(updates, as_of, options).select("update_id")
    reps = updates.join(recent, "update_id", "left_semi").select(
        F.col("update_id").cast("string").alias("id"), F.lower("primary_topic").alias("topic"),
        T.tokenize(representative_text(F.col("representative_title"), F.col("primary_topic"))).alias("_r"),
    )
    reps = with_counts(reps, "_r", "rep").withColumn("rep_norm", squared_norm(F.col("rep")))
    near = similar(
        side(probes, F.col("_topic"), "probe", "probe_norm", F.lit(0), F.col("id")),
        side(materialize(reps), F.col("topic"), "rep", "rep_norm", F.lit(0), F.col("id")),
        options.merge_threshold, "all",
    )
    pairs = candidate_updates(items, updates, as_of, options).select(
        "item_id", "update_id", F.col("item_id").cast("string").alias("probe_id"), F.col("update_id").cast("string").alias("rep_id")
    )
    scored = pairs.join(materialize(near), ["probe_id", "rep_id"]).select("item_id", "update_id", "similarity")
    best = best_match(scored)
    return items.select("item_id").join(best.select("item_id", "update_id", "similarity"), "item_id", "left")


# --- whole batches ------------------------------------------------------------------------------

_SLACK = 1e-9
_COMMON_TOKENS = 4096


def _token_order(vectors: DataFrame) -> DataFrame:
    """Frequency of the most common tokens; every other token counts as rare. Any fixed order gives
    exact results, so a bounded list is enough."""
    tokens = vectors.select(F.explode_outer("probe.token").alias("token"))
    counted = tokens.groupBy("token").agg(F.count("*").alias("_freq"))
    return counted.orderBy(F.col("_freq").desc(), "token").limit(_COMMON_TOKENS)


def _block_entries(vectors: DataFrame, side: str, topics: Column, common: DataFrame, threshold: float) -> DataFrame:
    """(id, topic, token, reach) for the tokens of each text that can be the first token, rare to
    common, it shares with a text at ``threshold``: what follows such a token still carries enough
    of the norm. ``reach`` is that share of the squared norm."""
    counts = F.col(side)
    empty = F.array(F.struct(F.lit("").alias("token"), F.lit(1).cast("bigint").alias("tf")))
    long = vectors.select(
        "id", topics.alias("_topics"), F.col(f"{side}_norm").alias("_norm"),
        F.inline_outer(F.when(F.size(counts) > 0, counts).otherwise(empty)),
    )
    ranked = long.join(F.broadcast(common), "token", "left").withColumn("_freq", F.coalesce("_freq", F.lit(0)))
    # From the most common token back: the running sum is the squared norm of the tail.
    tail = W.partitionBy("id").orderBy(F.col("_freq").desc(), F.col("token").desc()).rowsBetween(
        W.unboundedPreceding, 0
    )
    reach = F.sum(F.col("tf") * F.col("tf")).over(tail) / F.greatest(F.col("_norm"), F.lit(1))
    kept = ranked.withColumn("reach", reach).where(F.col("reach") >= threshold**2 - _SLACK)
    return kept.select("id", F.explode("_topics").alias("topic"), "token", "reach")


def _probes(vectors: DataFrame) -> DataFrame:
    """Texts as they look for founders, a row for each topic."""
    spread = vectors.withColumn("_topic", F.explode("topics"))
    return side(spread, F.col("_topic"), "probe", "probe_norm", F.unix_micros("seq.received_at"), F.col("seq.item_id"))


def _reps(vectors: DataFrame) -> DataFrame:
    """Texts as founders."""
    return side(vectors, F.col("topic"), "rep", "rep_norm", F.unix_micros("seq.received_at"), F.col("seq.item_id"))


def _founders(vectors: DataFrame, threshold: float) -> DataFrame:
    """Texts that found an update: no earlier founder is similar to them. (id)

    Every round keeps the undecided texts without an earlier similar one among the undecided, and drops those that are
    similar to a text it keeps. Of a text only whether there is such an earlier one leaves the comparison.
    """
    founders: list[DataFrame] = []
    while True:
        some = similar(_probes(vectors), _reps(vectors), threshold, "any", earlier=True)
        waiting = materialize(some.select(F.col("probe_id").alias("id")).distinct())
        new = materialize(vectors.select("id").join(waiting, "id", "left_anti"))
        founders.append(new)
        rest = vectors.join(waiting, "id", "left_semi")
        taken = similar(_probes(rest), _reps(vectors.join(new, "id", "left_semi")), threshold, "any", earlier=True)
        vectors = materialize(rest.join(taken.select(F.col("probe_id").alias("id")), "id", "left_anti"))
        if vectors.isEmpty():
            return reduce(DataFrame.unionByName, founders)


def group_items(
    items: DataFrame,
    as_of: Column,
    options: GroupingOptions = GroupingOptions(),
    stored: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Group a whole batch as if its items came one by one in the order (received_at, item_id).

    items: item_id, title, primary_topic, topics, observed_at, received_at. An item joins the most
    similar earlier founder that is inside the window at ``as_of`` and whose topic is among the
    item's, when the similarity reaches the threshold; else it founds an update under its own id.
    All candidates in the window are compared; a limit in ``options`` is refused. ``stored`` updates (update_id,
    representative_title, primary_topic, last_observed_at) came before the batch and take part.

    Returns (updates, links) of the batch: updates with update_id, representative_title, primary_topic,
    first_observed_at, last_observed_at; links with update_id, item_id, similarity.
    """
    if options.max_comparisons is not None:
        raise ValueError("a batch is grouped among all candidates; max_comparisons must be None")
    t = options.merge_threshold
    base = _grouping_base(items, as_of, options)
    base = materialize(base)
    # Texts with the same counts and topics behave alike: only the first one in the window can found.
    texts = base.groupBy("text_id").agg(
        F.min(F.when(F.col("in_window"), F.col("seq"))).alias("seq"), F.min("item_id").alias("_any")
    )
    chosen = texts.withColumn("item_id", F.coalesce("seq.item_id", "_any"))
    vectors = materialize(
        base.drop("seq", "text_id", "in_window")
        .join(chosen, "item_id")
        .withColumnRenamed("text_id", "id")
        .select("id", "seq", "probe", "probe_norm", "rep", "rep_norm", "topics", "topic")
    )
    able = vectors.where("seq IS NOT NULL")
    known = None
    if stored is not None:
        known = materialize(_stored_vectors(stored, vectors, as_of, options))
        joins = similar(_probes(able), _reps(known), t, "any", earlier=True).select(F.col("probe_id").alias("id"))
        able = materialize(able.join(joins, "id", "left_anti"))
    founders = _founders(able, t)
    founding = able.join(founders, "id", "left_semi")
    if known is not None:
        founding = founding.unionByName(known)
    founding = materialize(founding)
    # Any item of a text may come before or after a founder, so compare without regard to order.
    near = similar(_probes(vectors), _reps(founding), t, "records")
    near = near.join(founding.select(F.col("id").alias("rep_id"), F.col("seq").alias("founder")), "rep_id")
    best = materialize(_best_until(near))
    open_items = base.select("item_id", "seq", F.col("text_id").alias("probe_id"))
    joined = open_items.join(best, "probe_id", "left")
    fits = (F.col("from_seq") < F.col("seq")) & (F.col("until_seq").isNull() | (F.col("seq") <= F.col("until_seq")))
    target = (
        joined.where(fits).select("item_id", F.col("founder.item_id").alias("update_id"), "similarity")
    )
    links = items.select("item_id").join(target, "item_id", "left").select(
        F.coalesce("update_id", "item_id").alias("update_id"), "item_id", "similarity"
    )
    links = materialize(links)
    return updates_from_links(links, items), links


def _stored_vectors(stored: DataFrame, vectors: DataFrame, as_of: Column, options: GroupingOptions) -> DataFrame:
    """Stored updates of the window as texts that precede every item."""
    id_type = vectors.schema["seq"].dataType["item_id"].dataType
    recent = stored.where(F.col("last_observed_at") >= window_start(as_of, options)).select(
        F.concat(F.lit("stored:"), F.col("update_id").cast("string")).alias("id"),
        F.struct(
            F.lit("0001-01-01").cast("timestamp").alias("received_at"), F.col("update_id").cast(id_type).alias("item_id")
        ).alias("seq"),
        T.tokenize(representative_text(F.col("representative_title"), F.col("primary_topic"))).alias("_r"),
        F.lower("primary_topic").alias("topic"),
    )
    counted = with_counts(recent, "_r", "rep").withColumn("rep_norm", squared_norm(F.col("rep")))
    return counted.select(
        "id", "seq", F.col("rep").alias("probe"), F.col("rep_norm").alias("probe_norm"), "rep", "rep_norm",
        F.array("topic").alias("topics"), "topic",
    )


def _grouping_base(items: DataFrame, as_of: Column, options: GroupingOptions) -> DataFrame:
    keys = topic_keys(F.col("topics"), F.col("primary_topic"))
    shaped = items.select(
        "item_id",
        F.struct(F.col("received_at").cast("timestamp").alias("received_at"), F.col("item_id")).alias("seq"),
        (F.col("observed_at") >= window_start(as_of, options)).alias("in_window"),
        F.sort_array(keys).alias("topics"),
        F.lower("primary_topic").alias("topic"),
        T.tokenize(probe_text(F.col("title"), F.col("primary_topic"))).alias("_p"),
        T.tokenize(representative_text(F.col("title"), F.col("primary_topic"))).alias("_r"),
    )
    counted = with_counts(with_counts(shaped, "_p", "probe"), "_r", "rep")
    text_id = F.sha2(F.to_json(F.struct("probe", "rep", "topics", "topic")), 256)
    return counted.select(
        "item_id", "seq", "in_window", "topics", "topic", "probe", "rep",
        squared_norm(F.col("probe")).alias("probe_norm"),
        squared_norm(F.col("rep")).alias("rep_norm"),
        text_id.alias("text_id"),
    )


def _best_until(near: DataFrame) -> DataFrame:
    """Per text, the founders that are the best match for a while, and for how long: an item takes
    the best of the founders before it, so only founders better than all earlier ones matter."""
    rank = F.struct((-F.col("similarity")).alias("s"), F.col("founder.item_id").alias("u"))
    by_time = W.partitionBy("probe_id").orderBy("founder")
    so_far = F.min("rank").over(by_time.rowsBetween(W.unboundedPreceding, -1))
    records = (
        near.withColumn("rank", rank)
        .withColumn("_before", so_far)
        .where(F.col("_before").isNull() | (F.col("rank") < F.col("_before")))
    )
    return records.select(
        "probe_id", "founder", "similarity", F.col("founder").alias("from_seq"),
        F.lead("founder").over(by_time).alias("until_seq"),
    )


def updates_from_links(links: DataFrame, items: DataFrame) -> DataFrame:
    """Update rows of founder links: text of the founder, observed window over all linked items."""
    facts = items.select(
        "item_id", "title", "primary_topic", F.col("observed_at")
    )
    joined = links.join(facts, "item_id")
    founder = F.col("item_id") == F.col("update_id")
    return joined.groupBy("update_id").agg(
        F.max(F.when(founder, T.clamp_trimmed("title", K.REPRESENTATIVE_TITLE_MAX))).alias("representative_title"),
        F.max(F.when(founder, T.clamp_trimmed("primary_topic", K.TOPIC_MAX))).alias("primary_topic"),
        F.min("observed_at").alias("first_observed_at"),
        F.max("observed_at").alias("last_observed_at"),
        F.count("*").alias("item_count"),
    )


# --- facts per update ---------------------------------------------------------------------------


def upsert_matches(links: DataFrame, matches: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Strongest match per update and interest, with the latest time of any match.

    links: update_id, item_id; matches: item_id, interest_id, strength, matched_at.
    """
    fresh = matches.join(links.select("update_id", "item_id"), "item_id").select(
        "update_id", "interest_id", "strength", "matched_at"
    )
    if stored is not None:
        fresh = fresh.unionByName(stored.select("update_id", "interest_id", "strength", "matched_at"))
    return fresh.groupBy("update_id", "interest_id").agg(
        F.max("strength").alias("strength"), F.max("matched_at").alias("matched_at")
    )


def update_windows(links: DataFrame, items: DataFrame) -> DataFrame:
    """First and last observation over the items of each update."""
    seen = observed_at("published_at", "retrieved_at")
    times = items.select("item_id", seen.alias("observed_at"))
    return (
        links.select("update_id", "item_id").join(times, "item_id")
        .groupBy("update_id")
        .agg(F.min("observed_at").alias("first_observed_at"), F.max("observed_at").alias("last_observed_at"))
    )


def scoring_signals(
    links: DataFrame, items: DataFrame, sources: DataFrame, count_article_hosts: bool = False
) -> DataFrame:
    """Newest supporting time and number of distinct feed hosts per update.

    An item without a feed gives no host unless ``count_article_hosts`` asks for its own link's.
    """
    seen = observed_at("published_at", "retrieved_at")
    own = url_host(F.col("url")) if count_article_hosts else F.lit(None).cast("string")
    facts = items.select("item_id", "source_id", seen.alias("_at"), own.alias("_own"))
    hosts = sources.select("source_id", url_host(F.col("feed_url")).alias("_host"))
    located = lookup(facts, hosts, ["source_id"], F.col("item_id"))
    host = F.coalesce("_host", F.when(F.col("source_id").isNull(), F.col("_own")))
    return (
        links.select("update_id", "item_id")
        .join(located.select("item_id", "_at", host.alias("_host")), "item_id")
        .groupBy("update_id")
        .agg(F.max("_at").alias("newest_at"), F.count_distinct("_host").alias("host_count"))
    )


def latest_impact(links: DataFrame, analyses: DataFrame, items: DataFrame, mode: str = "latest") -> DataFrame:
    """Impact that scores an update: that of the item processed last, or the strongest one."""
    ranks = F.when(F.col("impact_level") == "high", 3).when(F.col("impact_level") == "medium", 2).when(
        F.col("impact_level") == "low", 1
    ).otherwise(0)
    order = F.struct("received_at", "item_id") if mode == "latest" else F.struct(ranks.alias("r"), F.col("item_id"))
    rows = (
        links.select("update_id", "item_id")
        .join(analyses.select("item_id", "impact_level"), "item_id")
        .join(items.select("item_id", "received_at"), "item_id")
    )
    return rows.groupBy("update_id").agg(
        F.max(F.struct(order.alias("o"), F.col("impact_level").alias("level"))).alias("m")
    ).select("update_id", F.col("m.level").alias("impact_level"))


def commit_outcomes(receipts: DataFrame, items: DataFrame, links: DataFrame) -> DataFrame:
    """What happens to each receipt: item missing, already handled, or to be grouped."""
    known = items.select("item_id", "status")
    linked = links.select("item_id").distinct().withColumn("_linked", F.lit(True))
    spread = F.struct(*receipts.columns)
    rows = lookup(lookup(receipts, known, ["item_id"], spread), linked, ["item_id"], spread)
    return rows.select(
        *receipts.columns,
        F.when(F.col("status").isNull(), F.lit("SkippedItemMissing"))
        .when(
            F.col("status").isin(*K.TERMINAL_STATES) | F.coalesce("_linked", F.lit(False)),
            F.lit("SkippedAlreadyHandled"),
        )
        .otherwise(F.lit("Grouped"))
        .alias("outcome"),
    )
