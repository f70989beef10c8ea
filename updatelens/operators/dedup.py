"""First-wins removal of repeated items.

Items are taken in the order (retrieved_at, item_id) and compared with the items kept so far, never
with items that were themselves dropped. Tables need item_id, source_id, external_id, url_hash,
content_hash, normalized_title and retrieved_at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from updatelens.functions.text import is_blank
from updatelens.options import DedupOptions
from updatelens.session import materialize
from updatelens.skew import lookup

ITEM_RULES = ("external_id", "url", "content_hash")
ARTICLE_RULES = ("url", "content_hash")

_DAY_MICROS = 24 * 60 * 60 * 1_000_000


def rule_key(rule: str) -> Column:
    """Comparison key of one rule; null when the item has nothing to compare by it.

    Items without a source are of one source. A blank key is compared with nothing.
    """
    if rule == "external_id":
        source = F.coalesce(F.concat(F.lit("s"), F.col("source_id").cast("string")), F.lit(""))
        return F.when(~is_blank("external_id"), F.concat_ws("\x1f", source, "external_id"))
    column = {"url": "url_hash", "content_hash": "content_hash"}[rule]
    return F.when(~is_blank(column), F.col(column))


def _dedup_single(batch: DataFrame, stored: DataFrame | None, rule: str) -> DataFrame:
    """Keep the first item per key and every item without a key.

    The limit on the window is applied before the shuffle too, so one key sends at most one row
    per input partition however often it occurs. Keyless rows are spread by their own id.
    """
    keyed = batch.withColumn("_key", rule_key(rule)).withColumn(
        "_part", F.coalesce("_key", F.concat(F.lit("\x1e"), F.col("item_id").cast("string")))
    )
    first = W.partitionBy("_part").orderBy("retrieved_at", "item_id")
    kept = keyed.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    if stored is not None:
        seen = stored.select(rule_key(rule).alias("_part")).where("_part IS NOT NULL")
        kept = kept.join(seen, "_part", "left_anti")
    return kept.select(*batch.columns)


def dedup_external_id(batch: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """One item per source and external id; the comparison is case-sensitive."""
    return _dedup_single(batch, stored, "external_id")


def dedup_url(batch: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """One item per normalised link, whatever its source."""
    return _dedup_single(batch, stored, "url")


def dedup_content_hash(batch: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """One item per content hash, whatever its source."""
    return _dedup_single(batch, stored, "content_hash")


def _seq() -> Column:
    return F.struct("retrieved_at", "item_id")


def _edges(rows: DataFrame, rules: tuple[str, ...]) -> DataFrame:
    """One row per item and key: item_id, retrieved_at, rule number, key."""
    pairs = F.array(
        *[F.struct(F.lit(i).alias("rule"), rule_key(r).alias("key")) for i, r in enumerate(rules, 1)]
    )
    return (
        rows.select("item_id", "retrieved_at", F.inline(pairs)).where("key IS NOT NULL")
    )


def settle_keyed(batch: DataFrame, stored: DataFrame | None, rules: tuple[str, ...]) -> DataFrame:
    """Decide every item that has a key: (item_id, kept, reason, first_item_id).

    An item is kept when no earlier kept item shares a key with it. Each round looks, per key, at
    the first undecided item and at whether a kept item exists: an item sharing a key with a kept
    item is dropped, an item first on all of its keys is kept. Pairs are never formed, so a round is
    linear in the undecided items. Items whose keys occur once are settled before the first round.
    """
    edges = _edges(batch, rules)
    per_key = edges.groupBy("rule", "key").agg(
        F.count("*").alias("n"), F.min(_seq()).alias("first"), F.lit(False).alias("taken")
    )
    if stored is not None:
        # Only stored keys that the batch mentions travel further.
        seen = (
            _edges(stored, rules)
            .join(per_key.select("rule", "key"), ["rule", "key"], "left_semi")
            .groupBy("rule", "key")
            .agg(F.min("item_id").alias("stored_id"))
        )
        seen = materialize(seen)
        per_key = per_key.join(seen.select("rule", "key", F.lit(True).alias("_s")), ["rule", "key"], "left")
        per_key = per_key.withColumn("taken", F.coalesce("_s", F.lit(False))).drop("_s")
    decided: list[DataFrame] = []
    undecided = None
    while True:
        judged = materialize(_judge(edges, per_key))
        decided.append(judged.where("state <> 'open'").select("item_id", "retrieved_at", "keys", "state"))
        undecided = judged.where("state = 'open'")
        if undecided.isEmpty():
            break
        edges = undecided.select("item_id", "retrieved_at", F.inline("keys"))
        won = judged.where("state = 'kept'").select("item_id", "retrieved_at", F.inline("keys"))
        per_key = (
            edges.withColumn("taken", F.lit(False))
            .unionByName(won.withColumn("taken", F.lit(True)))
            .groupBy("rule", "key")
            .agg(
                F.count("*").alias("n"),
                F.min(F.when(~F.col("taken"), _seq())).alias("first"),
                F.max("taken").alias("taken"),
            )
        )
    settled = reduce(DataFrame.unionByName, decided)
    return _attribute(settled, seen if stored is not None else None)


def _judge(edges: DataFrame, per_key: DataFrame) -> DataFrame:
    looked = lookup(edges, per_key, ["rule", "key"], F.col("item_id"), leave_out="n")
    per_item = looked.groupBy("item_id", "retrieved_at").agg(
        F.collect_list(F.struct("rule", "key")).alias("keys"),
        F.max("taken").alias("hit"),
        F.max(F.col("first") < _seq()).alias("waits"),
    )
    state = F.when(F.col("hit"), F.lit("dropped")).when(F.col("waits"), F.lit("open")).otherwise(F.lit("kept"))
    return per_item.select("item_id", "retrieved_at", "keys", state.alias("state"))


def _attribute(settled: DataFrame, seen: DataFrame | None) -> DataFrame:
    """Name the first rule, in rule order, on which a dropped item met an earlier kept item."""
    won = settled.where("state = 'kept'").select("item_id", "retrieved_at", F.inline("keys"))
    # At most one kept item per key, so this is already one row per key.
    keeper = won.select(
        "rule", "key", _seq().alias("k"), F.lit(None).cast(won.schema["item_id"].dataType).alias("stored_id")
    )
    if seen is not None:
        older = seen.select("rule", "key", F.lit(None).cast(keeper.schema["k"].dataType).alias("k"), "stored_id")
        keeper = (
            keeper.unionByName(older)
            .groupBy("rule", "key")
            .agg(F.min("k").alias("k"), F.min("stored_id").alias("stored_id"))
        )
    lost = settled.where("state = 'dropped'").select("item_id", "retrieved_at", F.inline("keys"))
    met = lookup(lost, keeper, ["rule", "key"], F.col("item_id"))
    earlier = F.coalesce("stored_id", F.when(F.col("k") < _seq(), F.col("k.item_id")))
    reasons = (
        met.withColumn("_first", earlier)
        .where("_first IS NOT NULL")
        .groupBy("item_id")
        .agg(F.min(F.struct("rule", "_first")).alias("m"))
    )
    kept = settled.where("state = 'kept'").select(
        "item_id", F.lit(True).alias("kept"), F.lit(None).cast("int").alias("rule"),
        F.lit(None).cast(won.schema["item_id"].dataType).alias("first_item_id"),
    )
    dropped = reasons.select(
        "item_id", F.lit(False).alias("kept"), F.col("m.rule").alias("rule"), F.col("m._first").alias("first_item_id")
    )
    return kept.unionByName(dropped)


# --- title window -------------------------------------------------------------------------------


def _bucket(days: int) -> Column:
    """Number of the aligned period of ``days`` days. Two items of one bucket are always in reach."""
    return F.floor(F.unix_micros(F.col("retrieved_at").cast("timestamp")) / F.lit(days * _DAY_MICROS)).cast("bigint")


def _reach(days: int) -> Column:
    return F.make_dt_interval(days=F.lit(days))


def settle_titles(keyless: DataFrame, keepers: DataFrame, options: DedupOptions = DedupOptions()) -> DataFrame:
    """Kept items among those without any key: (item_id).

    ``keepers`` are items already kept, with column ``stored`` telling those of earlier batches. An
    item is dropped when a kept item of the same title was retrieved within the window before it.
    """
    days = options.title_window_days
    cols = ["normalized_title", "_b"]
    mine = keyless.select("item_id", "retrieved_at", "normalized_title", _bucket(days).alias("_b"))
    earliest = mine.agg(F.min("retrieved_at")).first()[0]
    if earliest is None:
        return keyless.select("item_id")
    # Older kept items are out of everyone's reach; a stored table need not be read so far back.
    keepers = keepers.where(F.col("retrieved_at") >= F.lit(earliest) - _reach(days))
    other = keepers.select("item_id", "retrieved_at", "normalized_title", "stored", _bucket(days).alias("_b"))
    titles = mine.groupBy(*cols).agg(F.count("*").alias("n"))
    # Kept items matter per title and bucket only by their first and last time.
    ends = other.groupBy(*cols).agg(
        F.min(F.when(F.col("stored"), F.col("retrieved_at"))).alias("stored_min"),
        F.min(F.when(~F.col("stored"), _seq())).alias("batch_min"),
        F.max("retrieved_at").alias("last"),
    )
    previous = ends.select("normalized_title", (F.col("_b") + 1).alias("_b"), F.col("last").alias("prev_last"))
    masks = titles.join(ends, cols, "left").join(previous, cols, "left")
    masks = masks.where("last IS NOT NULL OR prev_last IS NOT NULL")
    seen = lookup(mine, masks, cols, F.col("item_id"), leave_out="n")
    covered = (
        (F.col("stored_min") <= F.col("retrieved_at"))
        | (F.col("batch_min") < _seq())
        | (F.col("prev_last") >= F.col("retrieved_at") - _reach(days))
    )
    alive = seen.where(~F.coalesce(covered, F.lit(False)))
    # Of items with one title and one time only the first can be kept.
    alive = alive.groupBy("normalized_title", "_b", "retrieved_at").agg(F.min("item_id").alias("item_id"))
    alive = materialize(alive)
    return _walk(alive, _next_kept(alive, days))


_HOUR_MICROS = 60 * 60 * 1_000_000


def _hour(at: Column) -> Column:
    return F.floor(F.unix_micros(at.cast("timestamp")) / F.lit(_HOUR_MICROS)).cast("bigint")


def _next_kept(alive: DataFrame, days: int) -> DataFrame:
    """(item_id, next_id): if the item is kept, the next kept one of its title, null after the last.

    That is the first item out of the item's reach. It is looked for within its hour, where items and the
    ends of reaches are sorted together, and else in the next hour that has items; a title sends a
    row for each hour to the second search, however many items it has.
    """
    item = F.struct("retrieved_at", "item_id")
    own = alive.select("normalized_title", F.col("retrieved_at").alias("at"), item.alias("item"))
    ends = own.select("normalized_title", (F.col("at") + _reach(days)).alias("at"), F.col("item.item_id").alias("of"))
    rows = own.unionByName(ends, allowMissingColumns=True).withColumn("hour", _hour(F.col("at")))
    # From late to early, a reach before the items of its last moment, which it still covers.
    late = W.partitionBy("normalized_title", "hour").orderBy(F.col("at").desc(), F.col("of").isNull())
    found = rows.withColumn("next", F.last("item", True).over(late.rowsBetween(W.unboundedPreceding, -1)))
    found = materialize(found.where("of IS NOT NULL").select("normalized_title", "hour", "of", "next"))
    # The first item of each hour in which an item lies or a reach ends.
    firsts = rows.groupBy("normalized_title", "hour").agg(F.min("item").alias("item"))
    hours = W.partitionBy("normalized_title").orderBy(F.col("hour").desc()).rowsBetween(W.unboundedPreceding, -1)
    later = firsts.select("normalized_title", "hour", F.last("item", True).over(hours).alias("later"))
    joined = found.join(later, ["normalized_title", "hour"], "left")
    return joined.select(F.col("of").alias("item_id"), F.coalesce("next", "later")["item_id"].alias("next_id"))


def _walk(alive: DataFrame, following: DataFrame) -> DataFrame:
    """All items met from the first one of each title: (item_id).

    Jumps of 1, 8, 64, ... items are written until none is left to jump over; marks then
    spread from the longest jumps to the shortest. Jobs grow with the logarithm of a title's kept items.
    """
    jumps = [materialize(following.where("next_id IS NOT NULL"))]
    while not jumps[-1].isEmpty():
        one = jumps[-1]
        far = one
        for _ in range(3):  # eight of the last jumps
            step = far.select(F.col("item_id").alias("next_id"), F.col("next_id").alias("then"))
            far = far.join(step, "next_id").select("item_id", F.col("then").alias("next_id"))
        jumps.append(materialize(far))
    first = alive.groupBy("normalized_title").agg(F.min(_seq()).alias("k"))
    marked = materialize(first.select(F.col("k.item_id").alias("item_id")))
    for jump in reversed(jumps):
        reached, front = [marked], marked
        for _ in range(7):
            front = front.join(jump, "item_id").select(F.col("next_id").alias("item_id"))
            reached.append(front)
        marked = materialize(reduce(DataFrame.union, reached))
    return marked


def has_no_key(rules: tuple[str, ...]) -> Column:
    """Whether the title rule applies: all keys are null. A blank key, though never compared, turns it off."""
    columns = {"external_id": "external_id", "url": "url_hash", "content_hash": "content_hash"}
    return reduce(lambda a, b: a & b, [F.col(columns[r]).isNull() for r in rules])


def is_new(rules: tuple[str, ...]) -> Column:
    """Items that no rule compares, which are always kept: they have a key, but blank ones only."""
    return ~has_no_key(rules) & reduce(lambda a, b: a & b, [rule_key(r).isNull() for r in rules])


def dedup_title_window(
    batch: DataFrame, stored: DataFrame | None = None, options: DedupOptions = DedupOptions()
) -> DataFrame:
    """The title rule alone: items without any key whose title was kept within the window are dropped."""
    slim = _keys_only(batch)
    no_key = has_no_key(ITEM_RULES)
    kept = settle_titles(slim.where(no_key), _keepers(slim.where(~no_key), stored), options)
    keyless, keyed = batch.where(no_key), batch.where(~no_key)
    return keyed.unionByName(keyless.join(kept, "item_id", "left_semi"))


def _keepers(batch_kept: DataFrame, stored: DataFrame | None) -> DataFrame:
    cols = ["item_id", "retrieved_at", "normalized_title"]
    rows = batch_kept.select(*cols, F.lit(False).alias("stored"))
    if stored is not None:
        rows = rows.unionByName(stored.select(*cols, F.lit(True).alias("stored")))
    return rows


# --- all rules ----------------------------------------------------------------------------------


_KEY_COLUMNS = [
    "item_id", "source_id", "external_id", "url_hash", "content_hash", "normalized_title", "retrieved_at",
]


def _keys_only(batch: DataFrame) -> DataFrame:
    """The comparison columns, written once: the rounds never touch the texts again."""
    return materialize(batch.select(*_KEY_COLUMNS))


def _dedup(
    batch: DataFrame, stored: DataFrame | None, rules: tuple[str, ...], options: DedupOptions
) -> DataFrame:
    keyed_out = settle_keyed(batch, stored, rules)
    names = F.element_at(F.array(*[F.lit(r) for r in rules]), F.col("rule"))
    keyed_out = keyed_out.select("item_id", "kept", F.when(~F.col("kept"), names).alias("reason"), "first_item_id")
    new = batch.where(is_new(rules)).select(
        "item_id", F.lit(True).alias("kept"), F.lit(None).cast("string").alias("reason"),
        F.lit(None).cast(batch.schema["item_id"].dataType).alias("first_item_id"),
    )
    keyed_out = materialize(keyed_out.unionByName(new))
    keyless = batch.where(has_no_key(rules))
    winners = batch.join(keyed_out.where("kept"), "item_id", "left_semi")
    kept_titles = settle_titles(keyless, _keepers(winners, stored), options)
    title_out = keyless.select("item_id").join(
        kept_titles.withColumn("_k", F.lit(True)), "item_id", "left"
    )
    id_type = batch.schema["item_id"].dataType
    title_out = title_out.select(
        "item_id",
        F.coalesce("_k", F.lit(False)).alias("kept"),
        F.when(F.col("_k").isNull(), F.lit("title")).alias("reason"),
        F.lit(None).cast(id_type).alias("first_item_id"),
    )
    return keyed_out.unionByName(title_out)


def dedup_items(
    batch: DataFrame, stored: DataFrame | None = None, options: DedupOptions = DedupOptions()
) -> tuple[DataFrame, DataFrame]:
    """All rules in order: external id, link, content hash, title window.

    Returns (kept, duplicates); duplicates carry ``reason`` and, for key rules, ``first_item_id``.
    """
    outcome = materialize(_dedup(_keys_only(batch), stored, ITEM_RULES, options))
    kept = batch.join(outcome.where("kept"), "item_id", "left_semi")
    return kept, outcome.where("NOT kept").select("item_id", "reason", "first_item_id")


def dedup_articles(
    batch: DataFrame, stored: DataFrame | None = None, options: DedupOptions = DedupOptions()
) -> DataFrame:
    """Rules of single articles: link, content hash, title. Returns (item_id, is_duplicate,
    existing_item_id, reason); the existing id of a title repeat is the nearest one before it."""
    batch = _keys_only(batch)
    outcome = materialize(_dedup(batch, stored, ARTICLE_RULES, options))
    titled = batch.join(outcome.where("reason = 'title'"), "item_id", "left_semi")
    kept = batch.join(outcome.where("kept"), "item_id", "left_semi")
    found = _nearest_title(titled, _keepers(kept, stored), options)
    return outcome.join(found, "item_id", "left").select(
        "item_id",
        (~F.col("kept")).alias("is_duplicate"),
        F.coalesce("first_item_id", "title_item_id").alias("existing_item_id"),
        "reason",
    )


def _nearest_title(rows: DataFrame, keepers: DataFrame, options: DedupOptions) -> DataFrame:
    """A kept item of the same title within the window before each row.

    Any such item will do, so per title and bucket the first and the last kept item are enough: the
    first one of the row's own bucket when it precedes the row, else the last of the bucket before.
    """
    days = options.title_window_days
    cols = ["normalized_title", "_b"]
    mine = rows.select("item_id", "retrieved_at", "normalized_title", _bucket(days).alias("_b"))
    other = keepers.withColumn("_b", _bucket(days))
    order = F.struct("retrieved_at", (~F.col("stored")).alias("in_batch"), "item_id")
    ends = other.groupBy(*cols).agg(F.min(order).alias("first"), F.max(order).alias("last"))
    previous = ends.select("normalized_title", (F.col("_b") + 1).alias("_b"), F.col("last").alias("prev"))
    needed = mine.groupBy(*cols).agg(F.count("*").alias("n"))
    table = needed.join(ends.drop("last"), cols, "left").join(previous, cols, "left")
    seen = lookup(mine, table, cols, F.col("item_id"), leave_out="n")
    me = F.struct("retrieved_at", F.lit(True).alias("in_batch"), "item_id")
    return seen.select(
        "item_id",
        F.coalesce(
            F.when(F.col("first") < me, F.col("first.item_id")),
            F.when(F.col("prev.retrieved_at") >= F.col("retrieved_at") - _reach(days), F.col("prev.item_id")),
        ).alias("title_item_id"),
    )
