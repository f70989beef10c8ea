"""Deterministic text analysis. A text's tokens live in its own row, so counting, ranking and
matching against a word list need no shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from updatelens import constants as K
from updatelens.functions import text as T
from updatelens.session import materialize
from updatelens.sources.sinks import read_table

MATCH_SCHEMA = "array<struct<interest_id:string,strength:double>>"


def _run_starts(s: Column) -> Column:
    n = F.size(s)
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
    return F.when(n > 0, starts).otherwise(F.array().cast("array<int>"))


def token_counts(tokens: Column) -> Column:
    """Array of (token, tf) of a token array.

    Sorting brings equal tokens together; the start of each run gives the token, and the distance to
    the next start its count.
    """

    def runs(s: Column, starts: Column) -> Column:
        return F.transform(
            starts,
            lambda p, j: F.struct(
                F.get(s, p).alias("token"),
                (F.coalesce(F.get(starts, j + 1), F.size(s)) - p).cast("bigint").alias("tf"),
            ),
        )

    return T.let(F.sort_array(tokens), lambda s: T.let(_run_starts(s), lambda starts: runs(s, starts)))


def with_counts(df: DataFrame, tokens: str, out: str) -> DataFrame:
    return df.withColumn(out, token_counts(F.col(tokens)))


def with_tokens(df: DataFrame, text: str | Column, out: str = "tokens") -> DataFrame:
    return df.withColumn(out, T.tokenize(text))


def term_frequencies(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """One row per text and distinct token."""
    counted = with_counts(with_tokens(df.select(id_col, text), text), "tokens", "counts")
    return _long(counted, id_col, F.col("counts"))


def _long(df: DataFrame, id_col: str, counts: Column) -> DataFrame:
    """One row per counted token. The outer form keeps the planner from adding a size filter that
    would repeat the whole text analysis below it; the empty rows go afterwards."""
    return df.select(id_col, F.inline_outer(counts)).where("token IS NOT NULL")


def _content_words(counts: Column, min_length: int) -> Column:
    return F.filter(
        counts,
        lambda x: (F.char_length(x["token"]) >= min_length) & ~x["token"].isin(K.STOP_WORDS),
    )


def _ranked(counts: Column, k: int) -> Column:
    """The ``k`` most frequent tokens, equal counts in token order."""
    keyed = F.transform(counts, lambda x: F.struct((-x["tf"]).alias("r"), x["token"].alias("token")))
    return F.transform(F.slice(F.sort_array(keyed), 1, k), lambda x: x["token"])


def keyword_counts(df: DataFrame, id_col: str, text: str, min_length: int = 3) -> DataFrame:
    """Token counts without stop words and short tokens."""
    counted = with_counts(with_tokens(df.select(id_col, text), text), "tokens", "counts")
    return _long(counted, id_col, _content_words(F.col("counts"), min_length))


def keywords(df: DataFrame, id_col: str, text: str, k: int = 10, min_length: int = 3) -> DataFrame:
    """Top ``k`` content words of each text as an array, most frequent first."""
    counted = with_counts(with_tokens(df.select(id_col, text), text), "tokens", "counts")
    return counted.select(id_col, _ranked(_content_words(F.col("counts"), min_length), k).alias("keywords"))


def topics(df: DataFrame, id_col: str, text: str, k: int = 3) -> DataFrame:
    return keywords(df, id_col, text, k).withColumnRenamed("keywords", "topics")


def event_descriptors(df: DataFrame, id_col: str, title: str, content: str | Column, k: int = 5) -> DataFrame:
    """First ``k`` distinct neighbouring token pairs, those of the title before those of the content."""
    tokens = df.select(id_col, T.tokenize(title).alias("_t"), T.tokenize(content).alias("_c"))
    return tokens.select(id_col, _descriptors("_t", "_c", k).alias("descriptors"))


def _descriptors(title_tokens: str, content_tokens: str, k: int) -> Column:
    pairs = F.concat(T.adjacent_pairs(title_tokens), T.adjacent_pairs(content_tokens))
    return F.slice(F.array_distinct(pairs), 1, k)


def interest_match(items: DataFrame, id_col: str, tokens: str, interests: DataFrame) -> DataFrame:
    """Share of each interest name's distinct tokens that occur in the item.

    ``tokens`` is a token array column. Pairs without a common token have strength 0 and give no
    row. Both sides meet on the token; the planner broadcasts the interest words while they are
    small and splits frequent words of a shuffled join otherwise.
    """
    words = (
        interests.select("interest_id", F.array_distinct(T.tokenize("name")).alias("_w"))
        .select("interest_id", F.size("_w").alias("_size"), F.explode("_w").alias("token"))
    )
    found = items.select(id_col, F.explode_outer(F.array_distinct(tokens)).alias("token"))
    return (
        found.join(words, "token")
        .groupBy(id_col, "interest_id")
        .agg((F.count("*") / F.max("_size")).alias("strength"))
    )


def active_matches(matches: DataFrame, interests: DataFrame) -> DataFrame:
    """Positive matches of interests that are active."""
    active = interests.where("is_active").select("interest_id", "priority")
    return matches.where("strength > 0").join(active, "interest_id")


def impact_level(hits: Column) -> Column:
    return (
        F.when(hits >= 3, F.lit("high"))
        .when(hits == 2, F.lit("medium"))
        .when(hits == 1, F.lit("low"))
        .otherwise(F.lit("none"))
    )


def impact(df: DataFrame, id_col: str, tokens: str, lexicon: list[str] | None = None) -> DataFrame:
    """Impact level and confidence from the number of distinct signal words."""
    hits = _impact_hits(tokens, lexicon)
    return df.select(
        id_col,
        impact_level(hits).alias("impact_level"),
        F.least(F.lit(1.0), hits / F.lit(3.0)).alias("impact_confidence"),
    )


def _impact_hits(tokens: str, lexicon: list[str] | None) -> Column:
    words = F.array(*[F.lit(w) for w in (K.IMPACT_WORDS if lexicon is None else lexicon)])
    return F.size(F.array_intersect(F.col(tokens), words))


def primary_topic(topic_array: Column) -> Column:
    """First topic that is not blank, trimmed; else the default topic."""
    present = F.filter(topic_array, lambda t: T.trim_ws(t) != "")
    return F.coalesce(T.trim_ws(F.get(present, F.lit(0))), F.lit(K.DEFAULT_TOPIC))


def analyze_items(items: DataFrame, lexicon: list[str] | None = None, budget: int | None = None) -> DataFrame:
    """All per-item features that need no other table; one row per item, no shuffle.

    ``items`` has item_id, title, excerpt and optionally content and language. ``budget`` cuts the
    analysed text as a bounded provider would; by default the whole text counts.
    """
    content = [F.col("content")] if "content" in items.columns else []
    language = F.col("language") if "language" in items.columns else F.lit(None).cast("string")
    body = T.bound_content("title", "excerpt", *content, budget=budget)
    base = items.select(
        "item_id",
        language.alias("language"),
        T.tokenize(F.col("title")).alias("_title_tokens"),
        T.tokenize(body).alias("tokens"),
    )
    hits = _impact_hits("tokens", lexicon)
    ranked = with_counts(base, "tokens", "_counts").withColumn(
        "keywords", _ranked(_content_words(F.col("_counts"), 3), 10)
    )
    return ranked.select(
        "item_id",
        "language",
        "tokens",
        "keywords",
        F.slice("keywords", 1, 3).alias("topics"),
        _descriptors("_title_tokens", "tokens", 5).alias("descriptors"),
        impact_level(hits).alias("impact_level"),
        F.least(F.lit(1.0), hits / F.lit(3.0)).alias("impact_confidence"),
        primary_topic(F.slice("keywords", 1, 3)).alias("primary_topic"),
        F.lit(K.ANALYZER_VERSION).alias("analyzer_version"),
    )


Provider = Callable[[DataFrame, DataFrame], DataFrame]


def deterministic_provider(items: DataFrame, interests: DataFrame, lexicon: list[str] | None = None) -> DataFrame:
    """The built-in analysis: one row per item with its matches as an array."""
    # Written once: the text work would otherwise run for the matches and for the rest.
    base = materialize(analyze_items(items, lexicon))
    matched = (
        interest_match(base, "item_id", "tokens", interests)
        .groupBy("item_id")
        .agg(F.sort_array(F.collect_list(F.struct("interest_id", "strength"))).alias("interest_matches"))
    )
    none = F.array().cast(MATCH_SCHEMA)
    return (
        base.drop("tokens")
        .join(matched, "item_id", "left")
        .withColumn("interest_matches", F.coalesce("interest_matches", none))
    )


# What a provider must return; the id has the type of the items.
ANALYSIS_TYPES = {
    "language": "string", "keywords": "array<string>", "topics": "array<string>", "descriptors": "array<string>",
    "impact_level": "string", "impact_confidence": "double", "primary_topic": "string", "interest_matches": MATCH_SCHEMA,
    "analyzer_version": "string",
}


def checked_analyses(result: DataFrame, items: DataFrame, interests: DataFrame) -> DataFrame:
    """What may be stored of a provider's rows: one for each given item, with matches of given interests only.

    Of several rows for an item the first in the order of their values stays, of several matches of an interest the first;
    strengths outside 0 to 1 and rows of other items go. Missing columns and other types are errors.
    """
    wanted = {"item_id": items.schema["item_id"].dataType.simpleString(), **ANALYSIS_TYPES}
    given = dict(result.dtypes)
    wrong = sorted(f"{c} {t}" for c, t in wanted.items() if given.get(c) != t)
    if wrong:
        raise ValueError(f"provider result lacks {wrong}")
    rows = result.select(*wanted)
    order = W.partitionBy("item_id").orderBy(F.xxhash64(*ANALYSIS_TYPES), F.to_json(F.struct(*ANALYSIS_TYPES)))
    one = rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    one = one.join(items.select("item_id").distinct(), "item_id", "left_semi")
    # One row with the given ids; a match list is as short as the list of interests.
    known = interests.agg(F.collect_set("interest_id").alias("_known"))

    def fits(m: Column, i: Column) -> Column:
        first = F.array_position(F.transform("interest_matches", lambda x: x["interest_id"]), m["interest_id"]) == i + 1
        return F.array_contains("_known", m["interest_id"]) & first & m["strength"].between(0, 1)

    kept = F.filter(F.coalesce("interest_matches", F.array().cast(MATCH_SCHEMA)), fits)
    return one.crossJoin(F.broadcast(known)).withColumn("interest_matches", kept).select(*wanted)


def analyze(
    items: DataFrame, interests: DataFrame, provider: Provider = deterministic_provider, check: bool | None = None
) -> DataFrame:
    """Analyse items with any provider: a function of items and active interests.

    What a provider returns is checked (``checked_analyses``), unless ``check`` says that it keeps the rules by itself,
    as the built-in one does.
    """
    active = interests.where("is_active")
    result = provider(items, active)
    check = provider is not deterministic_provider if check is None else check
    return checked_analyses(result, items, active) if check else result.select("item_id", *ANALYSIS_TYPES)


def analyze_incremental(
    path: str,
    items: DataFrame,
    interests: DataFrame,
    provider: Provider = deterministic_provider,
    version: str = K.ANALYZER_VERSION,
    check: bool | None = None,
) -> DataFrame:
    """Analyses of the items under ``version``; a text is analysed only once per version.

    Results are kept at ``path``, a partition per version, and stay as they were when interests change: another version
    analyses again. Items without an id are left out; of rows with one id one is analysed. A run that stopped is repeated.
    """
    spark = items.sparkSession
    id_type = items.schema["item_id"].dataType.simpleString()
    schema = ", ".join(f"{c} {t}" for c, t in {"item_id": id_type, **ANALYSIS_TYPES}.items())
    wanted = items.select("item_id").where("item_id IS NOT NULL").distinct()
    stored = read_table(spark, path, schema)
    missing = wanted
    if stored is not None:
        kept = stored.where(F.col("analyzer_version") == version)
        missing = wanted.join(kept.select("item_id"), "item_id", "left_anti")
    # Only ids are written: what was missing must not change while results are stored.
    missing = materialize(missing)
    if stored is None or not missing.isEmpty():
        rows = items.join(missing, "item_id", "left_semi")
        found = analyze(rows, interests, provider, check).withColumn("analyzer_version", F.lit(version))
        one = found.withColumn("_n", F.row_number().over(W.partitionBy("item_id").orderBy(F.xxhash64(*ANALYSIS_TYPES))))
        one.where("_n = 1").drop("_n").write.mode("append").partitionBy("analyzer_version").parquet(path)
    results = spark.read.schema(schema).parquet(path).where(F.col("analyzer_version") == version)
    return results.join(wanted, "item_id", "left_semi").select("item_id", *ANALYSIS_TYPES)
