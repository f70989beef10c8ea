"""One query per operator over the test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from updatelens.functions import links as L
from updatelens.functions import text as T
from updatelens.functions import values as V
from updatelens.operators import briefs as B
from updatelens.operators import candidates as C
from updatelens.operators import dedup as D
from updatelens.operators import features as X
from updatelens.operators import grouping as G
from updatelens.operators import interactions as J
from updatelens.operators import quality as Q
from updatelens.operators import reporting as R
from updatelens.operators import scoring as S
from updatelens.operators import state as H
from updatelens.options import BriefOptions, GroupingOptions
from updatelens.plans import articles as article_plan
from updatelens.plans import brief as brief_plan
from updatelens.plans import messages as message_plan
from updatelens.plans import relevance
from updatelens.session import bucketed, materialize, scratch_dir
from updatelens.sources import articles, feeds, messages, sinks
from updatelens.streaming import jobs as streams
from updatelens.workload import adapters as A

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _md5(c):
    return F.md5(c.cast("binary"))


def _text(values, sep: str = " "):
    return F.array_join(values, sep)


def _docs(spark, sf):
    return A.documents(spark, sf)


# --- raw records ----------------------------------------------------------------------------------


@query
def parse_feeds(spark, sf):
    found, rejects = feeds.parse_feeds(A.feeds(spark, sf))
    columns = ["source_id", "position", "external_id", "url", "title", "excerpt_digest", "published_at", "content_hash"]
    good = found.withColumn("excerpt_digest", _md5(F.col("excerpt"))).select(*columns, F.lit(None).cast("string").alias("error_code"))
    bad = rejects.select("source_id", "error_code")
    return good.unionByName(bad, allowMissingColumns=True)


@query
def classify_feeds(spark, sf):
    return feeds.classify_feeds(A.feeds(spark, sf))


@query
def extract_articles(spark, sf):
    found, rejects = articles.extract_articles(A.table(spark, sf, "pages"))
    return found.select("page_id", "title", "text").unionByName(
        rejects.select("page_id"), allowMissingColumns=True
    )


@query
def article_items(spark, sf):
    found, _ = articles.extract_articles(A.table(spark, sf, "pages"))
    return articles.article_items(found)


@query
def unchanged_filter(spark, sf):
    payloads = _docs(spark, sf).selectExpr("doc_id AS source_id", "source AS feed_url", "text AS payload")
    stored = _docs(spark, sf).selectExpr(
        "doc_id AS source_id", "CASE WHEN doc_id % 3 = 0 THEN sha2(text, 256) WHEN doc_id % 3 = 1 THEN 'old' END AS validator"
    )
    work, same = feeds.unchanged_filter(payloads, stored)
    return work.select("source_id", "validator", F.lit(False).alias("not_modified")).unionByName(
        same.select("source_id", "validator", F.lit(True).alias("not_modified"))
    )


@query
def read_messages(spark, sf):
    typed, bad = messages.read_messages(A.message_lines(spark, sf))
    return typed.drop("trace_parent").withColumn("reason", F.lit(None).cast("string")).unionByName(
        bad.select("row_id", "reason"), allowMissingColumns=True
    )


@query
def append_if_absent(spark, sf):
    lines = A.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    stored = lines.where("l_returnflag = 'A'")
    order = ["l_partkey", "l_suppkey", "l_returnflag"]
    return sinks.absent_rows(stored, lines, ["l_orderkey", "l_linenumber"], order)


@query
def write_snapshot(spark, sf):
    """An attempt that stops before its headers, then two writes, the second without effect; all stored rows."""
    path = f"{scratch_dir(spark)}/snapshot-{uuid.uuid4().hex}"
    # Every attempt joins the same items and sources by brief, so they are stored in buckets by it and not shuffled again.
    tables = A.briefs(spark, sf), *[bucketed(t, "brief_id") for t in (A.brief_items(spark, sf), A.brief_item_sources(spark, sf))]
    lost = sinks.open_attempt(path, tables[0].where("brief_id % 3 = 0"))
    sinks.store_parts(path, lost, *tables[1:])
    sinks.write_snapshot(path, tables[0].where("brief_id % 2 = 0"), *tables[1:])
    for _ in range(2):
        sinks.write_snapshot(path, *tables)
    stored = [sinks.read_snapshot(spark, path, n).withColumn("kind", F.lit(n)) for n in ("briefs", "brief_items", "brief_item_sources")]
    return stored[0].unionByName(stored[1], allowMissingColumns=True).unionByName(stored[2], allowMissingColumns=True)


# --- text, links, times ---------------------------------------------------------------------------


@query
def collapse_ws(spark, sf):
    return _docs(spark, sf).select("doc_id", _md5(T.collapse_ws("text")).alias("digest"))


@query
def clean_title(spark, sf):
    return A.raw_items(spark, sf).select(
        "item_id", T.clean_title("title").alias("title"), T.normalize_title("title").alias("normalized_title"),
        T.title_error("title").alias("error"),
    )


@query
def clean_optional(spark, sf):
    return _docs(spark, sf).select(
        "doc_id", _md5(T.clean_optional(F.concat(F.lit(" \t"), "text", F.lit("\n ")))).alias("digest"),
        T.too_long("text", 4000).alias("too_long"),
    )


@query
def bounded_text(spark, sf):
    return A.table(spark, sf, "pages").select(
        "page_id", T.bounded_text("html", 4000).alias("text"),
        _md5(T.collapse_ws(T.strip_markup("html"))).alias("digest"),
    )


@query
def canonical_url(spark, sf):
    return A.table(spark, sf, "pages").select(
        "page_id",
        L.canonical_url(F.concat(F.lit(" "), F.replace("url", F.lit("example"), F.lit("EXAMPLE")))).alias("url"),
        L.canonical_url(F.regexp_replace("url", r"^(https?)://([^/]+)/", "$1://$2:443/")).alias("with_port"),
        L.canonical_feed_url(F.regexp_replace("url", "://", "://user@")).alias("with_user"),
        L.canonical_feed_url(F.col("url")).alias("feed_url"),
        L.canonical_url(F.concat(F.lit("ftp:"), "url")).alias("other_scheme"),
    )


@query
def resolve_url(spark, sf):
    return A.table(spark, sf, "pages").select(
        "page_id",
        L.resolve_url(F.col("url"), F.concat(F.lit("/a/"), F.col("page_id").cast("string"))).alias("rooted"),
        L.resolve_url(F.col("url"), F.lit("mailto:x@example.test")).alias("mail"),
        L.resolve_url(F.col("url"), F.col("url")).alias("same"),
    )


@query
def url_host(spark, sf):
    return A.table(spark, sf, "pages").select("page_id", L.url_host(F.upper("url")).alias("host"))


@query
def is_public_host(spark, sf):
    """Every event id as an address literal, so that all blocks are met."""
    host = F.expr(
        "concat_ws('.', CAST(event_id * 7 % 256 AS STRING), CAST(event_id % 256 AS STRING), "
        "CAST(event_id % 3 AS STRING), CAST(event_id % 251 AS STRING))"
    )
    return A.table(spark, sf, "events").select("event_id", host.alias("host")).select(
        "event_id", "host", L.is_public_host(F.col("host")).alias("is_public")
    )


@query
def parse_utc(spark, sf):
    shapes = (
        "CASE o_orderkey % 5 WHEN 0 THEN date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") "
        "WHEN 1 THEN date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss'+02:00'\") "
        "WHEN 2 THEN concat('Mon, ', date_format(o_orderdate, \"dd MMM yyyy HH:mm:ss '-0300'\")) "
        "WHEN 3 THEN date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss') ELSE concat('on ', o_orderdate) END"
    )
    return A.table(spark, sf, "orders").select("o_orderkey", V.parse_utc(F.expr(shapes)).alias("parsed_at"))


@query
def observed_at(spark, sf):
    return A.raw_items(spark, sf).select("item_id", V.observed_at("published_at", "retrieved_at").alias("observed_at"))


@query
def content_hash(spark, sf):
    return A.raw_items(spark, sf).select("item_id", V.content_hash(F.col("title"), F.col("excerpt")).alias("content_hash"))


@query
def url_hash(spark, sf):
    return A.table(spark, sf, "pages").select("page_id", L.url_hash(L.canonical_url(F.col("url"))).alias("url_hash"))


@query
def normalize_text(spark, sf):
    return _docs(spark, sf).select("doc_id", _md5(T.normalize_text("text")).alias("digest"))


@query
def tokenize(spark, sf):
    tokens = X.with_tokens(_docs(spark, sf), "text")
    return tokens.select("doc_id", F.size("tokens").alias("n"), _md5(_text("tokens")).alias("digest"))


@query
def bigrams(spark, sf):
    tokens = X.with_tokens(_docs(spark, sf), "text").withColumn("pairs", T.adjacent_pairs("tokens"))
    return tokens.select("doc_id", F.size("pairs").alias("n"), _md5(_text("pairs", "|")).alias("digest"))


@query
def bound_content(spark, sf):
    return A.raw_items(spark, sf).select(
        "item_id", _md5(T.bound_content("title", "excerpt")).alias("digest"),
        F.char_length(T.bound_content("title", "excerpt")).alias("n"),
    )


@query
def parse_feedback(spark, sf):
    raw = F.expr("CASE event_type WHEN 'purchase' THEN ' Relevant ' WHEN 'error' THEN 'NOTRELEVANT' ELSE event_type END")
    return A.table(spark, sf, "events").select("event_id", V.parse_feedback(raw).alias("feedback_type"))


@query
def normalize_name(spark, sf):
    name = F.expr("CASE WHEN c_custkey % 9 = 0 THEN ' ' WHEN c_custkey % 10 = 0 THEN repeat(c_name, 20) ELSE concat(' ', c_name, ' ß ') END")
    return A.table(spark, sf, "customer").select(
        "c_custkey", T.normalize_name(name).alias("name"), T.name_error(name).alias("error")
    )


@query
def priority_lookups(spark, sf):
    priority = F.expr("CASE left(o_orderpriority, 1) WHEN '1' THEN 'High' WHEN '2' THEN 'High' WHEN '3' THEN 'Medium' ELSE 'Low' END")
    level = F.expr("CASE o_orderstatus WHEN 'F' THEN 'high' WHEN 'O' THEN 'medium' ELSE 'low' END")
    return A.table(spark, sf, "orders").select(
        "o_orderkey", V.priority_rank(priority).alias("rank"), V.priority_weight(priority).alias("weight"),
        V.impact_points(level).alias("impact_points"),
    )


# --- rules ----------------------------------------------------------------------------------------


@query
def validate_items(spark, sf):
    raw = A.raw_items(spark, sf).selectExpr(
        "item_id", "CASE WHEN item_id % 23 > 0 THEN source_id END AS source_id", "external_id",
        "CASE WHEN item_id % 11 = 0 THEN 'not a link' ELSE url END AS url", "title", "excerpt",
        "CAST(NULL AS STRING) AS content_hash", "CASE WHEN item_id % 17 > 0 THEN retrieved_at END AS retrieved_at",
    )
    good, bad = Q.validate_items(raw)
    return good.select("item_id", F.lit("").alias("errors")).unionByName(
        bad.select("item_id", _text("errors", ",").alias("errors"))
    )


@query
def clean_items(spark, sf):
    good, _ = Q.validate_items(A.raw_items(spark, sf).withColumn("content_hash", F.lit(None).cast("string")))
    return Q.clean_items(good).select(
        "item_id", "external_id", "original_url", "canonical_url", "url_hash", "title", "normalized_title", "status"
    )


@query
def validate_messages(spark, sf):
    orders = A.table(spark, sf, "orders")
    sent = orders.selectExpr(
        "o_orderkey AS message_id", "o_orderkey - o_orderkey % 2 AS item_id", "CAST(o_custkey AS STRING) AS source_id",
        "o_orderkey % 100 AS run_id", "o_custkey AS correlation_id", "o_orderdate AS occurred_at",
    )
    known = orders.where("o_orderpriority <> '5-LOW'").selectExpr(
        "o_orderkey AS item_id", "CAST(CASE WHEN o_orderkey % 14 = 0 THEN 0 ELSE o_custkey END AS STRING) AS source_id",
        "CASE WHEN o_orderpriority LIKE '1%' THEN 'Processed' WHEN o_orderkey % 10 = 4 THEN 'Discovered' "
        "WHEN o_orderkey % 10 = 6 THEN 'FailedRetryable' ELSE 'Queued' END AS status",
    )
    box = orders.selectExpr(
        "o_orderkey AS message_id", "o_orderkey - o_orderkey % 2 AS item_id", "CAST(o_custkey AS STRING) AS source_id",
        "o_orderkey % 100 AS run_id", "o_custkey AS correlation_id", "o_orderdate AS created_at",
        "CASE o_orderstatus WHEN 'P' THEN 'Quarantined' ELSE 'Dispatched' END AS status",
    )
    received = orders.where("o_totalprice > 400000").selectExpr("o_orderkey AS item_id")
    return Q.validate_messages(sent, known, box, received).select("message_id", "item_id", "disposition")


@query
def check_outbox(spark, sf):
    typed, _ = messages.read_messages(A.message_lines(spark, sf))
    box = A.table(spark, sf, "orders").selectExpr(
        "o_orderkey AS message_id_key", "concat('m', o_orderkey) AS message_id", "concat('i', o_orderkey) AS item_id",
        "CASE WHEN o_orderkey % 3 > 0 THEN concat('s', o_custkey) END AS source_id", "CAST(NULL AS STRING) AS run_id",
        "CASE o_orderstatus WHEN 'P' THEN 'other' ELSE concat('c', o_custkey) END AS correlation_id",
        "CASE WHEN o_orderpriority = '5-LOW' THEN 'elsewhere' ELSE 'content-processing' END AS destination",
    )
    envelopes = typed.withColumn("row_id", F.concat(F.lit("m"), "row_id"))
    return Q.check_outbox(box, envelopes).select("message_id", "diagnostic")


@query
def duplicate_ids(spark, sf):
    return Q.duplicate_ids(A.table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber")


@query
def validate_runs(spark, sf):
    return Q.validate_runs(A.runs(spark, sf)).select(
        "run_id", _text("errors", ",").alias("errors"), "bounded_retrieved", "bounded_new", "bounded_completed_at"
    )


@query
def validate_briefs(spark, sf):
    lines = A.table(spark, sf, "lineitem")
    made = lines.selectExpr(
        "l_orderkey AS brief_id", "l_partkey AS update_id", "l_linenumber - 1 AS rank",
        "CASE WHEN l_tax > 0.07 THEN double('NaN') ELSE l_quantity END AS score",
    )
    backed = lines.where("l_returnflag <> 'R'").selectExpr("l_orderkey AS brief_id", "l_partkey AS update_id")
    return Q.validate_briefs(made, backed).groupBy("brief_id", "error").agg(F.count("*").alias("n"))


@query
def filtered_unique_violations(spark, sf):
    return Q.filtered_unique_violations(
        A.raw_items(spark, sf), ["source_id", "external_id"], F.col("external_id").isNotNull()
    )


@query
def validate_matches(spark, sf):
    made = A.table(spark, sf, "events").selectExpr(
        "user_id AS item_id", "event_type AS interest_id", "value / 50 AS strength", "event_id AS position"
    )
    offered = spark.sql("SELECT * FROM VALUES ('click'), ('view'), ('purchase') AS t(interest_id)")
    return Q.validate_matches(made, offered).select("item_id", "interest_id", "strength", "position")


# --- repeats --------------------------------------------------------------------------------------


@query
def dedup_external_id(spark, sf):
    return D.dedup_external_id(A.items(spark, sf)).select("item_id")


@query
def dedup_url(spark, sf):
    return D.dedup_url(A.items(spark, sf)).select("item_id")


@query
def dedup_content_hash(spark, sf):
    return D.dedup_content_hash(A.items(spark, sf)).select("item_id")


@query
def dedup_title_window(spark, sf):
    return D.dedup_title_window(A.title_items(spark, sf)).select("item_id")


@query
def dedup_items(spark, sf):
    kept, repeats = D.dedup_items(A.items(spark, sf))
    return kept.select("item_id").unionByName(repeats, allowMissingColumns=True)


@query
def dedup_items_stored(spark, sf):
    """The texts of the larger sources are stored already; the others arrive."""
    every = A.items(spark, sf)
    stored = D.dedup_items(every.where("source_id >= 'src3'"))[0]
    kept, repeats = D.dedup_items(every.where("source_id < 'src3'"), stored)
    return kept.select("item_id").unionByName(repeats.select("item_id", "reason"), allowMissingColumns=True)


@query
def dedup_articles(spark, sf):
    return D.dedup_articles(A.items(spark, sf)).select("item_id", "is_duplicate", "reason", "existing_item_id")


@query
def ingest_articles(spark, sf):
    """Pages to articles; the later half of the pages is of hosts seen in the first, every ninth address is unusable."""
    return article_plan.ingest_articles(A.submitted_pages(spark, sf), F.col("page_id") % 2000 * F.expr("INTERVAL 20 MINUTE") + F.lit("2024-01-01").cast("timestamp")).outcomes


def _blanked(spark, sf):
    items = A.items(spark, sf)
    names = [e.rpartition(" AS ")[2] for e in A.BLANKED]
    return items.selectExpr(*[c for c in items.columns if c not in names], *A.BLANKED)


@query
def dedup_items_blank_keys(spark, sf):
    kept, repeats = D.dedup_items(_blanked(spark, sf))
    return kept.select("item_id").unionByName(repeats.select("item_id", "reason"), allowMissingColumns=True)


@query
def dedup_articles_blank_keys(spark, sf):
    return D.dedup_articles(_blanked(spark, sf)).select("item_id", "reason")


# --- features -------------------------------------------------------------------------------------


@query
def term_frequencies(spark, sf):
    return X.term_frequencies(_docs(spark, sf), "doc_id", "text")


@query
def keyword_counts(spark, sf):
    return X.keyword_counts(_docs(spark, sf), "doc_id", "text")


@query
def keywords(spark, sf):
    return X.keywords(_docs(spark, sf), "doc_id", "text").select("doc_id", _text("keywords").alias("keywords"))


@query
def topics(spark, sf):
    return X.topics(_docs(spark, sf), "doc_id", "text").select("doc_id", _text("topics").alias("topics"))


@query
def event_descriptors(spark, sf):
    raw = A.raw_items(spark, sf)
    found = X.event_descriptors(raw, "item_id", "title", T.bound_content("title", "excerpt", budget=None))
    return found.select("item_id", _text("descriptors", "|").alias("descriptors"))


def _tokens(spark, sf):
    return X.with_tokens(_docs(spark, sf).select(F.col("doc_id").alias("item_id"), "text"), "text")


@query
def interest_match(spark, sf):
    return X.interest_match(_tokens(spark, sf), "item_id", "tokens", A.interests(spark))


@query
def active_matches(spark, sf):
    offered = A.interests(spark)
    found = X.interest_match(_tokens(spark, sf), "item_id", "tokens", offered)
    return X.active_matches(found, offered)


@query
def impact(spark, sf):
    return X.impact(_tokens(spark, sf), "item_id", "tokens", A.LEXICON)


def _analyses(found):
    match = F.transform("interest_matches", lambda m: F.concat_ws(":", m["interest_id"], F.round(m["strength"], 4).cast("decimal(10,4)").cast("string")))
    return found.select(
        "item_id", "language", _text("keywords").alias("keywords"), _text("topics").alias("topics"),
        _text("descriptors", "|").alias("descriptors"), _text(match).alias("interest_matches"), "impact_level",
        F.round("impact_confidence", 9).alias("impact_confidence"), "analyzer_version",
    )


@query
def analyze(spark, sf):
    builtin = lambda i, n: X.deterministic_provider(i, n, A.LEXICON)
    return _analyses(X.analyze(A.items(spark, sf), A.interests(spark), builtin, check=False))


@query
def analyze_provider(spark, sf):
    """A provider that returns rows twice, rows of no item, and matches that are unknown, repeated or out of range."""

    def careless(items, interests):
        good = X.deterministic_provider(items, interests, A.LEXICON)
        odd = F.expr("array(named_struct('interest_id', 'i9', 'strength', 0.5D), named_struct('interest_id', 'i6', 'strength', 1D))")
        again = F.transform("interest_matches", lambda m: F.struct(m["interest_id"].alias("interest_id"), F.lit(7.0).alias("strength")))
        told = good.withColumn("interest_matches", F.concat(odd, "interest_matches", again))
        return told.unionByName(told.where("item_id % 3 = 0")).unionByName(told.where("item_id = 1").withColumn("item_id", -F.col("item_id")))

    return _analyses(X.analyze(A.items(spark, sf), A.interests(spark), careless))


@query
def analyze_incremental(spark, sf):
    """A third of the items first, then all, then all by a provider that may not be asked any more."""
    path = f"{scratch_dir(spark)}/analyses-{uuid.uuid4().hex}"
    items, interests = A.items(spark, sf), A.interests(spark)
    builtin = lambda i, n: X.deterministic_provider(i, n, A.LEXICON)

    def closed(items, interests):
        raise AssertionError("every item has its analysis")

    X.analyze_incremental(path, items.where("item_id % 3 = 0"), interests, builtin, check=False)
    X.analyze_incremental(path, items, interests, builtin, check=False)
    return _analyses(X.analyze_incremental(path, items, interests, closed))


@query
def primary_topic(spark, sf):
    found = X.topics(_docs(spark, sf), "doc_id", "text")
    return found.select("doc_id", X.primary_topic(F.col("topics")).alias("primary_topic"))


# --- grouping -------------------------------------------------------------------------------------


def _probes(spark, sf):
    found = X.topics(_docs(spark, sf), "doc_id", "text")
    raw = A.raw_items(spark, sf).select(
        "item_id", "title", V.observed_at("published_at", "retrieved_at").alias("observed_at"),
        F.col("retrieved_at").alias("received_at"),
    )
    topics = found.select(F.col("doc_id").alias("item_id"), "topics", X.primary_topic(F.col("topics")).alias("primary_topic"))
    # Analysed items are a stored table: several operators read them.
    return materialize(raw.join(topics, "item_id"))


def _as_updates(probes):
    return probes.select(
        F.col("item_id").alias("update_id"), F.col("title").alias("representative_title"), "primary_topic",
        F.col("observed_at").alias("last_observed_at"),
    )


@query
def cosine_pairs(spark, sf):
    """Texts against the representatives that share one of their topics, over the whole texts."""
    docs = X.topics(_docs(spark, sf), "doc_id", "text").select("doc_id", F.explode_outer("topics").alias("topic"))
    reps = X.topics(A.table(spark, sf, "benchmark"), "item_id", "text").select(
        "item_id", X.primary_topic(F.col("topics")).alias("topic")
    )
    pairs = docs.join(reps, "topic").select(F.col("doc_id").alias("left_id"), F.col("item_id").alias("right_id"))
    left = _docs(spark, sf).select(F.col("doc_id").alias("left_id"), "text")
    right = A.table(spark, sf, "benchmark").select(F.col("item_id").alias("right_id"), "text")
    return G.cosine_pairs(left, right, pairs).select("left_id", "right_id", F.round("similarity", 9).alias("similarity"))


@query
def candidate_updates(spark, sf):
    probes = _probes(spark, sf)
    return G.candidate_updates(probes, _as_updates(probes), A.as_of(), GroupingOptions(max_comparisons=25))


@query
def best_match(spark, sf):
    scored = A.table(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS item_id", "l_partkey AS update_id", "l_quantity / 50 AS similarity"
    ).distinct()
    return G.best_match(scored)


@query
def assign_to_updates(spark, sf):
    probes = _probes(spark, sf)
    found = G.assign_to_updates(probes, _as_updates(probes), A.as_of(), GroupingOptions(max_comparisons=25))
    return found.select("item_id", "update_id", F.round("similarity", 9).alias("similarity"))


@query
def assign_to_updates_uncapped(spark, sf):
    probes = _probes(spark, sf)
    found = G.assign_to_updates(probes, _as_updates(probes), A.as_of())
    return found.select("item_id", "update_id", F.round("similarity", 9).alias("similarity"))


@query
def assign_by_index(spark, sf):
    """Updates indexed in three batches: each is first seen ten days earlier, then again at its time; one batch runs twice."""
    probes = _probes(spark, sf)
    updates = _as_updates(probes)
    path = f"{scratch_dir(spark)}/index-{uuid.uuid4().hex}"
    earlier = updates.withColumn("last_observed_at", F.col("last_observed_at") - F.expr("INTERVAL 10 DAYS"))
    C.index_updates(path, 0, earlier)
    C.index_updates(path, 1, updates.where("update_id % 3 = 0"))
    for _ in range(2):
        C.index_updates(path, 2, updates.where("update_id % 3 <> 0"))
    found = C.assign_by_index(path, probes, A.as_of(), before=3)
    return found.select("item_id", "update_id", F.round("similarity", 9).alias("similarity"))


def _grouped(spark, sf, hours):
    return G.group_items(_probes(spark, sf), A.as_of(), GroupingOptions(window_hours=hours))


@query
def group_items(spark, sf):
    _, links = _grouped(spark, sf, 168)
    return links.select("item_id", "update_id", F.round("similarity", 9).alias("similarity"))


@query
def group_items_month(spark, sf):
    _, links = _grouped(spark, sf, 744)
    return links.select("item_id", "update_id", F.round("similarity", 9).alias("similarity"))


@query
def upsert_matches(spark, sf):
    """Items grouped by their normalised title; every match counts for the group."""
    titled = A.items(spark, sf).select("item_id", F.md5(F.col("normalized_title").cast("binary")).alias("update_id"))
    found = X.interest_match(_tokens(spark, sf), "item_id", "tokens", A.interests(spark))
    timed = found.join(A.raw_items(spark, sf).select("item_id", F.col("retrieved_at").alias("matched_at")), "item_id")
    return G.upsert_matches(titled, timed)


@query
def update_windows(spark, sf):
    return G.update_windows(A.links(spark, sf), A.supply_items(spark, sf))


@query
def scoring_signals(spark, sf):
    named = A.supplier_sources(spark, sf).select(
        "source_id", F.concat(F.lit("https://F"), (F.col("source_id") % 8).cast("string"), F.lit(".example.test/rss")).alias("feed_url")
    )
    return G.scoring_signals(A.links(spark, sf), A.supply_items(spark, sf).withColumn("url", F.col("canonical_url")), named)


@query
def commit_outcomes(spark, sf):
    receipts = A.table(spark, sf, "orders").selectExpr("o_orderkey AS receipt_id", "o_custkey AS item_id")
    known = A.table(spark, sf, "customer").where("c_acctbal > 0").selectExpr(
        "c_custkey AS item_id", "CASE c_mktsegment WHEN 'MACHINERY' THEN 'Processed' ELSE 'Queued' END AS status"
    )
    linked = A.table(spark, sf, "supplier").selectExpr("s_suppkey AS item_id")
    return G.commit_outcomes(receipts, known, linked)


@query
def process_messages(spark, sf):
    """Messages about documents: cut off, naming no item or another source, repeated, of final or linked items."""
    every = A.raw_items(spark, sf).selectExpr(
        "*", "item_id AS n", "CASE WHEN item_id % 9 = 0 THEN 'Processed' ELSE 'Queued' END AS status",
        "0 AS failure_count", "CAST(NULL AS STRING) AS last_failure_code",
    ).withColumn("item_id", F.col("item_id").cast("string"))
    body = (
        "concat('{\"messageId\":\"', k, item_id, '\",\"sourceItemId\":\"', item_id, '\",\"correlationId\":\"c\",', "
        "'\"sourceId\":\"', CASE WHEN n % 11 = 0 THEN 'other' ELSE source_id END, '\",\"occurredAtUtc\":\"2024-01-02T00:00:00Z\"}')"
    )
    sent = every.selectExpr("*", "explode(CASE WHEN n % 10 = 0 THEN array('m', 'n') ELSE array('m') END) AS k")
    lines = sent.selectExpr("concat(k, item_id) AS row_id", f"CASE WHEN n % 17 = 0 THEN left({body}, 30) ELSE {body} END AS body")
    box = sent.selectExpr(
        "concat(k, item_id) AS message_id", "item_id", "source_id", "CAST(NULL AS STRING) AS run_id", "'c' AS correlation_id",
        "timestamp'2024-01-02 00:00:00' AS created_at", "'Dispatched' AS status",
    )
    known = every.where("n % 13 <> 0")
    linked = every.where("n % 7 = 0").select("item_id")
    received = every.where("n % 23 = 0").select("item_id")
    result = message_plan.process_messages(lines, known, box, received, linked, A.as_of(), lexicon=A.LEXICON)
    states = result.states.select("item_id", "status", "failure_count", "last_failure_code")
    outcomes = result.outcomes.select("row_id", "outcome")
    return result.dispositions.join(outcomes, "row_id", "left").join(states, "item_id", "left").select(
        "row_id", "disposition", "outcome", "status", "failure_count", "last_failure_code"
    )


# --- scoring --------------------------------------------------------------------------------------


def _scored_matches(spark, sf):
    return X.active_matches(A.update_interests(spark, sf), A.interests(spark))


def _signals(spark, sf):
    return A.table(spark, sf, "part").selectExpr(
        "p_partkey AS update_id",
        "timestamp'2024-01-31 00:00:00' - make_dt_interval(0, CAST(p_partkey % 200 AS INT) - 5) AS newest_at",
        "p_size % 5 AS host_count",
        "CASE p_partkey % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE 'none' END AS impact_level",
    )


@query
def interest_points(spark, sf):
    return S.interest_points(_scored_matches(spark, sf)).select(
        "update_id", F.round("interest_points", 9).alias("interest_points")
    )


@query
def signal_points(spark, sf):
    """Recency, impact and support points."""
    return _signals(spark, sf).select(
        "update_id",
        S.recency_points(F.col("newest_at"), A.as_of()).alias("recency"),
        V.impact_points(F.col("impact_level")).alias("impact"),
        S.support_points(F.col("host_count")).alias("support"),
    )


@query
def score_updates(spark, sf):
    scored = S.score_updates(_signals(spark, sf), _scored_matches(spark, sf), A.as_of())
    return scored.select("update_id", F.round("score", 6).alias("score"), "meets_threshold")


@query
def explain_scores(spark, sf):
    scored = S.score_updates(_signals(spark, sf), _scored_matches(spark, sf), A.as_of())
    rows = S.explain_scores(scored).withColumn("points", F.round("points", 6))
    interest = F.col("name") == "Interest"
    # The interest text spells out rounded numbers; its SQL twin checks the leading words.
    return rows.withColumn(
        "explanation", F.when(interest, F.regexp_extract("explanation", "^(.*?)( at strength|\\.)", 1)).otherwise(F.col("explanation"))
    )


@query
def relevance_scores(spark, sf):
    """Items to scored updates: analysis, grouping over a month, matches, signals, score."""
    result = relevance.score_items(
        A.items(spark, sf), A.interests(spark), A.feed_sources(spark, sf), A.as_of(),
        GroupingOptions(window_hours=744), lexicon=A.LEXICON,
    )
    return result.scores.select("update_id", F.round("score", 6).alias("score"), "meets_threshold")


@query
def top_items(spark, sf):
    """The five items that matter most for the declared interests."""
    scores = relevance.score_single_items(
        A.items(spark, sf), A.interests(spark), A.feed_sources(spark, sf), A.as_of(), A.LEXICON
    )
    return B.select_current(scores.where("meets_threshold")).select(
        "rank", "update_id", F.round("score", 6).alias("score"), "candidate_count"
    )


# --- state ----------------------------------------------------------------------------------------


def _run_report(spark, sf):
    fed = A.table(spark, sf, "customer").selectExpr(
        "c_custkey AS source_id", "c_nationkey = 0 AS not_modified", "CASE WHEN c_acctbal < -900 THEN 'request_timed_out' END AS error_code"
    )
    seen = A.table(spark, sf, "orders").selectExpr(
        "o_custkey AS source_id",
        "CASE WHEN o_orderstatus = 'F' THEN 'new' WHEN o_orderkey % 40 = 0 THEN 'failed' ELSE 'duplicate' END AS outcome",
    )
    return H.run_report(fed, seen)


@query
def run_report(spark, sf):
    return _run_report(spark, sf)


@query
def job_summary(spark, sf):
    return H.job_summary(_run_report(spark, sf))


@query
def latest_run_per_source(spark, sf):
    return H.latest_run_per_source(A.runs(spark, sf))


@query
def apply_failures(spark, sf):
    events = A.table(spark, sf, "events")
    known = events.groupBy(F.col("user_id").alias("item_id")).agg(F.min("event_id").alias("m")).selectExpr(
        "item_id", "CASE item_id % 4 WHEN 0 THEN 'Processed' WHEN 1 THEN 'FailedRetryable' ELSE 'Queued' END AS status",
        "CAST(CASE item_id % 4 WHEN 1 THEN 2 ELSE 0 END AS INT) AS failure_count", "CAST(NULL AS STRING) AS last_failure_code",
    )
    failed = events.where("event_type IN ('error', 'click')").selectExpr(
        "user_id AS item_id", "ts AS failed_at", "event_id AS failure_id", "concat(' code', event_id % 10, ' ') AS failure_code",
        "event_type = 'error' AND value > 60 AS is_validation",
    )
    return H.apply_failures(known, failed)


@query
def mark_processed(spark, sf):
    known = A.table(spark, sf, "part").selectExpr(
        "p_partkey AS item_id",
        "CASE p_partkey % 5 WHEN 0 THEN 'Filtered' WHEN 1 THEN 'FailedTerminal' WHEN 2 THEN 'Processed' ELSE 'Queued' END AS status",
    )
    linked = A.table(spark, sf, "lineitem").where("l_returnflag = 'A' AND l_quantity > 25").selectExpr("l_partkey AS item_id")
    return H.mark_processed(known, linked)


@query
def pending(spark, sf):
    moment = F.lit("1997-01-01 00:00:00").cast("timestamp")
    return H.pending(A.outbox(spark, sf), moment, 20, lease_seconds=30).select("message_id", "created_at", "last_attempt_at")


@query
def quarantine_report(spark, sf):
    return H.quarantine_report(A.outbox(spark, sf))


# --- briefs ---------------------------------------------------------------------------------------


def _now():
    return F.lit("2024-01-31 00:00:00").cast("timestamp")


@query
def brief_window(spark, sf):
    made = A.briefs(spark, sf)
    none = B.brief_window(made.where("status = 'Unknown'"), _now())
    return B.brief_window(made, _now()).withColumn("kind", F.lit("latest")).unionByName(
        none.withColumn("kind", F.lit("lookback"))
    )


def _eligible(spark, sf):
    """Updates of the last 30 days; a brief holds an update when the line was returned."""
    made = A.table(spark, sf, "lineitem").where("l_returnflag = 'R' AND l_quantity > 40").selectExpr(
        "l_orderkey AS brief_id", "l_partkey AS update_id"
    )
    window = B.brief_window(A.briefs(spark, sf).where("status = 'Unknown'"), _now(), BriefOptions(lookback_days=30))
    return B.eligible_updates(A.updates(spark, sf), A.briefs(spark, sf), made, window)


@query
def eligible_updates(spark, sf):
    return _eligible(spark, sf).select("update_id", F.round("score", 6).alias("score"))


@query
def select_brief(spark, sf):
    return B.select_current(_eligible(spark, sf)).withColumn("score", F.round("score", 6))


def _by_brand(spark, sf):
    return B.select_brief(_eligible(spark, sf).withColumn("brief_id", F.col("brand")))


@query
def select_brief_per_audience(spark, sf):
    return _by_brand(spark, sf).withColumn("score", F.round("score", 6))


def _inputs(spark, sf):
    return B.generation_inputs(
        _by_brand(spark, sf), A.links(spark, sf), A.supply_items(spark, sf), A.update_interests(spark, sf),
        A.interests(spark), A.updates(spark, sf),
    )


@query
def generation_inputs(spark, sf):
    return _inputs(spark, sf).select(
        "brief_id", "update_id", "primary_topic",
        _text(F.transform("sources", lambda s: F.concat_ws("|", s["item_id"].cast("string"), s["url"]))).alias("sources"),
        _text(F.transform("interests", lambda i: i["interest_id"])).alias("interests"),
    )


@query
def clamp_request(spark, sf):
    """Length and list limits of a request, met by long titles and texts."""
    raw = A.raw_items(spark, sf)
    return raw.select(
        "item_id", _md5(T.clamp("title", 512)).alias("title"), _md5(T.clamp(T.clamp("excerpt", 4000), 2000)).alias("excerpt"),
        _md5(T.clamp("title", 200)).alias("topic"), T.clamp("source_id", 100).alias("name"),
    )


@query
def request_limits(spark, sf):
    """Requests whose lists and texts are beyond every limit: an update for each source of texts, interests by customer."""
    items = A.items(spark, sf)
    updates = items.select(F.col("source_id").alias("update_id")).distinct().withColumn("primary_topic", F.repeat("update_id", 60))
    links = items.select(F.col("source_id").alias("update_id"), "item_id")
    customers = A.table(spark, sf, "customer").withColumn("interest_id", F.lpad(F.col("c_custkey").cast("string"), 9, "0"))
    interests = customers.selectExpr("interest_id", "repeat(c_name, 8) AS name", "'High' AS priority", "c_custkey % 7 <> 0 AS is_active")
    met = customers.selectExpr("concat('src', c_custkey % 5) AS update_id", "interest_id", "c_custkey * 37 % 101 / 100D AS strength")
    found = B.generation_inputs(updates.select("update_id"), links, items, met, interests, updates)
    sources = F.transform("sources", lambda s: F.concat_ws("|", s["item_id"].cast("string"), s["title"], s["excerpt"]))
    names = F.transform("interests", lambda i: F.concat_ws("|", i["interest_id"], i["name"]))
    return found.select(
        "update_id", "primary_topic", F.size("sources").alias("n_sources"), _md5(F.array_join(sources, "\n")).alias("sources"),
        F.size("interests").alias("n_interests"), _md5(F.array_join(names, "\n")).alias("interests"),
    )


@query
def compose(spark, sf):
    return B.compose(_inputs(spark, sf)).select("brief_id", "update_id", "title", "summary", "why_relevant")


def _completed(spark, sf):
    header = A.table(spark, sf, "part").select("p_brand").distinct().selectExpr(
        "p_brand AS brief_id", "timestamp'2024-01-31 00:00:00' AS generated_at", "'Generating' AS status"
    )
    selected = _by_brand(spark, sf)
    # The provider fails for one type of update.
    text = B.compose(_inputs(spark, sf).where("primary_topic <> 'PROMO'"))
    sources = B.brief_sources(selected, A.links(spark, sf), A.supply_items(spark, sf))
    return B.complete_brief(header, selected, text, sources, _now())


@query
def complete_brief(spark, sf):
    header, _, _ = _completed(spark, sf)
    return header.select("brief_id", "status", "candidate_count", "selected_count")


@query
def complete_brief_items(spark, sf):
    _, made, backed = _completed(spark, sf)
    counts = backed.groupBy("brief_id", "update_id").agg(F.count("*").alias("sources"))
    return made.join(counts, ["brief_id", "update_id"]).select(
        "brief_id", "update_id", "rank", F.round("score", 6).alias("score"), "title", "topic", "sources"
    )


@query
def fail_orphans(spark, sf):
    return B.fail_orphans(A.briefs(spark, sf), F.lit("1996-01-01").cast("timestamp")).select("brief_id", "status", "selected_count")


def _view(spark, sf, header):
    saved = J.apply_saves(A.save_events(spark, sf))
    return B.brief_view(header, A.brief_items(spark, sf), A.brief_item_sources(spark, sf), A.feedback(spark, sf), saved).select(
        "brief_id", "update_id", "rank", F.round("score", 6).alias("score"), "title", "latest_feedback", "is_saved", "source_item_id"
    )


@query
def current_brief(spark, sf):
    return _view(spark, sf, B.current_brief(A.briefs(spark, sf)))


@query
def brief_view(spark, sf):
    """The read model of every completed brief."""
    return _view(spark, sf, A.briefs(spark, sf).where("status = 'Completed'"))


@query
def brief_history(spark, sf):
    made = A.briefs(spark, sf)
    first = B.brief_history(made, 20)
    second = B.brief_history(made, 20, B.next_cursor(first))
    columns = ["brief_id", "generated_at", "status", "position", "has_more"]
    return first.select(F.lit(1).alias("page"), *columns).unionByName(second.select(F.lit(2).alias("page"), *columns))


# --- interactions ---------------------------------------------------------------------------------


@query
def record_feedback(spark, sf):
    events = A.table(spark, sf, "events").selectExpr(
        "event_id AS feedback_id", "user_id AS update_id", "event_type AS feedback_type", "ts AS created_at",
        "CASE WHEN event_id % 3 > 0 THEN user_id + event_id % 2 END AS brief_item_id",
    )
    known = A.table(spark, sf, "supplier").selectExpr("s_suppkey AS update_id")
    owned = A.table(spark, sf, "customer").selectExpr("c_custkey AS brief_item_id", "c_custkey AS update_id")
    good, bad = J.record_feedback(events, known, owned)
    return good.select("feedback_id").unionByName(bad.select("feedback_id", "reason"), allowMissingColumns=True)


@query
def latest_feedback(spark, sf):
    return J.latest_feedback(A.feedback(spark, sf))


@query
def clear_feedback(spark, sf):
    return J.clear_feedback(A.feedback(spark, sf), A.clears(spark, sf))


@query
def apply_saves(spark, sf):
    known = A.table(spark, sf, "supplier").selectExpr("s_suppkey AS update_id")
    return J.apply_saves(A.save_events(spark, sf), known)


@query
def record_opens(spark, sf):
    good, bad = J.record_opens(A.opens(spark, sf), A.link_lines(spark, sf))
    return good.select("event_id", F.lit(True).alias("accepted")).unionByName(bad.select("event_id", F.lit(False).alias("accepted")))


# --- reports --------------------------------------------------------------------------------------


@query
def grouped_duplicates(spark, sf):
    return R.grouped_duplicates(A.links(spark, sf))


@query
def feedback_tally(spark, sf):
    return R.feedback_tally(A.feedback(spark, sf))


@query
def items_per_brief(spark, sf):
    return R.items_per_brief(A.briefs(spark, sf), A.brief_items(spark, sf)).withColumn("items_per_brief", F.round("items_per_brief", 9))


@query
def source_distribution(spark, sf):
    return R.source_distribution(
        A.supply_items(spark, sf), A.briefs(spark, sf), A.brief_item_sources(spark, sf), A.supplier_sources(spark, sf)
    )


@query
def evaluation_summary(spark, sf):
    saved = J.apply_saves(A.save_events(spark, sf))
    return R.evaluation_summary(
        A.supply_items(spark, sf), A.briefs(spark, sf), A.brief_items(spark, sf), A.links(spark, sf),
        A.feedback(spark, sf), A.opens(spark, sf), saved,
    ).withColumn("items_per_brief", F.round("items_per_brief", 9))


@query
def list_sources(spark, sf):
    every = A.feed_sources(spark, sf)
    return R.list_sources(every).withColumn("kind", F.lit("all")).unionByName(
        R.list_sources(every, enabled_only=True).withColumn("kind", F.lit("enabled"))
    )


@query
def list_interests(spark, sf):
    """Market segments as declared names, with the customers behind each."""
    every = A.table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n")).selectExpr(
        "c_mktsegment AS interest_id", "c_mktsegment AS name", "n", "c_mktsegment <> 'MACHINERY' AS is_active"
    )
    return R.list_interests(every).withColumn("kind", F.lit("all")).unionByName(
        R.list_interests(every, active_only=True).withColumn("kind", F.lit("active"))
    )


# --- whole plans and streams ----------------------------------------------------------------------


@query
def generate_brief(spark, sf):
    request = spark.sql("SELECT 'next' AS brief_id, timestamp'2024-01-31 00:00:00' AS generated_at, 'Generating' AS status")
    made = A.table(spark, sf, "lineitem").where("l_returnflag = 'R' AND l_quantity > 40").selectExpr(
        "l_orderkey AS brief_id", "l_partkey AS update_id"
    )
    _, picked, _ = brief_plan.generate_brief(
        request, A.updates(spark, sf), A.links(spark, sf), A.supply_items(spark, sf), A.update_interests(spark, sf),
        A.interests(spark), A.briefs(spark, sf), made, _now(),
        window=B.brief_window(A.briefs(spark, sf).where("status = 'Unknown'"), _now(), BriefOptions(lookback_days=30)),
    )
    return picked.select("brief_id", "update_id", "rank", F.round("score", 6).alias("score"), "title", "summary", "why_relevant")


@query
def late_items(spark, sf):
    seen = A.raw_items(spark, sf).select("item_id", V.observed_at("published_at", "retrieved_at").alias("observed_at"), "retrieved_at")
    return streams.late_items(seen, F.col("retrieved_at"), GroupingOptions(window_hours=48)).select("item_id")


@query
def stream_latest_feedback(spark, sf):
    return streams.run_latest_feedback(spark, sf)


@query
def stream_items(spark, sf):
    return streams.run_items(spark, sf)


@query
def stream_feeds(spark, sf):
    """Raw feed documents in several micro-batches to stored items."""
    return streams.run_feeds(spark, sf)


@query
def stream_groups(spark, sf):
    """Items in several micro-batches to grouped and scored updates."""
    return streams.run_groups(spark, sf)


@query
def stream_late_items(spark, sf):
    return streams.run_late(spark, sf)


@query
def stream_feedback_with_clears(spark, sf):
    return streams.run_feedback_with_clears(spark, sf)
