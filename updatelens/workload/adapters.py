"""Views of the test tables as model tables. The same rules stand as SQL text in ``oracles``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from updatelens.functions import text as T
from updatelens.functions.links import canonical_url, url_hash
from updatelens.functions.values import content_hash
from updatelens.session import configure

# Parameter words that occur in the test corpus.
LEXICON = ["tion", "ing", "ble", "ther", "than", "des"]
INTERESTS = """
    VALUES ('i1', 'the', 'High', true), ('i2', 'and that', 'High', true), ('i3', 'was with', 'Medium', true),
           ('i4', 'this are from', 'Medium', true), ('i5', 'tion', 'Low', true), ('i6', 'for', 'High', false)
"""


# Items with some keys taken away or left blank, the same in both dialects.
BLANKED = (
    "CASE WHEN item_id % 6 <> 0 THEN source_id END AS source_id",
    "CASE WHEN item_id % 5 = 0 THEN ' ' ELSE external_id END AS external_id",
    "CASE WHEN item_id % 7 = 0 THEN '' ELSE url_hash END AS url_hash",
    "CASE WHEN item_id % 11 = 0 THEN '' WHEN item_id % 3 <> 0 THEN content_hash END AS content_hash",
)


def as_of():
    return F.lit("2024-01-31 00:00:00").cast("timestamp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table with UTC timestamps, read as it lies."""
    configure(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(
        *[F.col(c).cast("timestamp").alias(c) if t == "timestamp_ntz" else F.col(c) for c, t in df.dtypes]
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts, dealt to all cores. The test table is one row group, which else keeps one core busy with all text
    work; a table of many files needs no such step."""
    return table(spark, sf_dir, "documents").repartition(spark.sparkContext.defaultParallelism)


def interests(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT * FROM {INTERESTS} AS t(interest_id, name, priority, is_active)")


def raw_items(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """Items before cleaning: the first line of a text is its title, the rest its excerpt."""
    docs = documents(spark, sf_dir) if docs is None else docs
    return docs.selectExpr(
        "doc_id AS item_id",
        "source AS source_id",
        "CASE WHEN doc_id % 5 < 2 THEN concat('x', CAST(floor(doc_id / 40) AS STRING)) END AS external_id",
        "CASE WHEN doc_id % 4 IN (1, 2) THEN concat('https://', source, '.example.test/a/', "
        "CAST(floor(doc_id / 40) AS STRING)) END AS url",
        "substring_index(text, '\\n', 1) AS title",
        "CASE WHEN instr(text, '\\n') > 0 THEN nullif(substr(text, instr(text, '\\n') + 1), '') END AS excerpt",
        "timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST(doc_id % 1080 * 40 AS INT)) AS retrieved_at",
        "CASE WHEN doc_id % 10 > 0 THEN timestamp'2024-01-01 00:00:00' "
        "+ make_dt_interval(0, -CAST(doc_id % 96 AS INT), CAST(doc_id % 1080 * 40 AS INT)) END AS published_at",
        "lang AS language",
        "doc_id % 7 = 0 AS no_hash",
    )


def items(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """Stored form of the items, of any length."""
    raw = raw_items(spark, sf_dir, docs)
    return raw.select(
        "item_id", "source_id", "external_id", "url", "title", "excerpt", "retrieved_at", "published_at", "language",
        canonical_url(F.col("url")).alias("canonical_url"),
        F.col("url").alias("original_url"),
        url_hash(canonical_url(F.col("url"))).alias("url_hash"),
        T.upper_invariant(T.collapse_ws("title")).alias("normalized_title"),
        F.when(~F.col("no_hash"), content_hash(F.col("title"), F.col("excerpt"))).alias("content_hash"),
    )


def submitted_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages handed in by their address: some addresses come twice, some are of private hosts or no links."""
    return table(spark, sf_dir, "pages").selectExpr(
        "page_id",
        "CASE WHEN page_id % 9 = 4 THEN concat('http://10.0.0.', page_id % 200, '/p') WHEN page_id % 9 = 5 THEN concat('ftp://x.example/', page_id) "
        "WHEN page_id % 5 = 1 THEN concat('https://again.example/', floor(page_id / 10)) ELSE concat('https://one.example/', page_id) END AS url",
        "html",
    )


def title_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    return items(spark, sf_dir).withColumns({"external_id": none, "url_hash": none, "content_hash": none})


def feed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("source").distinct().selectExpr(
        "source AS source_id",
        "source AS name",
        "concat('https://', source, '.example.test/rss') AS feed_url",
        "CAST(substr(source, 4) AS INT) % 9 <> 0 AS is_enabled",
    )


def _xml(c: str) -> str:
    return f"replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One small feed document per text: RSS for even ids, Atom for odd ones; some are broken."""
    title, rest = "substring_index(text, '\\n', 1)", "substr(text, instr(text, '\\n') + 1)"
    doc = documents(spark, sf_dir).selectExpr(
        "doc_id", "source", f"{_xml(title)} AS t",
        f"CASE WHEN instr(text, '\\n') > 0 THEN {_xml(rest)} END AS e",
    )
    rss = (
        "concat('<rss version=\"2.0\"><channel><title>c</title><item><guid>g', doc_id, '</guid><link>/a/', doc_id, "
        "'</link><title>', t, '</title>', coalesce(concat('<description>', e, '</description>'), ''), "
        "'<pubDate>Mon, 01 Jan 2024 12:30:00 -0300</pubDate></item><item><guid>n', doc_id, "
        "'</guid><title>Note ', doc_id, '</title></item><item><guid>none</guid></item></channel></rss>')"
    )
    atom = (
        "concat('<feed xmlns=\"http://www.w3.org/2005/Atom\"><id>f</id><title>c</title><updated>2024-01-01T00:00:00Z"
        "</updated><entry><id>g', doc_id, '</id><link rel=\"self\" href=\"/s\"/><link rel=\"alternate\" href=\"/a/', "
        "doc_id, '\"/><title>', t, '</title>', coalesce(concat('<summary>', e, '</summary>'), ''), "
        "'<updated>2024-01-01T12:30:00-03:00</updated></entry></feed>')"
    )
    return doc.selectExpr(
        "doc_id AS source_id",
        "concat('https://', source, '.example.test/rss') AS feed_url",
        f"CASE WHEN doc_id % 31 = 0 THEN concat('<rss><channel>', t) WHEN doc_id % 37 = 0 THEN '<html></html>' "
        f"WHEN doc_id % 2 = 0 THEN {rss} ELSE {atom} END AS payload",
    )


# --- briefs, updates and logs ---------------------------------------------------------------------


def briefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS brief_id",
        "o_orderdate + make_dt_interval(0, 0, CAST(o_orderkey % 1440 AS INT)) AS generated_at",
        "CASE o_orderstatus WHEN 'F' THEN 'Completed' WHEN 'O' THEN 'Generating' ELSE 'Failed' END AS status",
        "o_orderkey % 6 AS selected_count",
    )


def brief_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of an order as a ranked item of its brief. An order has few lines.

    Named before the window, so that the rows stay dealt by brief_id; texts are made after it and not shuffled.
    """
    lines = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS brief_id", "l_partkey AS update_id", "l_linenumber", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount"
    )
    order = ["l_linenumber", "update_id", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice"]
    ranked = lines.withColumn("rank", F.row_number().over(Window.partitionBy("brief_id").orderBy(*order)))
    return ranked.selectExpr("brief_id", "update_id", "rank", "l_quantity + l_discount AS score", "concat('Title ', update_id) AS title")


def brief_item_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items behind each brief item, dealt by brief_id before repeats go: all readers join by it."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS brief_id", "l_partkey AS update_id", "l_partkey * 100000 + l_suppkey AS item_id"
    ).repartition("brief_id").distinct()


def link_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links with repeats, for operators that take them."""
    return table(spark, sf_dir, "lineitem").selectExpr("l_partkey AS update_id", "l_partkey * 100000 + l_suppkey AS item_id")


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_lines(spark, sf_dir).distinct()


def supply_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items behind ``links``: one per part and supplier."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.max("l_shipdate").alias("at"))
    return lines.selectExpr(
        "l_partkey * 100000 + l_suppkey AS item_id",
        "CASE WHEN l_partkey % 50 > 0 THEN l_suppkey END AS source_id",
        "concat('Part ', l_partkey, ' from supplier ', l_suppkey) AS title",
        "CASE WHEN l_suppkey % 3 > 0 THEN concat(' Note ', l_suppkey % 4, ' ') END AS excerpt",
        "CASE WHEN l_suppkey % 4 > 0 THEN concat('https://s', l_suppkey, '.example.test/p/', l_partkey) END AS canonical_url",
        "concat('HTTPS://S', l_suppkey, '.example.test/p/', l_partkey) AS original_url",
        "CASE WHEN l_suppkey % 7 > 0 THEN at END AS published_at",
        "timestamp'2002-01-01 00:00:00' AS retrieved_at",
    )


def supplier_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").where("s_suppkey % 25 > 0").selectExpr(
        "s_suppkey AS source_id", "s_name AS name"
    )


def updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS update_id",
        "p_retailprice % 120 AS score",
        "timestamp'2024-01-31 00:00:00' - make_dt_interval(p_size) AS last_observed_at",
        "p_type AS primary_topic",
        "CASE WHEN p_name LIKE 'red%' THEN 'Archived' ELSE 'Active' END AS status",
        "p_brand AS brand",
    )


def update_interests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_partkey").alias("update_id"), F.expr("concat('i', l_linenumber)").alias("interest_id")
    ).agg(F.max(F.expr("l_discount * 10")).alias("strength"))


def feedback(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    events = table(spark, sf_dir, "events") if events is None else events
    return events.where("event_type IN ('purchase', 'error')").selectExpr(
        "event_id AS feedback_id",
        "user_id AS update_id",
        "CASE event_type WHEN 'purchase' THEN 'Relevant' ELSE 'NotRelevant' END AS feedback_type",
        "CAST(ts AS TIMESTAMP) AS created_at",
    )


def clears(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    events = table(spark, sf_dir, "events") if events is None else events
    return events.where("event_type = 'view'").selectExpr(
        "event_id AS clear_id", "user_id AS update_id", "ts AS cleared_at"
    )


def save_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_type IN ('signup', 'view')").selectExpr(
        "event_id",
        "user_id AS update_id",
        "CASE event_type WHEN 'signup' THEN 'save' ELSE 'unsave' END AS action",
        "ts AS created_at",
    )


def opens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_type = 'click'").selectExpr(
        "event_id", "user_id AS update_id", "user_id * 100000 + event_id % 100 + 1 AS item_id", "ts AS opened_at"
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS run_id",
        "o_custkey AS source_id",
        "o_orderdate AS started_at",
        "o_orderdate + make_dt_interval(0, 0, CAST(o_orderkey % 50 - 2 AS INT)) AS completed_at",
        "o_orderkey % 20 AS retrieved_count",
        "o_orderkey % 7 AS new_count",
        "CASE WHEN o_orderstatus = 'P' THEN 'Failed' WHEN o_orderpriority = '1-URGENT' THEN 'NotModified' "
        "ELSE 'Succeeded' END AS status",
        "CASE WHEN o_orderkey % 3 > 0 THEN concat('v', o_orderkey % 11) END AS validator",
    )


def message_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON text per order: some lack a field, some have an unknown one, some are cut off."""
    body = (
        "concat('{\"messageId\":\"m', o_orderkey, '\",\"sourceItemId\":\"i', o_orderkey, '\",', "
        "CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE concat('\"correlationId\":\"c', o_custkey, '\",') END, "
        "CASE WHEN o_orderkey % 13 = 0 THEN '\"extra\":1,' ELSE '' END, "
        "CASE WHEN o_orderkey % 3 = 0 THEN '\"sourceId\":null,' ELSE concat('\"sourceId\":\"s', o_custkey, '\",') END, "
        "'\"occurredAtUtc\":\"', date_format(o_orderdate, 'yyyy-MM-dd'), 'T00:00:00Z\"}')"
    )
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS row_id",
        f"CASE WHEN o_orderkey % 17 = 0 THEN left({body}, 40) WHEN o_orderkey % 19 = 0 "
        f"THEN replace({body}, 'T00:00:00Z', ' at noon') ELSE {body} END AS body",
    )


def outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS message_id",
        "o_orderdate AS created_at",
        "CASE o_orderstatus WHEN 'F' THEN 'Dispatched' WHEN 'O' THEN 'Pending' ELSE 'Quarantined' END AS status",
        "o_orderkey % 4 AS attempts",
        "CASE WHEN o_orderkey % 4 > 0 THEN o_orderdate + make_dt_interval(0, 0, CAST(o_orderkey % 90 AS INT)) END "
        "AS last_attempt_at",
        "CASE WHEN o_orderkey % 5 = 1 THEN concat('error ', o_orderkey % 9) END AS last_error",
    )
