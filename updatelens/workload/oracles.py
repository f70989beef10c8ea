"""The registered queries as SQL over the raw tables, written independently of the operators."""

from __future__ import annotations

from updatelens.constants import STOP_WORDS
from updatelens.workload.adapters import BLANKED, INTERESTS, LEXICON

WS = r"[\s\x0b\p{Z}\x{85}]"


def _collapse(c: str) -> str:
    return f"trim(regexp_replace({c}, '{WS}+', ' ', 'g'))"


def _trim(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def _upper(c: str) -> str:
    return f"replace(upper(replace({c}, 'ß', chr(57344))), chr(57344), 'ß')"


def _tokens(c: str) -> str:
    return f"regexp_extract_all(replace(lower({c}), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}]+')"


def _in(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


RAW = """raw AS (
  SELECT doc_id AS item_id, source AS source_id,
    CASE WHEN doc_id % 5 < 2 THEN 'x' || (doc_id // 40) END AS external_id,
    CASE WHEN doc_id % 4 IN (1, 2) THEN 'https://' || source || '.example.test/a/' || (doc_id // 40) END AS url,
    split_part(text, chr(10), 1) AS title,
    CASE WHEN strpos(text, chr(10)) > 0 THEN nullif(substr(text, strpos(text, chr(10)) + 1), '') END AS excerpt,
    TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id % 1080 * 40) AS retrieved_at,
    CASE WHEN doc_id % 10 > 0
      THEN TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id % 1080 * 40) - to_hours(doc_id % 96) END AS published_at,
    lang AS language
  FROM documents)"""

ITEMS = f"""{RAW}, items AS (
  SELECT *, upper(sha256(url)) AS url_hash, {_upper(_collapse('title'))} AS normalized_title,
    CASE WHEN item_id % 7 > 0 AND {_trim('excerpt')} <> '' THEN upper(sha256(title || chr(10) || excerpt)) END AS content_hash
  FROM raw)"""

FEED_FIELDS = f"""parsed AS (
  SELECT doc_id, source, substr({_collapse("split_part(text, chr(10), 1)")}, 1, 800) AS title,
    CASE WHEN strpos(text, chr(10)) > 0
      THEN nullif(substr({_collapse("substr(text, strpos(text, chr(10)) + 1)")}, 1, 4000), '') END AS excerpt
  FROM documents WHERE doc_id % 31 <> 0 AND doc_id % 37 <> 0)"""

COUNTS = f"""counts AS (
  SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest({_tokens('text')}) AS token FROM documents)
  GROUP BY doc_id, token),
words AS (SELECT * FROM counts WHERE length(token) >= 3 AND token NOT IN {_in(STOP_WORDS)}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tf DESC, token) AS r FROM words)"""

BRIEFS = """briefs AS (
  SELECT o_orderkey AS brief_id, o_orderdate + to_minutes(o_orderkey % 1440) AS generated_at,
    CASE o_orderstatus WHEN 'F' THEN 'Completed' WHEN 'O' THEN 'Generating' ELSE 'Failed' END AS status,
    o_orderkey % 6 AS selected_count FROM orders)"""

BRIEF_ITEMS = """brief_items AS (
  SELECT l_orderkey AS brief_id, l_partkey AS update_id,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity,
      l_extendedprice) AS rank,
    l_quantity + l_discount AS score, 'Title ' || l_partkey AS title FROM lineitem),
brief_item_sources AS (
  SELECT DISTINCT l_orderkey AS brief_id, l_partkey AS update_id, l_partkey * 100000 + l_suppkey AS item_id FROM lineitem)"""

LINKS = "links AS (SELECT DISTINCT l_partkey AS update_id, l_partkey * 100000 + l_suppkey AS item_id FROM lineitem)"

SUPPLY = """supply AS (
  SELECT l_partkey, l_suppkey, l_partkey * 100000 + l_suppkey AS item_id,
    CASE WHEN l_partkey % 50 > 0 THEN l_suppkey END AS source_id,
    'Part ' || l_partkey || ' from supplier ' || l_suppkey AS title,
    CASE WHEN l_suppkey % 3 > 0 THEN 'Note ' || (l_suppkey % 4) END AS excerpt,
    CASE WHEN l_suppkey % 4 > 0 THEN 'https://s' || l_suppkey || '.example.test/p/' || l_partkey
      ELSE 'HTTPS://S' || l_suppkey || '.example.test/p/' || l_partkey END AS url,
    CASE WHEN l_suppkey % 7 > 0 THEN max(l_shipdate) END AS published_at
  FROM lineitem GROUP BY l_partkey, l_suppkey)"""

UPDATE_INTERESTS = """update_interests AS (
  SELECT l_partkey AS update_id, 'i' || l_linenumber AS interest_id, max(l_discount * 10) AS strength
  FROM lineitem GROUP BY 1, 2)"""

INTEREST_ROWS = f"interests AS (SELECT * FROM ({INTERESTS}) AS t(interest_id, name, priority, is_active))"

INTEREST_WORDS = f"""{INTEREST_ROWS}, iw AS (
  SELECT DISTINCT interest_id, unnest({_tokens('name')}) AS token FROM interests),
sizes AS (SELECT interest_id, count(*) AS size FROM iw GROUP BY 1)"""

FEEDBACK = """feedback AS (
  SELECT event_id AS feedback_id, user_id AS update_id,
    CASE event_type WHEN 'purchase' THEN 'Relevant' ELSE 'NotRelevant' END AS feedback_type, ts AS created_at
  FROM events WHERE event_type IN ('purchase', 'error')),
latest AS (
  SELECT update_id, feedback_type, created_at, feedback_id FROM feedback
  QUALIFY row_number() OVER (PARTITION BY update_id ORDER BY created_at DESC, feedback_id DESC) = 1)"""

SAVES = """gone AS (
  SELECT user_id AS update_id, ts, event_id FROM events WHERE event_type = 'view'
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1),
saved AS (
  SELECT e.user_id AS update_id, min(e.ts) AS saved_at FROM events e LEFT JOIN gone g ON g.update_id = e.user_id
  WHERE e.event_type = 'signup' AND (g.ts IS NULL OR (e.ts, e.event_id) > (g.ts, g.event_id)) GROUP BY 1)"""

ELIGIBLE = """eligible AS (
  SELECT p_partkey AS update_id, p_retailprice % 120 AS score, p_type AS primary_topic, p_brand AS brand FROM part
  WHERE p_name NOT LIKE 'red%' AND p_retailprice % 120 >= 55
    AND TIMESTAMP '2024-01-31 00:00:00' - to_days(p_size) >= TIMESTAMP '2024-01-01 00:00:00'
    AND p_partkey NOT IN (
      SELECT l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey
      WHERE l_returnflag = 'R' AND l_quantity > 40 AND o_orderstatus = 'F')),
picked AS (
  SELECT brand AS brief_id, update_id, primary_topic, score,
    row_number() OVER (PARTITION BY brand ORDER BY score DESC, update_id) AS rank,
    count(*) OVER (PARTITION BY brand) AS candidate_count FROM eligible
  QUALIFY rank <= 5)"""

REQUESTS = f"""{ELIGIBLE}, {SUPPLY}, {UPDATE_INTERESTS}, {INTEREST_ROWS},
src AS (
  SELECT s.*, p.update_id, row_number() OVER (PARTITION BY p.update_id ORDER BY s.published_at DESC NULLS LAST, s.item_id) AS n
  FROM supply s JOIN (SELECT DISTINCT update_id FROM picked) p ON p.update_id = s.l_partkey),
req AS (
  SELECT update_id, string_agg(item_id || '|' || url, ' ' ORDER BY n) AS sources, max(title) FILTER (n = 1) AS title
  FROM src WHERE n <= 50 GROUP BY 1),
notes AS (
  SELECT update_id, string_agg(excerpt, ' ' ORDER BY n) AS notes
  FROM (SELECT update_id, excerpt, min(n) AS n FROM src WHERE n <= 50 AND excerpt IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
titles AS (SELECT update_id, string_agg(title, ' ' ORDER BY n) AS titles FROM src WHERE n <= 50 GROUP BY 1),
hits AS (
  SELECT update_id, interest_id, name, row_number() OVER (PARTITION BY update_id ORDER BY strength DESC, interest_id) AS n
  FROM update_interests JOIN interests USING (interest_id) WHERE is_active),
matched AS (
  SELECT update_id, string_agg(interest_id, ' ' ORDER BY n) AS interests, string_agg(name, ', ' ORDER BY n) AS names
  FROM hits GROUP BY 1),
text AS (
  SELECT p.*, r.sources, coalesce(m.interests, '') AS interests, substr(r.title, 1, 200) AS title,
    substr(coalesce(notes.notes, titles.titles), 1, 2000) AS summary,
    substr(CASE WHEN m.names IS NOT NULL THEN 'Relevant to your interests: ' || m.names || '.'
      ELSE 'Relevant to the ' || p.primary_topic || ' topic.' END, 1, 1000) AS why_relevant
  FROM picked p JOIN req r USING (update_id) LEFT JOIN matched m USING (update_id)
  LEFT JOIN notes USING (update_id) LEFT JOIN titles USING (update_id))"""


# Keys that are null, blank or without a source.
BLANKED_KEYS = ", ".join(BLANKED)


def _walk(rules: tuple[str, ...], order: str = "retrieved_at, item_id", source: str = "items") -> str:
    """A one-at-a-time pass: each step looks at the next item and the lists of what was kept."""
    columns = {"external_id": "external_id", "url": "url_hash", "content_hash": "content_hash"}
    keys = {r: f"CASE WHEN trim({c}) <> '' THEN {c} END" for r, c in columns.items()}
    keys["external_id"] = f"(coalesce('s' || source_id, '') || chr(31) || {keys['external_id']})"
    ranks = ", ".join(
        f"CASE WHEN {keys[r]} IS NOT NULL THEN dense_rank() OVER (ORDER BY {keys[r]}) END AS d_{r}" for r in rules
    )
    pair = "STRUCT(k BIGINT, i BIGINT)[]"
    lists = "".join(f", []::{pair} AS s_{r}" for r in rules)
    finds = "".join(f", list_filter(w.s_{r}, lambda e: e.k = o.d_{r})[1].i AS f_{r}" for r in rules)
    carry = "".join(f", w.s_{r}" for r in rules)
    grown = "".join(
        f", CASE WHEN reason IS NULL AND d_{r} IS NOT NULL THEN list_append(s_{r}, {{'k': d_{r}, 'i': item_id}}) ELSE s_{r} END"
        for r in rules
    )
    whens = "".join(f" WHEN f_{r} IS NOT NULL THEN '{r}'" for r in rules)
    keyless = " AND ".join(f"{columns[r]} IS NULL" for r in rules) or "true"
    first = f"coalesce({', '.join(f'f_{r}' for r in rules)})" if rules else "NULL::BIGINT"
    ranks = f", {ranks}" if ranks else ""
    return f"""ordered AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY {order}) AS n, item_id, epoch(retrieved_at) AS t,
    dense_rank() OVER (ORDER BY normalized_title) AS d_title, {keyless} AS no_key{ranks} FROM {source}),
walk AS (
  SELECT 0::BIGINT AS n, NULL::BIGINT AS item_id, NULL::VARCHAR AS reason, NULL::BIGINT AS first_item_id,
    []::STRUCT(k BIGINT, t DOUBLE)[] AS s_title{lists}
  UNION ALL
  SELECT n, item_id, reason, first_item_id,
    CASE WHEN reason IS NULL THEN list_append(s_title, {{'k': d_title, 't': t}}) ELSE s_title END{grown}
  FROM (
    SELECT *, CASE{whens} WHEN no_key AND repeated THEN 'title' END AS reason, {first} AS first_item_id
    FROM (
      SELECT o.*, w.s_title{carry}{finds},
        len(list_filter(w.s_title, lambda e: e.k = o.d_title AND e.t <= o.t AND e.t >= o.t - 604800)) > 0 AS repeated
      FROM walk w JOIN ordered o ON o.n = w.n + 1)))"""


def _groups(hours: int) -> str:
    """One-at-a-time grouping: similar earlier items first, then a pass that keeps the founders."""
    cut = _trim("title")
    return f"""{COUNTS}, {RAW},
tops AS (SELECT doc_id AS item_id, list(token ORDER BY r) AS topics FROM ranked WHERE r <= 3 GROUP BY 1),
probes AS MATERIALIZED (
  SELECT item_id, title, retrieved_at, coalesce(published_at, retrieved_at) AS observed_at,
    coalesce(topics, []) AS topics, coalesce(topics[1], 'general') AS topic,
    row_number() OVER (ORDER BY retrieved_at, item_id) AS n
  FROM raw LEFT JOIN tops USING (item_id)),
pv AS (SELECT item_id, token, count(*) AS tf FROM (
  SELECT item_id, unnest({_tokens("title || chr(10) || topic")}) AS token FROM probes) GROUP BY 1, 2),
rv AS (SELECT item_id, token, count(*) AS tf FROM (
  SELECT item_id, unnest({_tokens(f"substr({cut}, 1, 512) || chr(10) || substr(topic, 1, 256)")}) AS token FROM probes)
  GROUP BY 1, 2),
pn AS (SELECT item_id, sum(tf * tf) AS q FROM pv GROUP BY 1),
rn AS (SELECT item_id, sum(tf * tf) AS q FROM rv GROUP BY 1),
near AS (
  SELECT i.item_id, f.item_id AS founder FROM (
    SELECT item_id, n, unnest(list_distinct(list_append(topics, topic))) AS topic FROM probes) i
  JOIN probes f ON f.topic = i.topic AND f.n < i.n
    AND f.observed_at >= TIMESTAMP '2024-01-31 00:00:00' - to_hours({hours})),
sims AS (
  SELECT item_id, founder, least(1.0, dot / (sqrt(pn.q) * sqrt(rn.q))) AS s
  FROM (SELECT near.item_id, near.founder, sum(pv.tf * rv.tf) AS dot FROM near
    JOIN pv ON pv.item_id = near.item_id JOIN rv ON rv.item_id = near.founder AND rv.token = pv.token GROUP BY 1, 2)
  JOIN pn USING (item_id) JOIN rn ON rn.item_id = founder),
edges AS (
  SELECT item_id, list({{'f': founder, 's': s}} ORDER BY s DESC, founder) AS e FROM sims WHERE s >= 0.78 GROUP BY 1),
steps AS MATERIALIZED (SELECT p.n, p.item_id, coalesce(e, []) AS e FROM probes p LEFT JOIN edges USING (item_id)),
walk AS (
  SELECT 0::BIGINT AS n, NULL::BIGINT AS item_id, NULL::BIGINT AS founder, NULL::DOUBLE AS s, []::BIGINT[] AS founders
  UNION ALL
  SELECT n, item_id, b.f, b.s, CASE WHEN b IS NULL THEN list_append(founders, item_id) ELSE founders END
  FROM (SELECT t.n, t.item_id, w.founders, list_filter(t.e, lambda x: list_contains(w.founders, x.f))[1] AS b
    FROM walk w JOIN steps t ON t.n = w.n + 1)),
grouped AS (SELECT item_id, coalesce(founder, item_id) AS update_id, s FROM walk WHERE n > 0)"""


GROUP_OUT = "SELECT item_id, update_id, round(s, 9) AS similarity FROM grouped"

ITEM_TOKENS = f"""body AS (
  SELECT item_id, {_tokens('title')} AS tt, {_tokens("concat_ws(chr(10), title, excerpt)")} AS ct FROM items),
bt AS (SELECT item_id, unnest(ct) AS token FROM body),
strengths AS (
  SELECT item_id, interest_id, count(*) / max(size) AS strength
  FROM (SELECT DISTINCT item_id, token FROM bt) JOIN iw USING (token) JOIN sizes USING (interest_id) GROUP BY 1, 2),
impacts AS (
  SELECT item_id, count(DISTINCT token) FILTER (token IN {_in(LEXICON)}) AS h FROM body LEFT JOIN bt USING (item_id) GROUP BY 1)"""


def _level(h: str) -> str:
    return f"CASE WHEN {h} >= 3 THEN 'high' WHEN {h} = 2 THEN 'medium' WHEN {h} = 1 THEN 'low' ELSE 'none' END"


def _points(matches: str) -> str:
    """Interest points per update from (update_id, interest_id, priority, strength)."""
    return f"""led AS (
  SELECT update_id, priority, strength, row_number() OVER (PARTITION BY update_id ORDER BY
    CASE priority WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 ELSE 1 END DESC, strength DESC) AS n FROM {matches}),
points AS (
  SELECT update_id, max(priority) FILTER (n = 1) AS lead,
    max(strength * CASE priority WHEN 'High' THEN 60 WHEN 'Medium' THEN 40 ELSE 20 END) FILTER (n = 1)
      + least(10, 5 * coalesce(sum(strength) FILTER (n > 1), 0)) AS interest_points
  FROM led GROUP BY 1)"""


def _recency(age_hours: str) -> str:
    return f"CASE WHEN {age_hours} <= 24 THEN 20.0 WHEN {age_hours} <= 72 THEN 12.0 WHEN {age_hours} <= 168 THEN 5.0 ELSE 0.0 END"


PART_SIGNALS = f"""active AS (
  SELECT u.*, i.priority FROM update_interests u JOIN interests i USING (interest_id) WHERE is_active AND strength > 0),
{_points('active')},
signals AS (
  SELECT p_partkey AS update_id, p_partkey % 200 - 5 AS age, p_size % 5 AS hosts, p_partkey % 4 AS lv FROM part),
parts AS (
  SELECT s.*, coalesce(interest_points, 0.0) AS interest, {_recency('age')} AS recency,
    CASE lv WHEN 0 THEN 20.0 WHEN 1 THEN 10.0 ELSE 0.0 END AS impact,
    CASE WHEN hosts >= 3 THEN 7.0 WHEN hosts = 2 THEN 4.0 ELSE 0.0 END AS support, lead
  FROM signals s LEFT JOIN points USING (update_id))"""

RUN_REPORT = """outcomes AS (
  SELECT o_custkey AS source_id, count(*) AS a, count(*) FILTER (o_orderstatus = 'F') AS n,
    count(*) FILTER (o_orderstatus <> 'F' AND o_orderkey % 40 = 0) AS f FROM orders GROUP BY 1),
report AS (
  SELECT c_custkey AS source_id, CASE WHEN quiet THEN 0 ELSE coalesce(a, 0) END AS retrieved_count,
    CASE WHEN quiet THEN 0 ELSE coalesce(n, 0) END AS new_count, CASE WHEN quiet THEN 0 ELSE coalesce(f, 0) END AS failed_count,
    CASE WHEN c_acctbal < -900 OR (NOT quiet AND coalesce(f, 0) > 0) THEN 'Failed'
      WHEN c_nationkey = 0 THEN 'NotModified' ELSE 'Succeeded' END AS status,
    CASE WHEN c_acctbal < -900 THEN 'request_timed_out' WHEN NOT quiet AND coalesce(f, 0) > 0 THEN 'feed_items_failed' END AS error_code
  FROM (SELECT *, c_nationkey = 0 AND NOT c_acctbal < -900 AS quiet FROM customer) c LEFT JOIN outcomes ON source_id = c_custkey)"""

OUTBOX = """outbox AS (
  SELECT o_orderkey AS message_id, o_orderdate AS created_at,
    CASE o_orderstatus WHEN 'F' THEN 'Dispatched' WHEN 'O' THEN 'Pending' ELSE 'Quarantined' END AS status,
    o_orderkey % 4 AS attempts,
    CASE WHEN o_orderkey % 4 > 0 THEN o_orderdate + to_minutes(o_orderkey % 90) END AS last_attempt_at,
    CASE WHEN o_orderkey % 5 = 1 THEN 'error ' || (o_orderkey % 9) END AS last_error FROM orders)"""

_page = _collapse(
    "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), "
    "'<[^>]*>', '', 'g'), '&copy;', '©', 'g'), '&middot;', '·', 'g'), '&quot;', '\"', 'g')"
)
ARTICLE = f"""article AS (
  SELECT page_id, url, {_collapse("replace(replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '&quot;', chr(34)), '&amp;', '&')")} AS title,
    replace({_page}, '&amp;', '&') AS text FROM pages)"""

_decoded = "replace(replace(replace(replace(html, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;', '&')"


def _strip(c: str) -> str:
    return rf"replace(regexp_replace({c}, '<(?:[\p{{L}}!?]|/\p{{L}})[^>]*>?', '', 'g'), '>', '')"


_bad_utc = "regexp_replace(url, '#.*$', '')"
_PAGE1 = "row_number() OVER (ORDER BY generated_at DESC, brief_id DESC)"
_BOX = "(a = 0 OR a = 10 OR (a = 100 AND b BETWEEN 64 AND 127) OR a = 127 OR (a = 168 AND b = 63 AND c = 129 AND d = 16) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 0 AND c IN (0, 2)) OR (a = 192 AND b = 88 AND c = 99) OR (a = 192 AND b = 168) OR (a = 198 AND b IN (18, 19)) OR (a = 198 AND b = 51 AND c = 100) OR (a = 203 AND b = 0 AND c = 113) OR a >= 224)"

ORACLES: dict[str, str] = {
    "parse_feeds": f"""WITH {FEED_FIELDS}, entries AS (
      SELECT doc_id AS source_id, 0 AS position, 'g' || doc_id AS external_id,
        'https://' || source || '.example.test/a/' || doc_id AS url, title, excerpt,
        TIMESTAMP '2024-01-01 15:30:00' AS published_at FROM parsed WHERE title <> ''
      UNION ALL
      SELECT doc_id, 1, 'n' || doc_id, NULL, 'Note ' || doc_id, NULL, NULL FROM parsed WHERE doc_id % 2 = 0)
      SELECT source_id, position, external_id, url, title, md5(excerpt) AS excerpt_digest, published_at,
        CASE WHEN excerpt IS NOT NULL THEN upper(sha256(title || chr(10) || excerpt)) END AS content_hash, NULL AS error_code
      FROM entries UNION ALL
      SELECT doc_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'malformed_feed' FROM documents WHERE doc_id % 31 = 0 OR doc_id % 37 = 0""",
    "classify_feeds": """SELECT doc_id AS source_id, NOT (doc_id % 31 <> 0 AND doc_id % 37 = 0) AS is_supported,
      CASE WHEN doc_id % 31 <> 0 AND doc_id % 37 = 0 THEN 'unsupported_root' END AS reason FROM documents""",
    "extract_articles": f"WITH {ARTICLE} SELECT page_id, title, text FROM article",
    "article_items": f"""WITH {ARTICLE} SELECT page_id, url, substr(title, 1, 800) AS title, substr(text, 1, 4000) AS excerpt,
      upper(sha256(text)) AS content_hash FROM article""",
    "unchanged_filter": "SELECT doc_id AS source_id, sha256(text) AS validator, doc_id % 3 = 0 AS not_modified FROM documents",
    "read_messages": """WITH m AS (
      SELECT *, CASE WHEN o_orderkey % 17 = 0 THEN 'not_json' WHEN o_orderkey % 13 = 0 THEN 'unknown_field'
        WHEN o_orderkey % 19 = 0 THEN 'wrong_type' WHEN o_orderkey % 11 = 0 THEN 'missing_field' END AS reason FROM orders)
      SELECT o_orderkey AS row_id, CASE WHEN reason IS NULL THEN 'm' || o_orderkey END AS message_id,
        CASE WHEN reason IS NULL THEN 'i' || o_orderkey END AS item_id, CASE WHEN reason IS NULL THEN 'c' || o_custkey END AS correlation_id,
        CASE WHEN reason IS NULL THEN date_trunc('day', o_orderdate) END AS occurred_at,
        CASE WHEN reason IS NULL AND o_orderkey % 3 > 0 THEN 's' || o_custkey END AS source_id, NULL AS run_id, reason FROM m""",
    "append_if_absent": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag FROM lineitem
      WHERE (l_orderkey, l_linenumber) NOT IN (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'A')
      QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_returnflag) = 1""",
    "write_snapshot": f"""WITH {BRIEFS}, {BRIEF_ITEMS}, done AS (SELECT brief_id FROM briefs WHERE status = 'Completed')
      SELECT 'briefs' AS kind, *, NULL::BIGINT AS update_id, NULL::INTEGER AS rank, NULL::DOUBLE AS score, NULL::VARCHAR AS title, NULL::BIGINT AS item_id
      FROM briefs WHERE status <> 'Generating'
      UNION ALL SELECT 'brief_items', brief_id, NULL, NULL, NULL, update_id, rank, score, title, NULL FROM brief_items JOIN done USING (brief_id)
      UNION ALL SELECT 'brief_item_sources', brief_id, NULL, NULL, NULL, update_id, NULL, NULL, NULL, item_id
      FROM brief_item_sources JOIN done USING (brief_id)""",
    "collapse_ws": f"SELECT doc_id, md5({_collapse('text')}) AS digest FROM documents",
    "clean_title": f"""WITH {RAW}, t AS (SELECT item_id, {_collapse('title')} AS c FROM raw), u AS (
      SELECT *, CASE WHEN c <> '' AND length(c) <= 800 THEN c END AS title FROM t)
      SELECT item_id, title, {_upper('title')} AS normalized_title,
        CASE WHEN c = '' THEN 'title_missing' WHEN length(c) > 800 THEN 'title_too_long' END AS error FROM u""",
    "clean_optional": f"SELECT doc_id, md5(nullif({_trim('text')}, '')) AS digest, length({_trim('text')}) > 4000 AS too_long FROM documents",
    "bounded_text": f"""SELECT page_id, substr({_collapse(_strip(_decoded))}, 1, 4000) AS text,
      md5({_collapse(_strip('html'))}) AS digest FROM pages""",
    "canonical_url": f"""SELECT page_id, {_bad_utc} AS url,
      CASE WHEN url LIKE 'https:%' THEN {_bad_utc} ELSE regexp_replace({_bad_utc}, '^(http://[^/]+)/', '\\1:443/') END AS with_port,
      NULL AS with_user, {_bad_utc} AS feed_url, NULL AS other_scheme FROM pages""",
    "resolve_url": """SELECT page_id, regexp_extract(url, '^https?://[^/]+') || '/a/' || page_id AS rooted, NULL AS mail, url AS same FROM pages""",
    "url_host": "SELECT page_id, lower(regexp_extract(url, '^https?://([^/]+)', 1)) AS host FROM pages",
    "is_public_host": f"""WITH o AS (SELECT event_id, event_id * 7 % 256 AS a, event_id % 256 AS b, event_id % 3 AS c, event_id % 251 AS d FROM events)
      SELECT event_id, a || '.' || b || '.' || c || '.' || d AS host, NOT {_BOX} AS is_public FROM o""",
    "parse_utc": """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN o_orderdate WHEN 1 THEN o_orderdate - to_hours(2)
      WHEN 2 THEN o_orderdate + to_hours(3) WHEN 3 THEN o_orderdate END AS parsed_at FROM orders""",
    "observed_at": f"WITH {RAW} SELECT item_id, coalesce(published_at, retrieved_at) AS observed_at FROM raw",
    "content_hash": f"""WITH {RAW} SELECT item_id, CASE WHEN {_trim('excerpt')} <> '' THEN upper(sha256(title || chr(10) || excerpt)) END AS content_hash FROM raw""",
    "url_hash": f"SELECT page_id, upper(sha256({_bad_utc})) AS url_hash FROM pages",
    "normalize_text": f"SELECT doc_id, md5({_collapse("replace(lower(text), 'ß', 'ss')")}) AS digest FROM documents",
    "tokenize": f"SELECT doc_id, len(t) AS n, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {_tokens('text')} AS t FROM documents)",
    "bigrams": f"""SELECT doc_id, len(p) AS n, md5(array_to_string(p, '|')) AS digest FROM (
      SELECT doc_id, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]) AS p FROM (SELECT doc_id, {_tokens('text')} AS t FROM documents))""",
    "bound_content": f"""WITH {RAW} SELECT item_id, md5(substr(concat_ws(chr(10), title, excerpt), 1, 20000)) AS digest,
      least(20000, length(concat_ws(chr(10), title, excerpt))) AS n FROM raw""",
    "parse_feedback": "SELECT event_id, CASE event_type WHEN 'purchase' THEN 'Relevant' WHEN 'error' THEN 'NotRelevant' END AS feedback_type FROM events",
    "normalize_name": """SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 OR c_custkey % 10 = 0 THEN NULL ELSE upper(c_name) || ' ß' END AS name,
      CASE WHEN c_custkey % 9 = 0 THEN 'name_missing' WHEN c_custkey % 10 = 0 THEN 'name_too_long' END AS error FROM customer""",
    "priority_lookups": """SELECT o_orderkey, CASE WHEN p IN ('1', '2') THEN 3 WHEN p = '3' THEN 2 ELSE 1 END AS rank,
      CASE WHEN p IN ('1', '2') THEN 60.0 WHEN p = '3' THEN 40.0 ELSE 20.0 END::DOUBLE AS weight,
      CASE o_orderstatus WHEN 'F' THEN 20.0 WHEN 'O' THEN 10.0 ELSE 0.0 END::DOUBLE AS impact_points
      FROM (SELECT *, left(o_orderpriority, 1) AS p FROM orders)""",
    "validate_items": f"""WITH {RAW} SELECT item_id, array_to_string(list_filter([
        CASE WHEN item_id % 23 = 0 THEN 'source_missing' END,
        CASE WHEN {_collapse('title')} = '' THEN 'title_missing' WHEN length({_collapse('title')}) > 800 THEN 'title_too_long' END,
        CASE WHEN length({_trim('excerpt')}) > 4000 THEN 'excerpt_too_long' END,
        CASE WHEN item_id % 11 = 0 THEN 'url_invalid' END,
        CASE WHEN item_id % 17 = 0 THEN 'retrieved_at_missing' END], lambda e: e IS NOT NULL), ',') AS errors FROM raw""",
    "clean_items": f"""WITH {RAW} SELECT item_id, external_id, url AS original_url, url AS canonical_url, upper(sha256(url)) AS url_hash,
      {_collapse('title')} AS title, {_upper(_collapse('title'))} AS normalized_title, 'Queued' AS status FROM raw
      WHERE {_collapse('title')} <> '' AND length({_collapse('title')}) <= 800 AND coalesce(length({_trim('excerpt')}), 0) <= 4000""",
    "validate_messages": """WITH m AS (
      SELECT a.o_orderkey AS message_id, a.o_orderkey - a.o_orderkey % 2 AS item_id, a.o_custkey AS c, a.o_orderstatus AS st, a.o_orderdate AS moment
      FROM orders a), j AS (
      SELECT m.*, i.o_orderkey AS known, i.o_custkey AS ic, i.o_orderpriority AS ip,
        r.o_orderkey IS NOT NULL AS received FROM m
      LEFT JOIN orders i ON i.o_orderkey = m.item_id AND i.o_orderpriority <> '5-LOW'
      LEFT JOIN orders r ON r.o_orderkey = m.item_id AND r.o_totalprice > 400000), d AS (
      SELECT *, CASE WHEN known IS NULL THEN 'item_missing'
        WHEN CASE WHEN item_id % 14 = 0 THEN 0 ELSE ic END <> c OR st = 'P' THEN 'reference_mismatch'
        WHEN ip LIKE '1%' THEN 'item_terminal' WHEN item_id % 10 = 4 THEN 'invalid_state'
        WHEN received THEN 'already_accepted' ELSE 'accepted' END AS disposition FROM j)
      SELECT message_id, item_id, CASE WHEN disposition = 'accepted' AND row_number() OVER (
        PARTITION BY item_id, disposition ORDER BY moment, message_id) > 1 THEN 'already_accepted' ELSE disposition END AS disposition FROM d""",
    "check_outbox": """SELECT 'm' || o_orderkey AS message_id, CASE WHEN o_orderpriority = '5-LOW' THEN 'wrong_destination'
      WHEN o_orderkey % 17 = 0 OR o_orderkey % 13 = 0 OR o_orderkey % 19 = 0 OR o_orderkey % 11 = 0 THEN 'unreadable_payload'
      WHEN o_orderstatus = 'P' THEN 'metadata_mismatch' END AS diagnostic FROM orders""",
    "duplicate_ids": "SELECT l_orderkey, l_linenumber, count(*) AS occurrences FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "validate_runs": """WITH r AS (
      SELECT o_orderkey AS run_id, o_orderdate AS s, o_orderdate + to_minutes(o_orderkey % 50 - 2) AS e, o_orderkey % 20 AS a, o_orderkey % 7 AS n,
        CASE WHEN o_orderstatus = 'P' THEN 'Failed' WHEN o_orderpriority = '1-URGENT' THEN 'NotModified' ELSE 'Succeeded' END AS status FROM orders)
      SELECT run_id, array_to_string(list_filter([CASE WHEN n > a THEN 'new_out_of_range' END,
        CASE WHEN status = 'NotModified' AND (a <> 0 OR n <> 0) THEN 'not_modified_with_items' END,
        CASE WHEN e < s THEN 'completed_before_start' END], lambda x: x IS NOT NULL), ',') AS errors,
        a AS bounded_retrieved, least(n, a) AS bounded_new, greatest(e, s) AS bounded_completed_at FROM r""",
    "validate_briefs": """WITH b AS (SELECT l_orderkey AS brief_id, l_partkey AS update_id, l_linenumber - 1 AS rank, l_tax > 0.07 AS nan FROM lineitem)
      SELECT brief_id, error, count(*) AS n FROM (
        SELECT brief_id, 'duplicate_rank' AS error FROM b GROUP BY brief_id, rank HAVING count(*) > 1
        UNION ALL SELECT brief_id, 'duplicate_update' FROM b GROUP BY brief_id, update_id HAVING count(*) > 1
        UNION ALL SELECT brief_id, 'rank_not_positive' FROM b WHERE rank < 1
        UNION ALL SELECT brief_id, 'score_not_finite' FROM b WHERE nan
        UNION ALL SELECT brief_id, 'no_source' FROM b WHERE (brief_id, update_id) NOT IN (
          SELECT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag <> 'R')) GROUP BY 1, 2""",
    "filtered_unique_violations": f"WITH {RAW} SELECT source_id, external_id, count(*) AS occurrences FROM raw WHERE external_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1",
    "validate_matches": """SELECT item_id, interest_id, strength, position FROM (
      SELECT user_id AS item_id, event_type AS interest_id, value / 50 AS strength, event_id AS position FROM events
      WHERE event_type IN ('click', 'view', 'purchase') QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1)
      WHERE strength BETWEEN 0 AND 1""",
    "dedup_external_id": f"""WITH {ITEMS} SELECT item_id FROM items WHERE external_id IS NULL UNION ALL SELECT item_id FROM (
      SELECT * FROM items WHERE external_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source_id, external_id ORDER BY retrieved_at, item_id) = 1)""",
    "dedup_url": f"""WITH {ITEMS} SELECT item_id FROM items WHERE url IS NULL UNION ALL SELECT item_id FROM (
      SELECT * FROM items WHERE url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY url ORDER BY retrieved_at, item_id) = 1)""",
    "dedup_content_hash": f"""WITH {ITEMS} SELECT item_id FROM items WHERE content_hash IS NULL UNION ALL SELECT item_id FROM (
      SELECT * FROM items WHERE content_hash IS NOT NULL QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY retrieved_at, item_id) = 1)""",
    "dedup_title_window": f"WITH RECURSIVE {ITEMS}, {_walk(())} SELECT item_id FROM walk WHERE n > 0 AND reason IS NULL",
    "dedup_items": f"""WITH RECURSIVE {ITEMS}, {_walk(('external_id', 'url', 'content_hash'))}
      SELECT item_id, reason, CASE WHEN reason <> 'title' THEN first_item_id END AS first_item_id FROM walk WHERE n > 0""",
    "dedup_items_stored": f"""WITH RECURSIVE {ITEMS}, phased AS (SELECT *, source_id < 'src3' AS late FROM items),
      {_walk(('external_id', 'url', 'content_hash'), 'late, retrieved_at, item_id', 'phased')}
      SELECT item_id, reason FROM walk JOIN phased USING (item_id) WHERE late""",
    "dedup_items_blank_keys": f"""WITH RECURSIVE {ITEMS}, blanked AS (SELECT * REPLACE ({BLANKED_KEYS}) FROM items),
      {_walk(('external_id', 'url', 'content_hash'), source='blanked')} SELECT item_id, reason FROM walk WHERE n > 0""",
    "dedup_articles_blank_keys": f"""WITH RECURSIVE {ITEMS}, blanked AS (SELECT * REPLACE ({BLANKED_KEYS}) FROM items),
      {_walk(('url', 'content_hash'), source='blanked')} SELECT item_id, reason FROM walk WHERE n > 0""",
    "term_frequencies": f"WITH {COUNTS} SELECT doc_id, token, tf FROM counts",
    "keyword_counts": f"WITH {COUNTS} SELECT doc_id, token, tf FROM words",
    "keywords": f"""WITH {COUNTS} SELECT d.doc_id, coalesce(k, '') AS keywords FROM documents d LEFT JOIN (
      SELECT doc_id, string_agg(token, ' ' ORDER BY r) AS k FROM ranked WHERE r <= 10 GROUP BY 1) USING (doc_id)""",
    "topics": f"""WITH {COUNTS} SELECT d.doc_id, coalesce(k, '') AS topics FROM documents d LEFT JOIN (
      SELECT doc_id, string_agg(token, ' ' ORDER BY r) AS k FROM ranked WHERE r <= 3 GROUP BY 1) USING (doc_id)""",
    "primary_topic": f"WITH {COUNTS} SELECT d.doc_id, coalesce(token, 'general') AS primary_topic FROM documents d LEFT JOIN (SELECT * FROM ranked WHERE r = 1) USING (doc_id)",
    "interest_match": f"""WITH {COUNTS}, {INTEREST_WORDS} SELECT doc_id AS item_id, interest_id, count(*) / max(size) AS strength
      FROM counts JOIN iw USING (token) JOIN sizes USING (interest_id) GROUP BY 1, 2""",
    "active_matches": f"""WITH {COUNTS}, {INTEREST_WORDS} SELECT doc_id AS item_id, interest_id, count(*) / max(size) AS strength, priority
      FROM counts JOIN iw USING (token) JOIN sizes USING (interest_id) JOIN interests USING (interest_id) WHERE is_active GROUP BY ALL""",
    "impact": f"""WITH {COUNTS}, h AS (SELECT d.doc_id AS item_id, count(token) FILTER (token IN {_in(LEXICON)}) AS h FROM documents d LEFT JOIN counts USING (doc_id) GROUP BY 1)
      SELECT item_id, {_level('h')} AS impact_level, least(1.0, h / 3.0)::DOUBLE AS impact_confidence FROM h""",
    "cosine_pairs": f"""WITH {COUNTS}, bc AS (SELECT item_id, token, count(*) AS tf FROM (
        SELECT item_id, unnest({_tokens('text')}) AS token FROM benchmark) GROUP BY 1, 2),
      bk AS (SELECT item_id, token FROM bc WHERE length(token) >= 3 AND token NOT IN {_in(STOP_WORDS)}
        QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY tf DESC, token) = 1),
      pairs AS (SELECT doc_id, item_id FROM ranked JOIN bk USING (token) WHERE r <= 3),
      dn AS (SELECT doc_id, sum(tf * tf) AS q FROM counts GROUP BY 1), bn AS (SELECT item_id, sum(tf * tf) AS q FROM bc GROUP BY 1)
      SELECT doc_id AS left_id, item_id AS right_id, round(least(1.0, dot / (sqrt(dn.q) * sqrt(bn.q))), 9) AS similarity FROM (
        SELECT p.doc_id, p.item_id, sum(c.tf * b.tf) AS dot FROM pairs p JOIN counts c ON c.doc_id = p.doc_id
        JOIN bc b ON b.item_id = p.item_id AND b.token = c.token GROUP BY 1, 2) JOIN dn USING (doc_id) JOIN bn USING (item_id)""",
    "best_match": """SELECT item_id, update_id, similarity FROM (
      SELECT DISTINCT l_orderkey AS item_id, l_partkey AS update_id, l_quantity / 50 AS similarity FROM lineitem)
      QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY similarity DESC, update_id) = 1""",
    "group_items": f"WITH RECURSIVE {_groups(168)} {GROUP_OUT}",
    "group_items_month": f"WITH RECURSIVE {_groups(744)} {GROUP_OUT}",
    "upsert_matches": f"""WITH {COUNTS}, {INTEREST_WORDS}, {RAW} SELECT md5({_upper(_collapse('title'))}) AS update_id, interest_id,
      max(strength) AS strength, max(retrieved_at) AS matched_at FROM (
        SELECT doc_id AS item_id, interest_id, count(*) / max(size) AS strength FROM counts JOIN iw USING (token) JOIN sizes USING (interest_id) GROUP BY 1, 2)
      JOIN raw USING (item_id) GROUP BY 1, 2""",
    "update_windows": f"""WITH {SUPPLY} SELECT l_partkey AS update_id, min(coalesce(published_at, TIMESTAMP '2002-01-01 00:00:00')) AS first_observed_at,
      max(coalesce(published_at, TIMESTAMP '2002-01-01 00:00:00')) AS last_observed_at FROM supply GROUP BY 1""",
    "scoring_signals": f"""WITH {SUPPLY} SELECT l_partkey AS update_id, max(coalesce(published_at, TIMESTAMP '2002-01-01 00:00:00')) AS newest_at,
      count(DISTINCT s_suppkey % 8) AS host_count FROM supply LEFT JOIN supplier ON s_suppkey = source_id AND s_suppkey % 25 > 0 GROUP BY 1""",
    "commit_outcomes": """SELECT o_orderkey AS receipt_id, o_custkey AS item_id, CASE WHEN c_custkey IS NULL THEN 'SkippedItemMissing'
      WHEN c_mktsegment = 'MACHINERY' OR s_suppkey IS NOT NULL THEN 'SkippedAlreadyHandled' ELSE 'Grouped' END AS outcome FROM orders
      LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0 LEFT JOIN supplier ON s_suppkey = o_custkey""",
    "interest_points": f"WITH {UPDATE_INTERESTS}, {INTEREST_ROWS}, {PART_SIGNALS} SELECT update_id, round(interest_points, 9) AS interest_points FROM points",
    "signal_points": f"WITH {UPDATE_INTERESTS}, {INTEREST_ROWS}, {PART_SIGNALS} SELECT update_id, recency::DOUBLE AS recency, impact::DOUBLE AS impact, support::DOUBLE AS support FROM parts",
    "score_updates": f"""WITH {UPDATE_INTERESTS}, {INTEREST_ROWS}, {PART_SIGNALS} SELECT update_id, round(interest + recency + impact + support, 6) AS score,
      interest + recency + impact + support >= 55 AS meets_threshold FROM parts""",
    "explain_scores": f"""WITH {UPDATE_INTERESTS}, {INTEREST_ROWS}, {PART_SIGNALS} SELECT update_id, name, points, explanation FROM (
      SELECT update_id, 'Interest' AS name, round(interest, 6) AS points,
        coalesce('Highest-priority matched interest ' || lead, 'No matched active interests') AS explanation FROM parts
      UNION ALL SELECT update_id, 'Recency', recency::DOUBLE, CASE WHEN age <= 24 THEN 'Newest supporting source within 24h.'
        WHEN age <= 72 THEN 'Newest supporting source within 72h.' WHEN age <= 168 THEN 'Newest supporting source within 168h.'
        ELSE 'Newest supporting source older than 168h.' END FROM parts
      UNION ALL SELECT update_id, 'Impact', impact::DOUBLE, CASE lv WHEN 0 THEN 'High analyzed impact.' WHEN 1 THEN 'Medium analyzed impact.'
        ELSE 'Low or unknown analyzed impact.' END FROM parts
      UNION ALL SELECT update_id, 'SourceSupport', support::DOUBLE, CASE WHEN hosts >= 2 THEN hosts || ' distinct supporting hosts.'
        ELSE 'Single supporting host.' END FROM parts)""",
    "run_report": f"WITH {RUN_REPORT} SELECT * FROM report",
    "job_summary": f"""WITH {RUN_REPORT} SELECT count(*) AS enabled_sources, count(*) FILTER (status <> 'Failed') AS succeeded_sources,
      count(*) FILTER (status = 'Failed') AS failed_sources, sum(new_count)::BIGINT AS new_items,
      count(*) > 0 AND count(*) FILTER (status <> 'Failed') = 0 AS all_failed FROM report""",
    "latest_run_per_source": """WITH r AS (
      SELECT o_orderkey AS run_id, o_custkey AS source_id, o_orderdate + to_minutes(o_orderkey % 50 - 2) AS completed_at,
        CASE WHEN o_orderstatus = 'P' THEN 'Failed' WHEN o_orderpriority = '1-URGENT' THEN 'NotModified' ELSE 'Succeeded' END AS status,
        CASE WHEN o_orderkey % 3 > 0 THEN 'v' || (o_orderkey % 11) END AS validator FROM orders),
      l AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY completed_at DESC, run_id DESC) = 1),
      v AS (SELECT * FROM r WHERE status = 'Succeeded' OR (status = 'NotModified' AND validator IS NOT NULL)
        QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY completed_at DESC, run_id DESC) = 1)
      SELECT l.source_id, l.completed_at AS last_ingestion_at, l.status AS last_status, v.validator FROM l LEFT JOIN v USING (source_id)""",
    "apply_failures": """WITH RECURSIVE known AS (
      SELECT DISTINCT user_id AS item_id, CASE user_id % 4 WHEN 0 THEN 'Processed' WHEN 1 THEN 'FailedRetryable' ELSE 'Queued' END AS status,
        CASE user_id % 4 WHEN 1 THEN 2 ELSE 0 END AS failure_count FROM events),
      f AS (SELECT user_id AS item_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, 'code' || (event_id % 10) AS code,
        event_type = 'error' AND value > 60 AS bad FROM events WHERE event_type IN ('error', 'click')),
      s AS (
        SELECT item_id, 0::BIGINT AS n, status, failure_count, NULL::VARCHAR AS code FROM known
        UNION ALL
        SELECT s.item_id, f.n, CASE WHEN f.bad OR s.failure_count + 1 >= 5 THEN 'FailedTerminal' ELSE 'FailedRetryable' END, s.failure_count + 1, f.code
        FROM s JOIN f ON f.item_id = s.item_id AND f.n = s.n + 1 WHERE s.status NOT IN ('Processed', 'Filtered', 'FailedTerminal'))
      SELECT item_id, status, failure_count, code AS last_failure_code FROM s QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY n DESC) = 1""",
    "mark_processed": """WITH l AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 25)
      SELECT p_partkey AS item_id, CASE p_partkey % 5 WHEN 0 THEN 'Filtered' WHEN 1 THEN 'FailedTerminal' WHEN 2 THEN 'Processed'
        ELSE CASE WHEN l_partkey IS NULL THEN 'Queued' ELSE 'Processed' END END AS status,
        CASE WHEN l_partkey IS NOT NULL AND p_partkey % 5 IN (0, 1) THEN 'illegal_transition' END AS error FROM part LEFT JOIN l ON l_partkey = p_partkey""",
    "pending": f"""WITH {OUTBOX} SELECT message_id, created_at, last_attempt_at FROM outbox WHERE status = 'Pending'
      AND (last_attempt_at IS NULL OR last_attempt_at <= TIMESTAMP '1996-12-31 23:59:30') ORDER BY created_at, message_id LIMIT 20""",
    "quarantine_report": f"""WITH {OUTBOX}, e AS (SELECT status, last_error FROM outbox WHERE last_error IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY status ORDER BY last_attempt_at DESC NULLS LAST, message_id DESC) = 1)
      SELECT status, count(*) AS messages, sum(attempts)::BIGINT AS attempts, count(o.last_error) AS with_error, any_value(e.last_error) AS last_error
      FROM outbox o LEFT JOIN e USING (status) GROUP BY status""",
    "brief_window": f"""WITH {BRIEFS} SELECT max(generated_at) AS window_start, TIMESTAMP '2024-01-31 00:00:00' AS window_end, 'latest' AS kind FROM briefs
      WHERE status = 'Completed' UNION ALL SELECT TIMESTAMP '2024-01-24 00:00:00', TIMESTAMP '2024-01-31 00:00:00', 'lookback'""",
    "eligible_updates": f"WITH {ELIGIBLE} SELECT update_id, round(score, 6) AS score FROM eligible",
    "select_brief": f"""WITH {ELIGIBLE} SELECT update_id, row_number() OVER (ORDER BY eligible.score DESC, update_id) AS rank, round(eligible.score, 6) AS score,
      (SELECT count(*) FROM eligible) AS candidate_count FROM eligible ORDER BY eligible.score DESC, update_id LIMIT 5""",
    "select_brief_per_audience": f"WITH {ELIGIBLE} SELECT brief_id, update_id, rank, round(score, 6) AS score, candidate_count FROM picked",
    "generation_inputs": f"WITH {REQUESTS} SELECT brief_id, update_id, primary_topic, sources, interests FROM text",
    "clamp_request": f"""WITH {RAW} SELECT item_id, md5(substr(title, 1, 512)) AS title, md5(substr(excerpt, 1, 2000)) AS excerpt,
      md5(substr(title, 1, 200)) AS topic, source_id AS name FROM raw""",
    "compose": f"WITH {REQUESTS} SELECT brief_id, update_id, title, summary, why_relevant FROM text",
    "complete_brief": f"""WITH {REQUESTS} SELECT b.p_brand AS brief_id, 'Completed' AS status, coalesce(c, 0) AS candidate_count, coalesce(s, 0) AS selected_count
      FROM (SELECT DISTINCT p_brand FROM part) b LEFT JOIN (SELECT brief_id, max(candidate_count) AS c FROM picked GROUP BY 1) p ON p.brief_id = b.p_brand
      LEFT JOIN (SELECT brief_id, count(*) AS s FROM text WHERE primary_topic <> 'PROMO' GROUP BY 1) t ON t.brief_id = b.p_brand""",
    "complete_brief_items": f"""WITH {REQUESTS}, n AS (SELECT l_partkey, count(*) AS sources FROM supply GROUP BY 1)
      SELECT brief_id, update_id, row_number() OVER (PARTITION BY brief_id ORDER BY text.rank) AS rank, round(score, 6) AS score, title, primary_topic AS topic, n.sources
      FROM text JOIN n ON l_partkey = update_id WHERE primary_topic <> 'PROMO'""",
    "fail_orphans": f"""WITH {BRIEFS} SELECT brief_id, CASE WHEN o THEN 'Failed' ELSE status END AS status, CASE WHEN o THEN 0 ELSE selected_count END AS selected_count
      FROM (SELECT *, status = 'Generating' AND generated_at < TIMESTAMP '1996-01-01' AS o FROM briefs)""",
    "brief_view": f"""WITH {BRIEFS}, {BRIEF_ITEMS}, {FEEDBACK}, {SAVES} SELECT i.brief_id, i.update_id, i.rank, round(i.score, 6) AS score, i.title,
      CASE feedback_type WHEN 'Relevant' THEN 'relevant' WHEN 'NotRelevant' THEN 'notRelevant' END AS latest_feedback, v.update_id IS NOT NULL AS is_saved,
      s.item_id AS source_item_id FROM briefs b JOIN brief_items i USING (brief_id) JOIN brief_item_sources s ON s.brief_id = i.brief_id AND s.update_id = i.update_id
      LEFT JOIN latest l ON l.update_id = i.update_id LEFT JOIN saved v ON v.update_id = i.update_id WHERE b.status = 'Completed'""",
    "current_brief": f"""WITH {BRIEFS}, {BRIEF_ITEMS}, {FEEDBACK}, {SAVES}, b AS (
        SELECT brief_id FROM briefs WHERE status = 'Completed' ORDER BY generated_at DESC, brief_id DESC LIMIT 1)
      SELECT i.brief_id, i.update_id, i.rank, round(i.score, 6) AS score, i.title,
      CASE feedback_type WHEN 'Relevant' THEN 'relevant' WHEN 'NotRelevant' THEN 'notRelevant' END AS latest_feedback, v.update_id IS NOT NULL AS is_saved,
      s.item_id AS source_item_id FROM b JOIN brief_items i USING (brief_id) JOIN brief_item_sources s ON s.brief_id = i.brief_id AND s.update_id = i.update_id
      LEFT JOIN latest l ON l.update_id = i.update_id LEFT JOIN saved v ON v.update_id = i.update_id""",
    "brief_history": f"""WITH {BRIEFS}, p AS (SELECT *, {_PAGE1} AS n, count(*) OVER () AS total FROM briefs)
      SELECT CASE WHEN n <= 20 THEN 1 ELSE 2 END AS page, brief_id, generated_at, status, (n - 1) % 20 + 1 AS position,
      total > CASE WHEN n <= 20 THEN 20 ELSE 40 END AS has_more FROM p WHERE n <= 40""",
    "record_feedback": """SELECT event_id AS feedback_id, CASE WHEN s_suppkey IS NULL THEN 'update_not_found'
      WHEN b IS NOT NULL AND (c_custkey IS NULL OR c_custkey <> user_id) THEN 'brief_item_not_found' END AS reason
      FROM (SELECT *, CASE WHEN event_id % 3 > 0 THEN user_id + event_id % 2 END AS b FROM events)
      LEFT JOIN supplier ON s_suppkey = user_id LEFT JOIN customer ON c_custkey = b""",
    "latest_feedback": f"WITH {FEEDBACK} SELECT * FROM latest",
    "clear_feedback": f"""WITH {FEEDBACK}, c AS (SELECT user_id AS update_id, ts, event_id FROM events WHERE event_type = 'view'
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
      SELECT f.feedback_id, f.update_id, f.feedback_type, f.created_at FROM feedback f LEFT JOIN c USING (update_id)
      WHERE c.ts IS NULL OR (f.created_at, f.feedback_id) > (c.ts, c.event_id)""",
    "apply_saves": f"WITH {SAVES} SELECT update_id, saved_at FROM saved WHERE update_id IN (SELECT s_suppkey FROM supplier)",
    "record_opens": """SELECT event_id, EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = user_id AND l_suppkey = event_id % 100 + 1) AS accepted
      FROM events WHERE event_type = 'click'""",
    "grouped_duplicates": f"WITH {LINKS} SELECT greatest(0, count(*) - count(DISTINCT update_id)) AS grouped_duplicates FROM links",
    "feedback_tally": f"""WITH {FEEDBACK} SELECT count(*) FILTER (feedback_type = 'Relevant') AS relevant_feedback,
      count(*) FILTER (feedback_type = 'NotRelevant') AS not_relevant_feedback FROM latest""",
    "items_per_brief": """SELECT (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS completed_briefs, count(*) AS items_selected,
      round(count(*) / (SELECT count(*) FROM orders WHERE o_orderstatus = 'F'), 9) AS items_per_brief
      FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F'""",
    "source_distribution": f"""WITH {SUPPLY}, chosen AS (SELECT DISTINCT l_partkey * 100000 + l_suppkey AS item_id FROM lineitem
        JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F')
      SELECT source_id, coalesce(s_name, '') AS source_name, count(*) AS ingested_items, count(chosen.item_id) AS selected_items
      FROM supply LEFT JOIN chosen USING (item_id) LEFT JOIN supplier ON s_suppkey = source_id AND s_suppkey % 25 > 0
      WHERE source_id IS NOT NULL GROUP BY 1, 2""",
    "evaluation_summary": f"""WITH {LINKS}, {FEEDBACK}, {SAVES}, picked AS (
        SELECT count(*) AS n, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS b FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F')
      SELECT (SELECT count(*) FROM links) AS items_ingested, b AS completed_briefs, n AS items_selected, round(n / b, 9) AS items_per_brief,
        (SELECT count(*) - count(DISTINCT update_id) FROM links) AS grouped_duplicates,
        (SELECT count(*) FROM latest WHERE feedback_type = 'Relevant') AS relevant_feedback,
        (SELECT count(*) FROM latest WHERE feedback_type = 'NotRelevant') AS not_relevant_feedback,
        (SELECT count(*) FROM events WHERE event_type = 'click') AS source_opens, (SELECT count(*) FROM saved) AS saves FROM picked""",
    "list_sources": """WITH s AS (SELECT DISTINCT source AS source_id, source AS name, 'https://' || source || '.example.test/rss' AS feed_url,
        CAST(substr(source, 4) AS INT) % 9 <> 0 AS is_enabled FROM documents)
      SELECT *, 'all' AS kind FROM s UNION ALL SELECT *, 'enabled' FROM s WHERE is_enabled""",
    "list_interests": """WITH s AS (SELECT c_mktsegment AS interest_id, c_mktsegment AS name, count(*) AS n, c_mktsegment <> 'MACHINERY' AS is_active FROM customer GROUP BY ALL)
      SELECT *, 'all' AS kind FROM s UNION ALL SELECT *, 'active' FROM s WHERE is_active""",
    "late_items": f"WITH {RAW} SELECT item_id FROM raw WHERE coalesce(published_at, retrieved_at) < retrieved_at - to_hours(48)",
}

_PROBES = f"""{COUNTS}, {RAW},
tops AS (SELECT doc_id AS item_id, list(token ORDER BY r) AS topics FROM ranked WHERE r <= 3 GROUP BY 1),
probes AS (
  SELECT item_id, title, coalesce(published_at, retrieved_at) AS observed_at, coalesce(topics, []) AS topics,
    coalesce(topics[1], 'general') AS topic FROM raw LEFT JOIN tops USING (item_id)),
cand AS (
  SELECT i.item_id, u.item_id AS update_id, row_number() OVER (PARTITION BY i.item_id ORDER BY u.observed_at DESC, u.item_id) AS position
  FROM (SELECT item_id, unnest(list_distinct(list_append(topics, topic))) AS topic FROM probes) i
  JOIN probes u ON u.topic = i.topic AND u.observed_at >= TIMESTAMP '2024-01-24 00:00:00' QUALIFY position <= 25)"""

ORACLES["candidate_updates"] = f"WITH {_PROBES} SELECT item_id, update_id, position FROM cand"

ORACLES["assign_to_updates"] = f"""WITH {_PROBES},
pv AS (SELECT item_id, token, count(*) AS tf FROM (SELECT item_id, unnest({_tokens("title || chr(10) || topic")}) AS token FROM probes) GROUP BY 1, 2),
rv AS (SELECT item_id, token, count(*) AS tf FROM (
  SELECT item_id, unnest({_tokens(f"substr({_trim('title')}, 1, 512) || chr(10) || substr(topic, 1, 256)")}) AS token FROM probes) GROUP BY 1, 2),
pn AS (SELECT item_id, sum(tf * tf) AS q FROM pv GROUP BY 1), rn AS (SELECT item_id, sum(tf * tf) AS q FROM rv GROUP BY 1),
sims AS (
  SELECT item_id, update_id, least(1.0, dot / (sqrt(pn.q) * sqrt(rn.q))) AS s FROM (
    SELECT c.item_id, c.update_id, sum(pv.tf * rv.tf) AS dot FROM cand c JOIN pv ON pv.item_id = c.item_id
    JOIN rv ON rv.item_id = c.update_id AND rv.token = pv.token GROUP BY 1, 2)
  JOIN pn USING (item_id) JOIN rn ON rn.item_id = update_id),
best AS (SELECT * FROM sims QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY s DESC, update_id) = 1)
SELECT p.item_id, b.update_id, round(b.s, 9) AS similarity FROM probes p LEFT JOIN (SELECT * FROM best WHERE s >= 0.78) b USING (item_id)"""

ORACLES["assign_to_updates_uncapped"] = ORACLES["assign_to_updates"].replace(" QUALIFY position <= 25", "")

ORACLES["assign_by_index"] = ORACLES["assign_to_updates_uncapped"]

ORACLES["process_messages"] = """WITH d AS (
  SELECT doc_id AS n, doc_id::VARCHAR AS item_id, string_split(text, chr(10))[1] AS title,
    CASE WHEN contains(text, chr(10)) THEN substr(text, instr(text, chr(10)) + 1) END AS excerpt FROM documents),
s AS (SELECT *, unnest(CASE WHEN n % 10 = 0 THEN ['m', 'n'] ELSE ['m'] END) AS k FROM d),
j AS (SELECT *, CASE WHEN n % 17 = 0 THEN 'malformed' WHEN n % 13 = 0 THEN 'item_missing' WHEN n % 11 = 0 THEN 'reference_mismatch'
  WHEN n % 9 = 0 THEN 'item_terminal' WHEN n % 23 = 0 OR k = 'n' THEN 'already_accepted' ELSE 'accepted' END AS disposition FROM s),
o AS (SELECT *, CASE WHEN disposition = 'accepted' THEN CASE WHEN n % 7 = 0 THEN 'SkippedAlreadyHandled' ELSE 'Grouped' END END AS outcome,
  length(title) > 512 OR length(coalesce(excerpt, '')) > 4000 AS long FROM j),
done AS (SELECT item_id, bool_or(outcome = 'Grouped') AS due FROM o GROUP BY 1)
SELECT k || item_id AS row_id, disposition, outcome,
  CASE WHEN n % 17 = 0 OR n % 13 = 0 THEN NULL WHEN n % 9 = 0 THEN 'Processed' WHEN due AND long THEN 'FailedTerminal'
    WHEN due THEN 'Processed' ELSE 'Queued' END AS status,
  CASE WHEN n % 17 = 0 OR n % 13 = 0 THEN NULL WHEN due AND long THEN 1 ELSE 0 END AS failure_count,
  CASE WHEN n % 17 <> 0 AND n % 13 <> 0 AND due AND long THEN 'IntelligenceValidation' END AS last_failure_code
FROM o JOIN done USING (item_id)"""

_DESCRIPTORS = """pairs AS (
  SELECT item_id, list_concat(list_transform(range(1, len(tt)), lambda i: tt[i] || ' ' || tt[i + 1]),
    list_transform(range(1, len(ct)), lambda i: ct[i] || ' ' || ct[i + 1])) AS p FROM body),
firsts AS (
  SELECT item_id, pair, min(pos) AS pos FROM (SELECT item_id, unnest(p) AS pair, generate_subscripts(p, 1) AS pos FROM pairs) GROUP BY 1, 2),
descriptors AS (
  SELECT item_id, string_agg(pair, '|' ORDER BY pos) AS d FROM (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY pos) AS n FROM firsts) WHERE n <= 5 GROUP BY 1)"""

ORACLES["event_descriptors"] = f"""WITH {ITEMS}, {INTEREST_WORDS}, {ITEM_TOKENS}, {_DESCRIPTORS}
SELECT item_id, coalesce(d, '') AS descriptors FROM items LEFT JOIN descriptors USING (item_id)"""

ORACLES["analyze"] = f"""WITH {ITEMS}, {INTEREST_WORDS}, {ITEM_TOKENS}, {_DESCRIPTORS},
kw AS (SELECT item_id, token, row_number() OVER (PARTITION BY item_id ORDER BY count(*) DESC, token) AS r FROM bt
  WHERE length(token) >= 3 AND token NOT IN {_in(STOP_WORDS)} GROUP BY 1, 2),
ks AS (SELECT item_id, string_agg(token, ' ' ORDER BY r) FILTER (r <= 10) AS k, string_agg(token, ' ' ORDER BY r) FILTER (r <= 3) AS t FROM kw GROUP BY 1),
ms AS (SELECT item_id, string_agg(interest_id || ':' || round(strength, 4)::DECIMAL(10, 4), ' ' ORDER BY interest_id) AS m
  FROM strengths JOIN interests USING (interest_id) WHERE is_active GROUP BY 1)
SELECT item_id, language, coalesce(k, '') AS keywords, coalesce(t, '') AS topics, coalesce(d, '') AS descriptors, coalesce(m, '') AS interest_matches,
  {_level('h')} AS impact_level, round(least(1.0, h / 3.0)::DOUBLE, 9) AS impact_confidence, 'analyze-1' AS analyzer_version
FROM items LEFT JOIN ks USING (item_id) LEFT JOIN descriptors USING (item_id) LEFT JOIN ms USING (item_id) JOIN impacts USING (item_id)"""


def _scores(prefix: str, link: str) -> str:
    """Scores of updates from item facts and a link table (update_id, item_id)."""
    return f"""{prefix}, {INTEREST_WORDS}, {ITEM_TOKENS},
um AS (SELECT update_id, interest_id, max(strength) AS strength FROM strengths JOIN {link} USING (item_id) GROUP BY 1, 2),
active AS (SELECT um.*, priority FROM um JOIN interests USING (interest_id) WHERE is_active),
{_points('active')},
sig AS (
  SELECT update_id, max(coalesce(published_at, retrieved_at)) AS newest, count(DISTINCT source_id) AS hosts,
    arg_max(h, (retrieved_at, item_id)) AS h FROM {link} JOIN items USING (item_id) JOIN impacts USING (item_id) GROUP BY 1),
aged AS (SELECT *, epoch(TIMESTAMP '2024-01-31 00:00:00' - newest) / 3600 AS age FROM sig),
scores AS (
  SELECT update_id, coalesce(interest_points, 0.0) + {_recency('age')} + CASE WHEN h >= 3 THEN 20.0 WHEN h = 2 THEN 10.0 ELSE 0.0 END
    + CASE WHEN hosts >= 3 THEN 7.0 WHEN hosts = 2 THEN 4.0 ELSE 0.0 END AS score FROM aged LEFT JOIN points USING (update_id))"""


_GROUP_ITEMS = ITEMS.split(", items AS", 1)[1]
_ANALYZED_TOPICS = _groups(744).replace(
    COUNTS + ", " + RAW + ",",
    f"{RAW}, items AS{_GROUP_ITEMS}, counts AS (SELECT item_id AS doc_id, token, count(*) AS tf FROM (SELECT item_id, "
    f"unnest({_tokens('concat_ws(chr(10), title, excerpt)')}) AS token FROM items) GROUP BY 1, 2),"
    + COUNTS.split("GROUP BY doc_id, token),", 1)[1] + ",",
)

ORACLES["relevance_scores"] = f"""WITH RECURSIVE {_scores(_ANALYZED_TOPICS, 'grouped')}
SELECT update_id, round(score, 6) AS score, score >= 55 AS meets_threshold FROM scores"""

ORACLES["top_items"] = f"""WITH {_scores(ITEMS, 'singles')}
SELECT row_number() OVER (ORDER BY scores.score DESC, update_id) AS rank, update_id, round(scores.score, 6) AS score,
  count(*) OVER () AS candidate_count FROM scores WHERE score >= 55 QUALIFY rank <= 5""".replace(
    INTEREST_WORDS, "singles AS (SELECT item_id AS update_id, item_id FROM items), " + INTEREST_WORDS, 1
)

ORACLES["generate_brief"] = f"""WITH {REQUESTS.replace('''PARTITION BY brand ORDER BY score''', '''ORDER BY score''').replace('''count(*) OVER (PARTITION BY brand)''', '''count(*) OVER ()''').replace('''SELECT brand AS brief_id''', '''SELECT 'next' AS brief_id''')}
SELECT brief_id, update_id, rank, round(score, 6) AS score, title, summary, why_relevant FROM text"""

ORACLES["stream_latest_feedback"] = ORACLES["latest_feedback"]
ORACLES["stream_items"] = (
    f"WITH RECURSIVE {ITEMS}, {_walk(('external_id', 'url', 'content_hash'))} SELECT item_id FROM walk WHERE n > 0 AND reason IS NULL"
)
# Four batches; the entries of every second feed come again in the next one.
ORACLES["stream_feeds"] = f"""WITH RECURSIVE {FEED_FIELDS}, entries AS (
  SELECT doc_id AS source_id, 0 AS position, 'g' || doc_id AS external_id, 'https://' || source || '.example.test/a/' || doc_id AS url,
    title, excerpt FROM parsed WHERE title <> ''
  UNION ALL SELECT doc_id, 1, 'n' || doc_id, NULL, 'Note ' || doc_id, NULL FROM parsed WHERE doc_id % 2 = 0),
turns AS (
  SELECT doc_id AS source_id, unnest(CASE WHEN doc_id % 8 < 4 AND doc_id % 4 < 3 THEN [doc_id % 4, doc_id % 4 + 1] ELSE [doc_id % 4] END) AS turn
  FROM documents),
polled AS (SELECT *, TIMESTAMP '2024-01-01 00:00:00' + to_hours(turn::INTEGER) AS retrieved_at FROM entries JOIN turns USING (source_id)),
items AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY turn, sha256(concat_ws(chr(31), source_id::VARCHAR, retrieved_at::VARCHAR, position::VARCHAR))) AS item_id,
    source_id, external_id, url AS url_hash, turn, retrieved_at, upper(title) AS normalized_title,
    CASE WHEN excerpt IS NOT NULL THEN upper(sha256(title || chr(10) || excerpt)) END AS content_hash FROM polled),
{_walk(('external_id', 'url', 'content_hash'))}
SELECT source_id, external_id, turn::INTEGER AS batch_id FROM walk JOIN items USING (item_id) WHERE n > 0 AND reason IS NULL"""
ORACLES["stream_groups"] = ORACLES["relevance_scores"]
ORACLES["stream_late_items"] = f"""WITH {RAW}, timed AS (
  SELECT item_id, item_id // 7 % 4 AS turn, coalesce(published_at, retrieved_at) AS observed_at FROM raw),
highs AS (SELECT turn, max(max(observed_at)) OVER (ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM timed GROUP BY turn)
SELECT item_id, coalesce(observed_at < high - to_hours(48), false) AS late FROM timed JOIN highs USING (turn)"""
ORACLES["stream_feedback_with_clears"] = f"""WITH {FEEDBACK}, c AS (
  SELECT user_id AS update_id, ts, event_id FROM events WHERE event_type = 'view'
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT l.* FROM latest l LEFT JOIN c USING (update_id) WHERE c.ts IS NULL OR (l.created_at, l.feedback_id) > (c.ts, c.event_id)"""


def _article_outcomes(source: str) -> str:
    """CTEs after a walk over ``source``: for a repeat by its title also a kept item it repeats, the first of its own aligned
    week if that came before, else the last of the week before."""
    return f"""timed AS (SELECT item_id, normalized_title AS nt, retrieved_at AS seen, floor(epoch(retrieved_at) / 604800) AS week FROM {source}),
kept AS (SELECT t.* FROM timed t JOIN walk USING (item_id) WHERE n > 0 AND reason IS NULL),
ends AS (SELECT nt, week, min({{'seen': seen, 'id': item_id}}) AS first, max({{'seen': seen, 'id': item_id}}) AS last FROM kept GROUP BY ALL),
told AS (
  SELECT w.item_id, reason IS NOT NULL AS is_duplicate, reason, CASE
    WHEN reason <> 'title' THEN first_item_id
    WHEN e.first < {{'seen': t.seen, 'id': t.item_id}} THEN e.first.id
    WHEN p.last.seen >= t.seen - INTERVAL 7 DAY THEN p.last.id END AS existing_item_id
  FROM walk w JOIN timed t USING (item_id) LEFT JOIN ends e ON reason = 'title' AND e.nt = t.nt AND e.week = t.week
    LEFT JOIN ends p ON reason = 'title' AND p.nt = t.nt AND p.week = t.week - 1 WHERE n > 0)"""


ORACLES["dedup_articles"] = f"""WITH RECURSIVE {ITEMS}, {_walk(('url', 'content_hash'))}, {_article_outcomes('items')}
SELECT item_id, is_duplicate, reason, existing_item_id FROM told"""
ORACLES["ingest_articles"] = f"""WITH RECURSIVE {ARTICLE}, addressed AS (
  SELECT page_id, title, text, CASE WHEN page_id % 9 = 4 THEN 'host_not_public' WHEN page_id % 9 = 5 THEN 'url_invalid' END AS refused,
    CASE WHEN page_id % 5 = 1 THEN 'https://again.example/' || page_id // 10 ELSE 'https://one.example/' || page_id END AS url FROM article),
items AS MATERIALIZED (
  SELECT page_id AS item_id, NULL::VARCHAR AS source_id, NULL::VARCHAR AS external_id, upper(sha256(url)) AS url_hash, upper(sha256(text)) AS content_hash,
    upper(substr(title, 1, 800)) AS normalized_title, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(20 * (page_id % 2000)::INTEGER) AS retrieved_at
  FROM addressed WHERE refused IS NULL),
{_walk(('url', 'content_hash'))}, {_article_outcomes('items')}
SELECT item_id AS page_id, CASE WHEN is_duplicate THEN 'duplicate' ELSE 'stored' END AS outcome, reason, existing_item_id FROM told
UNION ALL SELECT page_id, 'rejected', refused, NULL FROM addressed WHERE refused IS NOT NULL"""
ORACLES["analyze_provider"] = ORACLES["analyze_incremental"] = ORACLES["analyze"]
ORACLES["request_limits"] = f"""WITH {RAW}, s AS (
  SELECT source_id AS update_id, item_id, substr(title, 1, 512) AS t, substr(excerpt, 1, 2000) AS e,
    row_number() OVER (PARTITION BY source_id ORDER BY published_at DESC NULLS LAST, item_id) AS n FROM raw QUALIFY n <= 50),
i AS (
  SELECT 'src' || c_custkey % 5 AS update_id, lpad(c_custkey::VARCHAR, 9, '0') AS id, substr(repeat(c_name, 8), 1, 100) AS name,
    row_number() OVER (PARTITION BY c_custkey % 5 ORDER BY c_custkey * 37 % 101 DESC, id) AS n FROM customer WHERE c_custkey % 7 <> 0 QUALIFY n <= 100),
sa AS (SELECT update_id, count(*)::INTEGER AS n_sources, md5(string_agg(concat_ws('|', item_id, t, e), chr(10) ORDER BY n)) AS sources FROM s GROUP BY 1),
ia AS (SELECT update_id, count(*)::INTEGER AS n_interests, md5(string_agg(concat_ws('|', id, name), chr(10) ORDER BY n)) AS interests FROM i GROUP BY 1)
SELECT update_id, substr(repeat(update_id, 60), 1, 200) AS primary_topic, n_sources, sources, coalesce(n_interests, 0) AS n_interests,
  coalesce(interests, md5('')) AS interests FROM sa LEFT JOIN ia USING (update_id)"""
