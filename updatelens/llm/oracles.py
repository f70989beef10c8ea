"""DuckDB SQL for the queries of this folder that SQL can express."""

from __future__ import annotations

from updatelens.llm import rules

ORACLES: dict[str, str] = {}

def _quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


# Lines by the default rules, then the base counts of the whole text.
ORACLES["op3_line_rules"] = rf"""WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
split AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS k FROM d),
lines AS (
  SELECT *, len(ws) AS n, length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) AS symbols,
    len(list_filter(ws, lambda w: ends_with(w, '!!'))) AS bangs,
    len(list_filter(ws, lambda w: w IN ({_quoted(sorted(w.decode() for w in rules._SEPARATORS))}))) AS bars,
    rtrim(regexp_replace(line, '\s+$', ''), '{"".join(rules._CLOSERS).replace("'", "''")}') AS bare
  FROM (SELECT *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS ws FROM split) WHERE len(ws) > 0),
judged AS (
  SELECT doc_id, n, row_number() OVER (PARTITION BY doc_id, line ORDER BY k) > 1 AS again,
    symbols > 0.1 * length(line) OR bangs > 0.5 * n OR bars >= 0.2 * n
    OR (n <= 20 AND regexp_matches(line, '{"|".join(rules.BOILERPLATE)}', 'i'))
    OR (n <= 4 AND NOT ({" OR ".join(f"ends_with(bare, '{e}')" for e in rules._ENDS)})) AS failed FROM lines),
per_doc AS (
  SELECT doc_id, count(*) FILTER (again) AS n_dup_lines, count(*) FILTER (failed) AS n_lines_removed,
    coalesce(sum(n) FILTER (failed), 0)::BIGINT AS n_words_removed FROM judged GROUP BY 1),
win AS (
  SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, h) AS times FROM (
    SELECT doc_id, unnest(hs) AS h, generate_subscripts(hs, 1) AS p FROM (
      SELECT doc_id, list_transform(range(1, len(ws) - 3), lambda p: md5(array_to_string(ws[p:p + 4], ' '))) AS hs FROM d WHERE len(ws) >= 5))),
repeats AS (SELECT doc_id, count(DISTINCT i) AS n_repeat_words FROM (SELECT doc_id, unnest(range(p, p + 5)) AS i FROM win WHERE times > 1) GROUP BY 1),
counts AS (
  SELECT doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines_removed, 0) AS n_lines_removed,
    coalesce(n_words_removed, 0) AS n_words_removed
  FROM d LEFT JOIN per_doc USING (doc_id) LEFT JOIN repeats USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_words_removed <= 0.5 * n_words AS kept FROM counts"""

# Every window of 50 words of every text, by digest; a word goes if a window over it is older elsewhere.
ORACLES["op10_passages"] = r"""WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
cut AS (SELECT doc_id, list_transform(range(1, len(ws) - 48), lambda p: md5(array_to_string(ws[p:p + 49], ' '))) AS hs FROM w WHERE len(ws) >= 50),
win AS (SELECT doc_id, unnest(hs) AS h, generate_subscripts(hs, 1) AS p FROM cut),
hit AS (SELECT doc_id, p FROM win JOIN (SELECT h, min(doc_id) AS first FROM win GROUP BY h) USING (h) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, i FROM (SELECT doc_id, unnest(range(p, p + 50)) AS i FROM hit)),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)"""

# The same for windows of 200 bytes, read as hexadecimal digits.
ORACLES["op6_substrings"] = r"""WITH x AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS t, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
parts AS (SELECT doc_id, n, list_transform(range(0, n, 100), lambda b: substr(t, 2 * b + 1, 200)) AS bs FROM x WHERE n >= 200),
cut AS (SELECT doc_id, list_transform(range(0, n - 199), lambda p: md5(substr(
  bs[p // 100 + 1] || coalesce(bs[p // 100 + 2], '') || coalesce(bs[p // 100 + 3], ''), 2 * (p % 100) + 1, 400))) AS hs FROM parts),
win AS (SELECT doc_id, unnest(hs) AS h, generate_subscripts(hs, 1) AS p FROM cut),
hit AS (SELECT doc_id, p FROM win SEMI JOIN (SELECT h FROM win GROUP BY h HAVING count(*) > 1) USING (h)),
gone AS (SELECT DISTINCT doc_id, i FROM (SELECT doc_id, unnest(range(p, p + 200)) AS i FROM hit)),
spans AS (SELECT doc_id, min(i) AS a, max(i) AS b FROM (
  SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS island FROM gone) GROUP BY doc_id, island),
totals AS (SELECT doc_id, sum(b - a + 1)::BIGINT AS n_removed, count(*) AS n_spans FROM spans GROUP BY 1),
gaps AS (
  SELECT doc_id, b + 1 AS a, lead(a) OVER (PARTITION BY doc_id ORDER BY a) - 1 AS b FROM spans
  UNION ALL SELECT doc_id, 1 AS a, min(a) - 1 AS b FROM spans GROUP BY 1),
kept AS (SELECT doc_id, string_agg(substr(t, 2 * a - 1, 2 * (coalesce(b, n) - a + 1)), '' ORDER BY a) AS k FROM gaps JOIN x USING (doc_id) GROUP BY 1)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN n_removed IS NULL THEN t ELSE k END)) AS kept_sha256
FROM x LEFT JOIN totals USING (doc_id) LEFT JOIN kept USING (doc_id)"""

# Keys of lines in ten documents or more; places keep the order.
ORACLES["op11_lines"] = r"""WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS p FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
common AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT *, k IN (SELECT k FROM common) AS gone FROM keyed)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""


def _manifest(levels: int = 5, top_levels: int = 4) -> str:
    """Level by level: what is left and right of each node in its run, then the proof of each leaf folded.

    ``levels`` bounds a source to 16^5 rows and ``top_levels`` the sources to 16^4.
    """

    def tree(name: str, up: int) -> list[str]:
        run = f"PARTITION BY g, i // 16 ORDER BY i ROWS BETWEEN"
        parts = []
        for k in range(up):
            parts.append(
                f"{name}s{k} AS (SELECT *, n > 1 AS more, coalesce(string_agg(d, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,"
                f" coalesce(string_agg(d, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{k})"
            )
            parts.append(
                f"{name}{k + 1} AS (SELECT g, i // 16 AS i, CASE WHEN max(n) > 1 THEN sha256(string_agg(d, '' ORDER BY i)) ELSE max(d) END AS d,"
                f" (max(n) + 15) // 16 AS n FROM {name}{k} GROUP BY ALL)"
            )
        return parts

    def climb(name: str, at: str, up: int, base: str, place: str) -> list[str]:
        parts, last = [], base
        for k in range(up):
            parts.append(
                f"{at}{k} AS (SELECT x.* REPLACE (CASE WHEN more THEN proof || l || r ELSE proof END AS proof,"
                f" CASE WHEN more THEN sha256(l || f || r) ELSE f END AS f) FROM {last} x JOIN {name}s{k} s"
                f" ON s.g = x.{'g' if name == 't' else 'z'} AND s.i = x.{place} // {16**k})"
            )
            last = f"{at}{k}"
        return parts

    def field(c: str) -> str:
        return f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')"

    fixed = " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars"))
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    bit = "lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END"
    crc = (
        "xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''),"
        f" lambda x: ord(x)::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), {bit})))"
    )
    parts = [
        f"leaves AS (SELECT doc_id, source, sha256({fixed} || {field('text')}) AS leaf, CASE WHEN {crc} % 5 = 0 THEN"
        f" sha256({fixed} || {field(lowered)}) END AS tampered FROM documents)",
        "placed AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g,"
        " row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM leaves)",
        "t0 AS (SELECT g, i, leaf AS d, n FROM placed)",
        *tree("t", levels),
        f"u0 AS (SELECT 0 AS g, g AS i, d, count(*) OVER () AS n FROM t{levels})",
        *tree("u", top_levels),
        "start AS (SELECT *, 0 AS z, '' AS proof, coalesce(tampered, leaf) AS f FROM placed)",
        *climb("t", "a", levels, "start", "i"),
        *climb("u", "b", top_levels, f"a{levels - 1}", "g"),
    ]
    return (
        f"WITH {', '.join(parts)} SELECT doc_id, leaf, t.d AS subroot, u.d AS root, sha256(proof) AS proof_sha256, f AS folded_root,"
        f" f = u.d AS verified FROM b{top_levels - 1} b JOIN t{levels} t USING (g) CROSS JOIN u{top_levels} u"
    )


ORACLES["op12_manifest"] = _manifest()

# Every anchor against every row.
ORACLES["op13_negatives"] = """WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.e, b.e)::BIGINT AS s
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
positive AS (
  SELECT anchor_id, id AS positive_id, s AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY s DESC, id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER w::INTEGER AS rank, id AS negative_id, positive_score, s AS negative_score
FROM positive JOIN (FROM scored WHERE NOT same) USING (anchor_id)
WHERE 50 * positive_score <= 100 * s AND 100 * s <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s DESC, id)
QUALIFY row_number() OVER w <= 3"""
