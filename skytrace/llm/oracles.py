"""DuckDB statements for the operators that SQL can express."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP1 = """
WITH raw AS (
  SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), lines AS (
  SELECT doc_id, i - 1 AS line_no, trim(regexp_replace(ls[i], '[ \\t\\r]+', ' ', 'g')) AS line
  FROM raw, unnest(range(1, len(ls) + 1)) AS r(i)
), masked AS (
  SELECT *, len(string_split(line, ' ')) AS n, regexp_replace(line, '[^ ]*[0-9][^ ]*', '<*>', 'g') AS m FROM lines WHERE line <> ''
), based AS (
  SELECT doc_id, line_no, n, CASE WHEN n - len(list_filter(string_split(m, ' '), lambda t: t = '<*>')) >= 0.5 * n THEN m ELSE line END AS base
  FROM masked
), leafed AS (
  SELECT *, CASE WHEN n >= 5 THEN n || ' ' || array_to_string(string_split(base, ' ')[1:3], ' ') END AS leaf FROM based
), dist AS (
  SELECT DISTINCT base, n, leaf FROM leafed
  WHERE leaf IN (SELECT leaf FROM leafed WHERE leaf IS NOT NULL GROUP BY leaf HAVING count(DISTINCT base) > 1)
), sizes AS (
  SELECT leaf, count(*) AS of_ FROM dist GROUP BY leaf
), tok AS (
  SELECT leaf, base, n, pos, string_split(base, ' ')[pos] AS t FROM dist, unnest(range(1, n + 1)) AS r(pos)
), support AS (
  SELECT leaf, pos, t, count(*) AS held FROM tok GROUP BY ALL
), shaped AS (
  SELECT base, any_value(tok.n) AS n, list(CASE WHEN pos <= 3 OR held >= greatest(2, ceil(0.1 * of_)) THEN t ELSE '<*>' END ORDER BY pos) AS ts
  FROM tok JOIN support USING (leaf, pos, t) JOIN sizes USING (leaf) GROUP BY base
), templates AS (
  SELECT base, array_to_string(ts, ' ') AS template FROM shaped WHERE n - len(list_filter(ts, lambda t: t = '<*>')) >= 0.75 * n
), placed AS (
  SELECT doc_id, line_no, coalesce(template, base) AS template FROM leafed LEFT JOIN templates USING (base)
), recurring AS (
  SELECT template, min((doc_id, line_no)) AS first FROM placed GROUP BY template HAVING count(DISTINCT doc_id) >= 2
), gone AS (
  SELECT doc_id, list(line_no) AS g FROM placed JOIN recurring USING (template) WHERE (doc_id, line_no) <> first GROUP BY doc_id
)
SELECT doc_id, len(ls) AS n_lines, coalesce(len(g), 0)::BIGINT AS n_dropped,
  CASE WHEN g IS NULL THEN text ELSE array_to_string([ls[i] FOR i IN range(1, len(ls) + 1) IF NOT list_contains(g, i - 1)], chr(10)) END AS text
FROM raw LEFT JOIN gone USING (doc_id)
"""

OP5 = f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS win
  FROM b, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS r(s) WHERE len(w) > 0
), sizes AS (
  SELECT DISTINCT n FROM iw
), dw AS (
  SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS win FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS r(s)
), hits AS (
  SELECT DISTINCT doc_id, s, n, win FROM dw WHERE win IN (SELECT win FROM iw WHERE iw.n = dw.n)
), words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id
), found AS (
  SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits JOIN iw USING (n, win) WHERE item_id IS NOT NULL
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM found GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP8 = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), t AS (
  SELECT payload_digest, max(page_id) AS target FROM p WHERE payload_bytes >= 1000 GROUP BY 1
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN target <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN target <> page_id THEN target END AS refers_to
FROM p LEFT JOIN t USING (payload_digest)
"""

# Fixed strings of the default chat template; an escaped control string has a backslash after its first character.
_STARTS = r"<(\\*)(\|turn\|>|\|end\|>|\|bos\|>|s>|/s>)"
_INST = r"\[(\\*)(INST\]|/INST\])"


def _escaped(column: str) -> str:
    return f"regexp_replace(regexp_replace({column}, '{_STARTS}', '<\\\\\\1\\2', 'g'), '{_INST}', '[\\\\\\1\\2', 'g')"


OP10 = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), shown AS (
  SELECT *, '<|turn|>' || {_escaped("replace(replace(role, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n')")} || chr(10) || {_escaped("text")} || '<|end|>' || chr(10) AS f
  FROM rows
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(length(f)) + length('<|bos|>'))::BIGINT AS formatted_chars
FROM shown GROUP BY conv_id
"""

OP7 = """
WITH v AS (
  SELECT vec_id, [floor(64 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

# Rules of the URL filter as regular expressions over host and rest of a URL: (order, verdict, name, expression).
_SITES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
_URL_RULES = [(0, v, n, "^([^/?#]*[.])?" + n.replace(".", "[.]")) for v, n in _SITES] + [
    (1, "block", "||spam-farm.", "^([^/?#]*[.])?spam-farm[.]"), (1, "block", "/wp-admin/", "/wp-admin/"), (1, "block", "/login^", "/login([^A-Za-z0-9_.%-]|$)"),
    (1, "block", "/cart^", "/cart([^A-Za-z0-9_.%-]|$)"), (1, "block", "/checkout^", "/checkout([^A-Za-z0-9_.%-]|$)"), (1, "block", "?*sessionid=", "[?].*sessionid="),
    (1, "block", "/tag/*/page/", "/tag/.*/page/"), (1, "block", "||ads.", "^([^/?#]*[.])?ads[.]"), (1, "block", "/casino-", "/casino-"),
    (1, "block", "?*utm_source=*&utm_medium=", "[?].*utm_source=.*&utm_medium="), (1, "allow", "||docs.*/login^", "^([^/?#]*[.])?docs[.].*/login([^A-Za-z0-9_.%-]|$)"),
]
_URL_VALUES = ", ".join(f"({t}, '{v}', '{n}', {len(n)}, '{e}')" for t, v, n, e in _URL_RULES)

OP11 = f"""
WITH r(tier, verdict, name, size, expr) AS (VALUES {_URL_VALUES}), rest AS (
  SELECT page_id, row_number() OVER () AS k, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), u AS (
  SELECT page_id, k, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
    substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1) AS tail FROM rest
), f AS (
  SELECT k, arg_min((tier, name, verdict), (tier, -size, verdict <> 'block', name)) AS w FROM u JOIN r ON regexp_matches(host || tail, expr, 's') GROUP BY k
)
SELECT page_id, host, path, CASE WHEN w[1] = 0 THEN w[2] END AS rule, coalesce(w[3], 'allow') AS verdict, w[2] AS pattern FROM u LEFT JOIN f USING (k)
"""

OP13 = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS anchor_id, c.vec_id, q.label = c.label AS same, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS n FROM s WHERE same
), n AS (
  SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, vec_id)::INTEGER AS rank
  FROM p JOIN s USING (anchor_id) WHERE p.n <= 5 AND NOT same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""

_PATTERNS = {
    "assign": "(?i)(password|passwd|secret|token|api_?key)[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)",
    "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+", "random": "[A-Za-z0-9+/_-]{16,}",
}
_MIXED = "regexp_matches(hit, '[a-z]')::INT + regexp_matches(hit, '[A-Z]')::INT + regexp_matches(hit, '[0-9]')::INT >= 2"
_KEEP = {
    "assign": f"length(regexp_extract(hit, '{_PATTERNS['assign']}', 2)) >= 6",
    "access": "length(hit) >= 20", "hex": "length(hit) >= 24", "random": _MIXED,
}
_ENCODED = (
    "CASE WHEN regexp_matches(hit, '^[0-9a-f]+$') THEN ('0123456789abcdef', 0.12::DOUBLE) WHEN regexp_matches(hit, '^[0-9A-F]+$') THEN ('0123456789ABCDEF', 0.12::DOUBLE) "
    f"WHEN regexp_matches(hit, '^[A-Z2-7]+$') THEN ('{_UPPER}234567', 0.066::DOUBLE) WHEN regexp_matches(hit, '^[a-z0-9]+$') THEN ('0123456789{_LOWER}', 0.066::DOUBLE) "
    f"ELSE ('{_UPPER}{_LOWER}0123456789+/', 0.066::DOUBLE) END"
)

OP4 = f"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), raw AS (
  {" UNION ALL ".join(f"SELECT doc_id, {i} AS k, '{kind}' AS kind, regexp_extract_all(text, '{p}') AS hits, regexp_split_to_array(text, '{p}') AS gaps FROM docs WHERE regexp_matches(text, '{p}')" for i, (kind, p) in enumerate(_PATTERNS.items()))}
), placed AS (
  SELECT doc_id, k, kind, i, hits[i] AS hit, length(gaps[i]) AS gap FROM raw, unnest(range(1, len(hits) + 1)) AS r(i)
), spans AS (
  SELECT doc_id, k, kind, hit, sum(gap + length(hit)) OVER (PARTITION BY doc_id, k ORDER BY i) AS stop FROM placed
), fine AS (
  SELECT doc_id, k, kind, hit, stop - length(hit) AS start, stop FROM spans
  WHERE {" OR ".join(f"(kind = '{kind}' AND {keep})" for kind, keep in _KEEP.items())}
), coded AS (
  SELECT DISTINCT hit, {_ENCODED} AS e, translate(hit, '-_', '+/') AS t FROM fine WHERE kind = 'random'
), measured AS (
  SELECT hit, length(hit)::DOUBLE AS n, length(e[1])::DOUBLE AS size, e[2] AS ic, len(regexp_extract_all(t, '[a-z]+|[A-Z]+|[0-9]+|[+/]+')) AS runs,
    list_sum([(length(t) - length(replace(t, c, '')))::DOUBLE ** 2 FOR c IN string_split(e[1], '')]) AS squares, [instr(e[1], c)::DOUBLE FOR c IN string_split(t, '')] AS places
  FROM coded
), moved AS (
  SELECT *, [x - list_sum(places) / n FOR x IN places] AS off FROM measured
), correlated AS (
  SELECT *, CASE WHEN list_sum([x * x FOR x IN off]) > 0 THEN list_sum([off[j] * off[j + 1] FOR j IN range(1, n::INT)]) / list_sum([x * x FOR x IN off]) ELSE 1 END AS r
  FROM moved
), scored AS (
  SELECT hit, n, round(((size - 1 + n * (size * ic - 1) - (size / n * squares - n)) / sqrt(2 * (size - 1) + 4 * n * (size * ic - 1))
    + (runs - 1 - (n - 1) * 0.15::DOUBLE) / sqrt((n - 1) * 0.15::DOUBLE * (1 - 0.15::DOUBLE)) + (0.35::DOUBLE - abs(r)) * sqrt(n)) / sqrt(3::DOUBLE), 6) AS z
  FROM correlated
), binned AS (
  SELECT fine.*, least(32, floor(n / 16))::INT AS grp, (CASE WHEN z > 0 THEN least(399, floor(z * z / 2 * 8)) ELSE 0 END)::INT AS bin
  FROM fine JOIN scored USING (hit) WHERE kind = 'random'
), hist AS (
  SELECT grp, bin, count(*) AS c FROM binned GROUP BY ALL
), tail AS (
  SELECT grp, b.bin, sum(c) FILTER (hist.bin >= b.bin) AS above, sum(c) AS total FROM hist, (SELECT unnest(range(1, 400)) AS bin) b GROUP BY ALL
), limits AS (
  SELECT grp, min(bin) AS lim FROM tail WHERE above > 0 AND exp(-bin / 8.0) <= 0.001 * above / total GROUP BY grp
), kept AS (
  SELECT doc_id, k, kind, start, stop FROM fine WHERE kind <> 'random'
  UNION ALL SELECT doc_id, k, kind, start, stop FROM binned JOIN limits USING (grp) WHERE bin >= lim
), listed AS (
  SELECT doc_id, count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS b, count(*) FILTER (k = 2) AS c, count(*) FILTER (k = 3) AS d,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) FILTER (k < 3) AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) AS spans
  FROM kept GROUP BY doc_id
)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(c, 0)::BIGINT AS n_hex, coalesce(d, 0)::BIGINT AS n_random,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN listed USING (doc_id)
"""
