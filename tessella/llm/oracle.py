"""DuckDB SQL for the queries that SQL can express."""

_WS = r"[\x20\x09-\x0D]"

ORACLE_SQL = {
    "op3_line_dedup": rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
l AS (SELECT r, doc_id, unnest(string_split(t, chr(10))) AS line, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS i FROM d),
k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^{_WS}+', ''), '{_WS}+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
rep AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10),
m AS (SELECT k.*, rep.key IS NOT NULL AS gone FROM k LEFT JOIN rep ON k.key = rep.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, sum(gone::INT)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(CASE WHEN NOT gone THEN line END, chr(10) ORDER BY i), '')) AS kept_sha256
FROM m GROUP BY r, doc_id""",
    "op4_ngram_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS sh FROM (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - 3) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
e AS (SELECT x AS a, y AS b FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, reach) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.reach = e.a)
SELECT r.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(reach) AS component_id FROM r LEFT JOIN n ON r.doc_id = n.doc_id GROUP BY r.doc_id""",
    "op6_quality_rules": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, unnest(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS w, unnest(range(1, 1 + len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')))) AS i FROM d),
g AS (SELECT r, i, w || ' ' || lead(w) OVER p || ' ' || lead(w, 2) OVER p AS g FROM w WINDOW p AS (PARTITION BY r ORDER BY i)),
h AS (SELECT r, i FROM g WHERE g IS NOT NULL QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
n AS (SELECT r, count(DISTINCT j) AS n_repeat_words FROM (SELECT r, i + unnest([0, 1, 2]) AS j FROM h) GROUP BY r),
k AS (SELECT r, count(*) AS n_words, sum(length(w)) AS word_chars FROM w GROUP BY r),
l AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
x AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines,
  count(*) FILTER (regexp_matches(line, '(\.\.\.|…) *$')) AS dotted, count(*) FILTER (regexp_matches(line, '^ *[-*•]')) AS bulleted
  FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
a AS (SELECT d.r, doc_id, t, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
  (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, coalesce(n_lines, 0) AS n_lines, coalesce(dotted, 0) AS dotted,
  coalesce(bulleted, 0) AS bulleted, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
  length(t) - length(regexp_replace(t, '\p{{L}}', '', 'g')) AS letters, length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')) AS capitals
  FROM d LEFT JOIN k ON d.r = k.r LEFT JOIN x ON d.r = x.r LEFT JOIN n ON d.r = n.r),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words
    OR (n_lines >= 4 AND 2 * n_dup_lines > n_lines) OR 2 * capitals > letters OR 2 * letters < word_chars
    OR (10 * dotted > 5 * n_lines AND n_lines >= 4) OR (10 * bulleted > 9 * n_lines AND n_lines >= 8)) AS kept
FROM b""",
    "op8_url_filter": r"""
WITH p AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, regexp_extract(rest, '^([^?#]*)', 1) AS rest FROM p),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  CASE WHEN strpos(rest, '/') > 0 THEN substr(rest, strpos(rest, '/')) ELSE '' END AS path FROM q),
rules(host_r, path_r, rule, verdict) AS (VALUES ('org', '/', 'org/', 'allow'), ('example.org', '/es/', 'example.org/es/', 'block'),
  ('example.org', '/en/1', 'example.org/en/1', 'block'), ('com', '/fr/', 'com/fr/', 'allow'), ('com', '/de/', 'com/de/', 'block')),
m AS (SELECT page_id, rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC) AS k
  FROM h JOIN rules ON (host = host_r OR ends_with(host, '.' || host_r)) AND starts_with(path, path_r))
SELECT h.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM h LEFT JOIN m ON h.page_id = m.page_id AND k = 1""",
    "op9_warc": r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY b) AS top FROM p)
SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS payload_digest,
  CASE WHEN octet_length(b) >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN octet_length(b) >= 1000 AND page_id <> top THEN top END AS refers_to FROM g""",
}
