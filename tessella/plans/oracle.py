"""DuckDB SQL for the driver's queries."""

from . import whole

_ASKED = """q(query_id, query) AS (VALUES (1::BIGINT, 'the nation of the'), (2, 'that with heat tion'), (3, 'was entan ere'), (4, 'de la que los'), (5, 'und der die'))"""
_RE = r"[a-zA-Z][a-zA-Z0-9_+#.-]*|\d+(?:\.\d+)?"


def _tokens(c: str) -> str:
    return f"regexp_extract_all(lower({c}), '{_RE}')"


def _stats(fields: list[str]) -> str:
    """CTEs ``p`` (postings) and ``st`` (field statistics)."""
    parts = " UNION ALL ".join(f"SELECT doc_id, '{f}' AS field, {_tokens(f)} AS toks FROM documents" for f in fields)
    return f"""d AS ({parts}),
p AS (SELECT doc_id, field, token, count(*) AS tf, any_value(len) AS len FROM (SELECT doc_id, field, len(toks) AS len, unnest(toks) AS token FROM d) GROUP BY ALL),
st AS (SELECT field, count(*) AS n, greatest(sum(len(toks))::DOUBLE / count(*), 1e-9::DOUBLE) AS avg_len FROM d GROUP BY field)"""


def _bm25f(asked: str, weights: dict[str, float], b: dict[str, float]) -> str:
    """CTEs up to ``bm`` (query_id, chunk_id, score to six places)."""
    w = "CASE p.field " + " ".join(f"WHEN '{f}' THEN {x}::DOUBLE" for f, x in weights.items()) + " END"
    s = "CASE p.field " + " ".join(f"WHEN '{f}' THEN {x}::DOUBLE" for f, x in b.items()) + " END"
    return f"""{asked}, {_stats(list(weights))},
qt AS (SELECT query_id, token, count(*) AS qtf FROM (SELECT query_id, unnest({_tokens("query")}) AS token FROM q) GROUP BY ALL),
w AS (SELECT token, doc_id, sum({w} * tf / greatest(1.0::DOUBLE - {s} + {s} * len / avg_len, 1e-9::DOUBLE)) AS wtf, max(n)::DOUBLE AS n FROM p JOIN st ON p.field = st.field GROUP BY ALL),
df AS (SELECT token, count(*)::DOUBLE AS df FROM w GROUP BY token),
bm AS (SELECT query_id, doc_id AS chunk_id, round(sum(qtf * ln(1.0::DOUBLE + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * 2.5::DOUBLE * wtf / (1.5::DOUBLE + wtf)), 6) AS score FROM w JOIN df USING (token) JOIN qt USING (token) GROUP BY ALL)"""


def _fts(asked: str) -> str:
    return f"""{asked}, {_stats(["text"])},
qt AS (SELECT DISTINCT query_id, unnest({_tokens("query")}) AS token FROM q),
df AS (SELECT token, count(*)::DOUBLE AS df FROM p GROUP BY token),
ft AS (SELECT query_id, doc_id AS chunk_id, round(sum(greatest(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 1e-6::DOUBLE) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avg_len))), 6) AS score
  FROM p JOIN df USING (token) JOIN qt USING (token) CROSS JOIN st GROUP BY ALL)"""


def _top(source: str, k: int) -> str:
    return f"SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM {source}) WHERE rank <= {k}"


_ONE, _ONE_B = {"text": 1.0}, {"text": 0.75}
_BOTH = f"WITH {_bm25f(_ASKED, _ONE, _ONE_B)}"
_HREF = r"(?i)<a\b[^>]*?\bhref\s*=\s*[\"'']([^\"'']+)[\"'']"
_HOST = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"
_PATH = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_WS = r"[ \t\n\r]+"
#: Spark's \s with the flag for Unicode, as a class.
_SPACE = r"\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def _strip(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^[{_SPACE}]+', ''), '[{_SPACE}]+$', '')"


def _count(c: str, term: str) -> str:
    return f"((length({c}) - length(replace({c}, '{term}', '')))::DOUBLE / {len(term)})"


_MOJI = " + ".join(_count("h", t) for t in ("ä", "å", "ç", "è", "æ", "é", "ï1⁄4", "3⁄4"))
_MOJI_2 = " + ".join(_count("h", t) for t in ("ä", "å", "ç", "è", "æ", "é", "Ϣѧ", "רҵ", "ѧλ"))
_MISREAD = " OR ".join(f"contains(h, '{t}')" for t in ("ϢѧԺ", "Ϣѧ", "רҵ", "ѧλ", "汾ŵ", "ھ", "ʦ", "ƽ", "о", "Ƹ", "εͳ"))
_GARBLED = f"""g AS (SELECT *, substr(t, 1, 5000) AS h FROM t0), g1 AS (SELECT *,
  length(h) - length(regexp_replace(h, '[\\x{{4e00}}-\\x{{9fff}}]', '', 'g')) AS cjk, length(h) - length(regexp_replace(h, '[\\x{{0400}}-\\x{{04ff}}\\x{{0370}}-\\x{{03ff}}]', '', 'g')) AS other FROM g),
g2 AS (SELECT *, regexp_matches(t, '\\(cid:\\d+\\)') OR contains(t, 'â') OR contains(t, 'ä ̧') OR contains(h, 'Ã') OR contains(h, '�')
  OR (length(h) >= 300 AND cjk < 20 AND other > 80) OR (length(h) >= 300 AND cjk < 30 AND ({_MOJI}) > 50) OR {_MISREAD} AS garbled,
  contains(h, '�') OR contains(h, 'â') OR contains(h, 'Ã') OR (length(h) >= 300 AND cjk < 30 AND ({_MOJI_2}) > 30) AS garbled_head FROM g1)"""

ORACLE_SQL = {
    "tok_ascii_tf": f"WITH {_stats(['text'])} SELECT token, sum(tf)::BIGINT AS tf, count(*) AS docs FROM p GROUP BY token",
    "doc_freq": f"WITH {_stats(['text', 'source'])} SELECT token, count(DISTINCT doc_id) AS df FROM p GROUP BY token",
    "avg_field_len": f"WITH {_stats(['text', 'source', 'lang'])} SELECT field, n AS n_docs, round(avg_len, 6) AS avg_len FROM st",
    "bm25f_topk": f"{_BOTH} {_top('bm', 10)}",
    "bm25f_multifield": f"WITH {_bm25f("q(query_id, query) AS (VALUES (1::BIGINT, 'en the src4'), (2, 'fr la src7'))", {'text': 1.0, 'source': 3.0, 'lang': 0.8}, {'text': 0.75, 'source': 0.2, 'lang': 0.0})} {_top('bm', 20)}",
    "fts_bm25_topk": f"WITH {_fts(_ASKED)} {_top('ft', 10)}",
    "dense_topk": """WITH s AS (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score FROM embeddings q JOIN embeddings v ON q.vec_id % 50 = 0)
SELECT query_id, chunk_id, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS k FROM s) WHERE k <= 10""",
    "vector_norms": "SELECT vec_id, 1.0::DOUBLE AS norm, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 3) AS square FROM embeddings",
    "rrf_fusion": f"""WITH {_bm25f(_ASKED, _ONE, _ONE_B)}, {_fts(_ASKED).split('st AS')[1].split('GROUP BY field),')[1].replace('qt AS', 'qt2 AS').replace('df AS', 'df2 AS').replace('JOIN df USING', 'JOIN df2 USING').replace('JOIN qt USING', 'JOIN qt2 USING')},
r AS (SELECT *, 1.0::DOUBLE AS w FROM ({_top('bm', 50)}) UNION ALL SELECT *, 1.15::DOUBLE FROM ({_top('ft', 50)})),
f AS (SELECT query_id, chunk_id, round(sum(w / (60 + rank)), 9) AS score, max(score) AS best FROM r GROUP BY ALL)
SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, best DESC, chunk_id) AS rank FROM f) WHERE rank <= 20""",
    "line_df_blacklist": rf"""WITH l AS (SELECT DISTINCT doc_id, {_strip("regexp_replace(regexp_replace(replace(line, '　', ' '), '(?i)&(?:nbsp|amp|lt|gt|quot);', ' ', 'g'), '[ \t]+', ' ', 'g')")} AS line
  FROM (SELECT doc_id, unnest(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10))) AS line FROM documents)),
c AS (SELECT line, count(*) AS n_docs FROM l WHERE line <> '' AND (length(line) <= 36 OR (length(line) <= 120 AND (starts_with(line, '* [') OR starts_with(line, '[') OR contains(line, 'javascript:;') OR contains(line, 'Copyright') OR contains(line, '公网安备') OR contains(line, '邮编')))) GROUP BY line)
SELECT line, n_docs FROM c WHERE n_docs >= greatest(20, floor((SELECT count(*) FROM documents) * 0.018)) AND (length(line) <= 64 OR contains(line, 'javascript') OR contains(line, 'Copyright') OR contains(line, '公网安备'))""",
    "line_repeat_cap": """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) AS k FROM l WHERE line <> '') SELECT doc_id, count(*) AS kept, sum(length(line))::BIGINT AS chars FROM n WHERE k <= 2 GROUP BY doc_id""",
    "chunk_windows": rf"""WITH t AS (SELECT doc_id, trim(regexp_replace(text, '{_WS}', ' ', 'g'), ' ') AS t FROM documents),
w AS (SELECT doc_id, t, unnest(range(0, (greatest(0, ceil((length(t) - 900) / 780.0)) * 780 + 1)::BIGINT, 780)) AS s FROM t),
c AS (SELECT doc_id, s, {_strip("substr(t, s + 1, 900)")} AS chunk FROM w)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS chunk_index, chunk FROM c WHERE length(chunk) >= 80""",
    "exact_dedup": rf"""SELECT min(doc_id) AS doc_id, hash FROM (SELECT doc_id, sha1(lower({_strip(f"regexp_replace(text, '[{_SPACE}]+', ' ', 'g')")})) AS hash FROM documents) GROUP BY hash""",
    "neighbor_expand": """WITH c AS (SELECT conv_id * 1000 + turn AS chunk_id, conv_id AS doc_id, turn FROM conversations), h AS (SELECT doc_id % 5 AS query_id, chunk_id, doc_id, turn FROM c WHERE turn = 1),
n AS (SELECT DISTINCT query_id, c.chunk_id FROM h JOIN c ON h.doc_id = c.doc_id AND abs(c.turn - h.turn) = 1)
SELECT query_id, chunk_id, 0.95::DOUBLE AS score FROM n WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.query_id = n.query_id AND h.chunk_id = n.chunk_id)""",
    "candidate_merge": """SELECT 1::BIGINT AS query_id, doc_id AS chunk_id, max(score) AS score FROM (SELECT doc_id, n_chars::DOUBLE AS score FROM documents WHERE source IN ('src1', 'src2') UNION ALL SELECT doc_id, 700.0::DOUBLE FROM documents WHERE lang = 'en') GROUP BY doc_id""",
    "anti_new_hits": """WITH h AS (SELECT doc_id, n_chars FROM documents WHERE lang = 'fr'), m AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS k FROM documents WHERE source IN ('src1', 'src2', 'src3') AND doc_id NOT IN (SELECT doc_id FROM h))
SELECT 1::BIGINT AS query_id, doc_id AS chunk_id, n_chars::DOUBLE AS score FROM (SELECT doc_id, n_chars FROM h UNION ALL SELECT doc_id, n_chars FROM m WHERE k <= 25)""",
    "per_source_cap": "SELECT doc_id, source, n_chars FROM (SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM documents) WHERE k <= 2",
    "lcg_sample": "SELECT doc_id, source, k AS sample_rank FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY (doc_id * 1103515245 + 12345) & 2147483647, doc_id) AS k FROM documents) WHERE k <= 3",
    "group_report": "SELECT lang, count(*) AS n, round(avg(n_chars::DOUBLE), 3) AS avg_quality FROM documents GROUP BY lang",
    "top_hosts": f"SELECT coalesce(nullif({_HOST}, ''), '(none)') AS host, count(*) AS n FROM pages GROUP BY 1 ORDER BY n DESC, host LIMIT 30",
    "garbled_filter": f"WITH t0 AS (SELECT doc_id, text AS t FROM documents), {_GARBLED} SELECT doc_id, garbled, garbled_head FROM g2",
    "quality_score": """SELECT doc_id, round(greatest(0.05::DOUBLE, least(1.0::DOUBLE, 0.7::DOUBLE + 0.04::DOUBLE + CASE WHEN lang = 'en' THEN 0.04::DOUBLE ELSE 0 END
  - CASE WHEN lang = 'de' AND regexp_matches(lower(substr(text, 1, 5000)) || chr(10) || 'docs/' || source, 'abstract|references|arxiv|doi|ieee|acm|proceedings|conference|workshop|slides|poster|acl|emnlp|iclr|neurips|cvpr|iccv|aaai|ijcai|iecon|apec|ecce|ecceasia|tpel|tpe|tie|tia|tvt|mtt|mwscas|iscas|icassp|access|jestpe|ietpe|iros|icra') THEN 0.22::DOUBLE ELSE 0 END
  - CASE WHEN length(text) < 300 THEN 0.08::DOUBLE ELSE 0 END)), 4) AS quality FROM documents""",
    "skip_reason": f"WITH t0 AS (SELECT doc_id, lang, text AS t FROM documents), {_GARBLED} SELECT lang AS source_type, CASE WHEN garbled THEN 'garbled' WHEN length(t) < 120 THEN 'short' ELSE 'kept' END AS reason, count(*) AS n FROM g2 GROUP BY ALL",
    "html_to_text": rf"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\b.*?</(?:script|style)>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'),
  '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '{_WS}', ' ', 'g'), ' ') AS text FROM pages""",
    "link_extract": f"SELECT page_id, link, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '{_HREF}', 1)) AS link FROM pages) GROUP BY ALL",
    "url_normalize": rf"""WITH u AS (SELECT page_id, url, {_HOST} AS host, {_PATH} AS path FROM pages), v AS (SELECT *, regexp_replace(path, '/+$', '') AS p FROM u)
SELECT page_id, host, path, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || CASE WHEN p = '' THEN '/' ELSE p END || regexp_extract(regexp_replace(url, '#.*$', ''), '(\?.*)$', 1) AS normal,
  contains(host, '@') OR regexp_matches(lower(path), '(?:\.png|\.jpg|\.jpeg|\.gif|\.svg|\.ico|\.css|\.js|\.webp|\.bmp)$') OR contains(lower(path), '/_upload/tpl/') OR contains(lower(path), '/template') AS static,
  NOT regexp_matches(lower(path), '\.(?:jpg|jpeg|png|gif|svg|ico|webp|css|js|woff|woff2|ttf|eot|pdf|mp4|mp3|avi|mov|flv|wmv|zip|rar|tar|gz|bz2|7z|exe|dmg|pkg|apk|iso|bin|doc|docx|xls|xlsx|ppt|pptx|odt|ods|odp)$') AS web_page FROM v""",
    "link_bfs": f"""WITH RECURSIVE l AS (SELECT DISTINCT {_HOST} AS a, unnest(regexp_extract_all(html, '{_HREF}', 1)) AS b FROM pages), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(node, depth) AS (SELECT min(a), 0::BIGINT FROM l UNION SELECT e.b, r.depth + 1 FROM r JOIN e ON e.a = r.node WHERE r.depth < 3) SELECT node, min(depth) AS depth FROM r GROUP BY node""",
    "email_extract": r"SELECT DISTINCT doc_id, email FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_.+-]+@[A-Za-z0-9_.-]+\.[A-Za-z]{2,}')) AS email FROM documents)",
    "accuracy_report": "SELECT lang, sum((quality = 1)::INT)::BIGINT AS correct, count(*) AS total, round(avg((quality = 1)::INT), 6) AS accuracy FROM documents JOIN labels USING (doc_id) GROUP BY lang",
    "left_lookup": "SELECT doc_id, lang, coalesce(quality, -1) AS quality FROM documents LEFT JOIN labels USING (doc_id)",
    "semi_multiget": "SELECT doc_id, source, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "contained_terms": """WITH i AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS ws FROM benchmark), iw AS (SELECT item_id, len(ws) AS size, unnest(ws) AS word FROM i),
d AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) AS word FROM documents)
SELECT doc_id, item_id, count(*) AS shared FROM d JOIN iw USING (word) GROUP BY doc_id, item_id, size HAVING count(*) * 10 >= size * 9""",
    "reply_parsers": "SELECT * FROM (VALUES (1::BIGINT, 'CS101|instructor', '', 'answer'), (2, '3|1|9', '3,1', 'search'), (3, 'index'': 2|1', '2,1', 'answer'), (4, 'a b', '', 'search'), (5, 'alpha|beta|gamma', '', 'search'), (6, 'k', '', 'search')) t(id, keywords, ranking, action)",
    "pinned_merge": """WITH f AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r FROM documents WHERE lang = 'en'), s AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r FROM documents WHERE lang = 'de'),
b AS (SELECT doc_id, n_chars, r <= 2 AS pin, r FROM f WHERE r <= 10 UNION ALL SELECT doc_id, n_chars, false, r FROM s WHERE r <= 10)
SELECT 1::BIGINT AS query_id, doc_id AS chunk_id, row_number() OVER (ORDER BY pin DESC, CASE WHEN pin THEN r END, n_chars DESC, doc_id) AS rank FROM b QUALIFY rank <= 12""",
    "route_candidates": """WITH q(query_id) AS (VALUES (1::BIGINT), (2)), c AS (SELECT q.query_id, doc_id, (length(text) % 97 / 100.0)::DOUBLE AS quality FROM documents, q WHERE (q.query_id = 1 AND source IN ('src1', 'src2')) OR (q.query_id = 2 AND (source = 'src3' OR lang = 'fr')))
SELECT query_id, doc_id AS chunk_id, 32.0::DOUBLE AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY quality DESC, doc_id) AS k FROM c) WHERE k <= 15""",
    "persons_inline": "SELECT * FROM (VALUES (1::BIGINT, 0::BIGINT, '张三', 'San Zhang'), (2, 0, '张三', 'San Zhang'), (2, 1, '李四', 'Si Li'), (3, 0, '', 'Ada Lovelace'), (3, 1, '', 'Alan Turing')) t(id, pos, cjk, latin)",
    "search_texts": f"SELECT doc_id, array_to_string({_tokens("concat_ws(chr(10), source, lang, text)")}, ' ') AS search_text FROM documents",
    "event_windows": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "event_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g), c AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY ALL) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY user_id""",
    "page_titles": "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages",
    "running_budget": "SELECT doc_id, source, n_chars, used::BIGINT AS used FROM (SELECT doc_id, source, n_chars, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS used FROM documents) WHERE used <= 7200",
    "tok_cjk_inline": r"""WITH t(id, t) AS (VALUES (1::BIGINT, '课程 CS101 的介绍'), (2, '研究方向是机器学习与数据挖掘技术'), (3, 'c++ 3.14 老师'), (4, '')),
r AS (SELECT id, unnest(regexp_extract_all(t, '[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]+')) AS run, unnest(range(1, 1 + len(regexp_extract_all(t, '[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]+')))) AS k FROM t),
x AS (SELECT id, 0 AS k, 0 AS part, i AS ord, tok AS token FROM (SELECT id, unnest(regexp_extract_all(lower(t), '[a-zA-Z][a-zA-Z0-9_+#.-]*|\d+(?:\.\d+)?')) AS tok, unnest(range(1, 1 + len(regexp_extract_all(lower(t), '[a-zA-Z][a-zA-Z0-9_+#.-]*|\d+(?:\.\d+)?')))) AS i FROM t)
  UNION ALL SELECT id, k, 0, 0, run FROM r WHERE length(run) <= 8
  UNION ALL SELECT id, k, n, i, substr(run, i, n) FROM (SELECT id, k, run, n, unnest(range(1, length(run) - n + 2)) AS i FROM r, (VALUES (1), (2), (3)) v(n)) WHERE n > 1 OR NOT contains('的一是在了和与及或对中为有个们于年月日', substr(run, i, n)))
SELECT id, row_number() OVER (PARTITION BY id ORDER BY k, part, ord) - 1 AS pos, token FROM x""",
}
ORACLE_SQL |= {name: sql for name, (_, sql) in whole.WHOLE.items() if sql}
ORACLE_SQL["fts_by_category"] = f"WITH {_fts(_ASKED)}, fc AS (SELECT ft.* FROM ft JOIN documents d ON d.doc_id = ft.chunk_id WHERE d.lang IN ('de', 'fr')) {_top('fc', 10)}"
