"""More of the driver's queries, each beside its SQL: operators on every row of a table that their results can be told for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import extract, quality
from ..functions import text as txt
from ..operators import assist, evaluate, hits, hop, rank, routes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents")


# SQL

#: Any white space, as a class of the other engine.
_S = r"\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_WORD = r"[a-zA-Z][a-zA-Z0-9_+#.-]*|\d+(?:\.\d+)?"


def _strip(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^[{_S}]+', ''), '[{_S}]+$', '')"


def _tokens(c: str) -> str:
    return f"regexp_extract_all(lower({c}), '{_WORD}')"


#: Letters and digits that follow each other in a text.
_PARTS = r"regexp_extract_all(%s, '[\p{L}\p{N}]+')"
#: Each document's tokens with their places.
_PLACED = f"p AS (SELECT doc_id, unnest({_tokens('text')}) AS t, unnest(range(len({_tokens('text')}))) AS i FROM documents)"


# text


def normal_texts(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", txt.normal_plain("text").alias("plain"), txt.normal_line("text", compatible=False).alias("line"))


def text_forms(spark, sf_dir):
    return _docs(spark, sf_dir).select(
        "doc_id", txt.compact_ascii("text").alias("compact"), txt.trim_text("text", 120).alias("trimmed"), txt.replace_all("text", {"the": "<1>", "<1>n": "<2>"}).alias("replaced"), txt.embedding_text("source", "lang", F.lit(""), "text").alias("embedded")
    )


def match_queries(spark, sf_dir):
    """The longest terms of a text as a full-text query."""
    return _docs(spark, sf_dir).select("doc_id", txt.match_query(txt.match_terms("text")).alias("query"))


def parser_queries(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", txt.parser_query("text").alias("query"))


def unique_tokens(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.array_join(txt.unique_tokens("text"), " ").alias("tokens"))


def marker_counts(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", txt.count_of("text", ("The", "and", "nation", "%", "qq")).cast("long").alias("n"), txt.contains_any("text", ("Heat", "$"), lower=True).alias("some"))


def stable_ids(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", txt.stable_hash("text").alias("hash"), txt.chunk_uid("source", "doc_id", txt.stable_hash("text")).alias("uid"), txt.source_id("source", "doc_id").alias("source_id"))


def snippets(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", txt.snippet("text", txt.query_tokens(F.lit("nation heat the"))).alias("snippet"))


def mixed_tokens(spark, sf_dir):
    """Tokens of both scripts, over documents whose vowels are written as CJK characters."""
    mixed = _docs(spark, sf_dir).select(F.explode(txt.tokens(F.translate("text", "aeiou", "学院的介绍"))).alias("token"))
    return mixed.groupBy("token").agg(F.count("*").alias("n"))


# extraction


def date_extract(spark, sf_dir):
    """Dates written in four ways, one of them wrong at first."""
    day = lambda f: F.date_format("ts", f)
    ways = (F.concat(F.lit("on "), day("yyyy-MM-dd"), F.lit(" or 2020-01-01")), F.concat(F.lit("x"), day("yyyy/M"), F.lit(" y")), F.concat(day("yyyy"), F.lit("年"), day("M"), F.lit("月"), day("d")), F.concat(F.lit("2024.13.01 then "), day("yyyy-MM-dd")))
    text = F.element_at(F.array(*ways), F.pmod("event_id", F.lit(4)).cast("int") + 1)
    events = table(spark, sf_dir, "events").withColumn("t", text)
    return events.groupBy(extract.date("t").alias("date"), extract.valid_date("t").alias("valid_date")).agg(F.count("*").alias("n"))


def code_extract(spark, sf_dir):
    """Codes and years of part names, types and keys."""
    named = table(spark, sf_dir, "part").withColumn("t", F.concat(F.lit("CS"), F.col("p_partkey") % 1000, F.lit(", MATH"), F.col("p_size") + 1000, F.lit("A x20"), F.col("p_partkey") % 90 + 10, F.lit(" see CS101")))
    return named.select("p_partkey", F.array_join(extract.codes("t"), ",").alias("codes"), F.array_join(extract.years("t"), ",").alias("years"), extract.first_number("t").alias("number"))


def topic_terms(spark, sf_dir):
    """Topics of questions made of each document's language and source."""
    k, lang, source = F.col("doc_id") % 5, F.col("lang"), F.col("source")
    question = F.when(k == 0, F.concat(F.lit("我想做"), lang, F.lit("方向"))).when(k == 1, F.concat(F.lit("研究"), source, F.lit("的学院老师"))).when(k == 2, F.concat(lang, F.lit(" "), source)).when(k == 3, F.concat(F.lit("research "), source, F.lit("a "), source))
    return _docs(spark, sf_dir).select("doc_id", F.array_join(extract.expanded_topics(question, {"en": ("english", "EN"), "fr": ("french",)}, places=("学院",)), "|").alias("topics"))


def url_forms(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", extract.file_name("url").alias("file"), extract.source_key("url", F.lit("")).alias("key"), extract.source_key(F.lit(""), "url").alias("path_key"))


def allowed_hosts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", extract.allowed_host(extract.host("url"), ["example.org"], [".example.org", ".com"]).alias("allowed"))


def file_kinds(spark, sf_dir):
    return evaluate.extensions(table(spark, sf_dir, "pages").select(F.concat(extract.url_path("url"), F.lit(".X"), F.col("page_id") % 7).alias("path")))


def longest_words(spark, sf_dir):
    """The longest word before a certain one in the documents of each source."""
    hits = _docs(spark, sf_dir).select(F.col("source").alias("query_id"), F.col("doc_id").alias("rank"), "text")
    return evaluate.longest_match(hits, [r"\b([a-z]+ nation)\b"])


# quality


def tier_scores(spark, sf_dir):
    docs = _docs(spark, sf_dir).withColumn("url", F.when(F.col("source") == "src1", "").when(F.col("source") == "src2", "https://www.example.org/a").otherwise("https://noise.example.com/b"))
    tier = F.when(F.col("lang") == "en", "verified_seed").when(F.col("lang") == "de", "live_official").otherwise("other")
    domain = quality.Domain(hosts=("www.example.org",), noise_hosts=("noise.example.com",), favoured_categories=("en",))
    return docs.withColumn("tier", tier).select("doc_id", F.round(quality.tier_quality("tier", "lang", "url", "text", domain), 4).alias("quality"), F.round(quality.structured_quality(F.col("n_chars") / 1000.0, F.lit(0.5)), 6).alias("structured"))


# answers and rankings


def score_answers(spark, sf_dir):
    """Documents as answers, by the four kinds of targets."""
    kind = F.element_at(F.array(*map(F.lit, ("contains_all", "contains_any", "exact_any", "regex"))), F.pmod("doc_id", F.lit(4)).cast("int") + 1)
    groups = lambda *g: F.array(*[F.array(*map(F.lit, x)) for x in g])
    targets = F.when(kind == "contains_all", groups(("The",), ("nation", "ation "))).when(kind == "contains_any", groups(("zzz",), ("HEAT", "was the"))).when(kind == "exact_any", groups(("src1", "Src2"))).otherwise(groups(("n[a-z]+tion[.,]", "^zz")))
    items = _docs(spark, sf_dir).withColumns({"kind": kind, "targets": targets, "answer": F.when(kind == "exact_any", F.concat(F.col("source"), F.lit(" "))).otherwise(F.col("text"))})
    return items.withColumn("form", txt.answer_form("answer")).select("doc_id", evaluate.score("answer", "form", "kind", "targets").alias("correct"))


def test_set_problems(spark, sf_dir):
    return evaluate.accuracy(_docs(spark, sf_dir).withColumn("ok", F.length("text") > 500), "ok", ["source", "lang"]).select("source", "lang", "correct", "total", F.round("accuracy", 6).alias("accuracy"))


def llm_rank_apply(spark, sf_dir):
    """The ten longest documents of each source, in an order that leaves out some and names others twice or wrongly."""
    hits = _docs(spark, sf_dir).select(F.col("source").alias("query_id"), F.col("doc_id").alias("chunk_id"), F.col("n_chars").cast("double").alias("score"))
    order = hits.select("query_id").distinct().withColumn("indices", F.when(F.col("query_id") == "src1", F.array().cast("array<int>")).otherwise(F.array(*map(F.lit, (3, 99, 3, 1, 0)))))
    return rank.apply_ranking(rank.top_k(hits, 10), order, 8).select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"))


def promoted_hits(spark, sf_dir):
    """Documents of each language by size, with those of a precise list first."""
    docs = _docs(spark, sf_dir).select(F.col("lang").alias("query_id"), F.col("doc_id").alias("chunk_id"), F.col("n_chars").cast("double").alias("score"), "source")
    precise = docs.filter("source = 'src1'").withColumns({"raw": F.col("score"), "score": F.col("chunk_id").cast("double")})
    return rank.promote(rank.top_k(docs, 20), precise, 12).select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"))


def multi_key_order(spark, sf_dir):
    """Ordering by conditions first: documents of a source, then of a language, then by size."""
    docs = _docs(spark, sf_dir).withColumn("one", F.lit(1))
    order = [(F.col("source") == "src1").desc(), (F.col("lang") == "fr").desc(), F.desc("n_chars"), F.col("doc_id")]
    return rank.top_k(docs, 40, ["one"], order).select("doc_id", "source", "lang", "n_chars")


def fts_by_category(spark, sf_dir):
    from .queries import asked

    docs = _docs(spark, sf_dir).withColumnRenamed("doc_id", "chunk_id").withColumn("category", F.col("lang"))
    scored = rank.fts_bm25(docs, asked(spark), categories=("de", "fr"))
    return rank.top_k(scored.withColumn("score", F.round("score", 6)), 10).select("query_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


# Queries with tokens of several parts.
_PHRASED = "(VALUES (1::BIGINT, 'the nation of example.org'), (2, 'heat.tion that-with c++ c'), (3, 'des-les de_la. de.la et'))"


def fts_phrases(spark, sf_dir):
    """Full-text search whose index splits tokens again: tokens of several parts are phrases."""
    queries = spark.createDataFrame([(1, "the nation of example.org"), (2, "heat.tion that-with c++ c"), (3, "des-les de_la. de.la et")], "query_id long, query string")
    docs = _docs(spark, sf_dir).withColumnRenamed("doc_id", "chunk_id")
    scored = rank.fts_phrases(docs, queries).withColumn("score", F.round("score", 6))
    return rank.top_k(scored, 50).select("query_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


def _chunks(spark, sf_dir) -> DataFrame:
    category = F.when(F.col("source") == "src1", "courses").when(F.col("source") == "src2", "contacts").otherwise("web")
    kind = F.when(F.col("lang") == "en", "pdf_md").when(F.col("lang") == "de", "training").otherwise("other")
    date = F.when(F.col("lang") == "fr", "2024-05").otherwise("")
    body = F.when(F.col("source") == "src1", F.concat(F.lit("课程代码: CS101 "), F.col("text"))).when(F.col("source") == "src2", F.concat(F.lit("XCS101 of 2023 "), F.col("text"))).when(F.col("source") == "src3", F.concat(F.lit("see CS101, 2024 "), F.col("text"))).otherwise(F.col("text"))
    return _docs(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("title"), body.alias("text"), F.lit("").alias("url"), F.lit("").alias("path"), date.alias("date"), category.alias("category"), kind.alias("source_type"), (F.col("n_chars") % 100 / 100.0).alias("quality"))


def _asked(spark):
    return routes.parsed(spark.createDataFrame([(1, "CS101 学分 nation"), (2, "office 2024 2025 heat")], "query_id long, query string"))


def rule_rerank(spark, sf_dir):
    """Every document as a hit of two queries, ranked by the rules."""
    chunks = _chunks(spark, sf_dir)
    hits = chunks.select(F.explode(F.expr("array(1L, 2L)")).alias("query_id"), "chunk_id", F.lit(10.0).alias("score"))
    return routes.rule_rerank(hits, chunks, _asked(spark)).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


def exact_candidates(spark, sf_dir):
    return routes.exact_candidates(_chunks(spark, sf_dir), _asked(spark), 30).select("query_id", "chunk_id", "score")


def name_alike(spark, sf_dir):
    """Names of nations against each other."""
    names = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    pairs = names.alias("a").join(names.alias("b"), F.col("a.n_nationkey") <= F.col("b.n_nationkey"))
    return pairs.select(F.col("a.n_name").alias("a"), F.col("b.n_name").alias("b"), hop.alike(F.col("a.n_name"), F.col("b.n_name")).alias("alike"))


def person_lines(spark, sf_dir):
    """Persons in lines of names made for each document: both scripts, Latin alone, and two persons before one parenthesis."""
    # Names in two scripts.
    han, latin = (F.array(*map(F.lit, x)) for x in (("张三", "李四", "王小明", "赵敏"), ("San Zhang", "Si Li", "Xiaoming Wang", "Min Zhao")))
    a, b = F.pmod("doc_id", F.lit(4)).cast("int"), F.expr("cast(doc_id div 4 % 4 AS int)")
    kind = F.expr("doc_id div 16 % 3")
    two = F.concat(F.get(han, a), F.lit("、"), F.get(han, b), F.lit("("), F.get(latin, a), F.lit(", "), F.get(latin, b), F.lit(")"))
    line = F.when(kind == 0, F.concat(F.get(han, a), F.lit("("), F.get(latin, a), F.lit(")"))).when(kind == 1, F.get(latin, a)).otherwise(two)
    rows = _docs(spark, sf_dir).select("doc_id", F.posexplode(hop.persons(line)).alias("pos", "p"))
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), "p.cjk", "p.latin")


def reply_shapes(spark, sf_dir):
    """Replies of three shapes made of each turn of a conversation, read back."""
    name, kind = F.concat(F.lit("k"), F.col("conv_id")), F.col("turn") % 3
    fenced = F.concat(F.lit('```json\n{"keywords": ["'), "role", F.lit('", "'), name, F.lit('"]}\n```'))
    action = F.concat(F.lit('{"action": "search", "query": "x", "keywords": ["'), name, F.lit('"]}'))
    reply = F.when(kind == 0, fenced).when(kind == 1, F.concat(F.lit("alpha, "), "role", F.lit("; "), name)).otherwise(action)
    decision = assist.parse_decision(reply)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(assist.parse_keywords(reply), "|").alias("keywords"), decision["action"].alias("action"))


def hit_classes(spark, sf_dir):
    """Hits of nine shapes around every document, for one code and two persons."""
    k = F.pmod("doc_id", F.lit(9)).cast("int")
    leads = ("# cs101 ", "任课教师 CS101, ", "任课教师 课程代码: CS101x ", "任课教师 XCS101 ", "Research Interests: ", "办公室: 1 ", "张三老师 ", "张三丰 ", "by Ada-LOVElace ")
    docs = _docs(spark, sf_dir).select("doc_id", F.concat(F.element_at(F.array(*map(F.lit, leads)), k + 1), "text").alias("text"), "source", "lang")
    pages = docs.select(
        "doc_id",
        "text",
        F.when(F.col("source") == "src3", "cs101").when(F.col("source") == "src4", "My HomePage").otherwise(F.col("source")).alias("title"),
        F.when(F.col("lang") == "fr", "https://a.example/Faculty/1").when(F.col("lang") == "de", "https://a.example/courses/1").otherwise("https://a.example/1").alias("url"),
        F.when(F.col("source") == "src1", "courses").when(F.col("source") == "src2", "contacts").otherwise("web").alias("category"),
        F.array(F.lit("CS101")).alias("codes"),
        F.expr("array(named_struct('cjk', '张三', 'latin', ''), named_struct('cjk', '', 'latin', 'Ada Lovelace'))").alias("persons"),
    )
    return hits.hit_classes(pages).select("doc_id", "primary_record", "loose_record", "profile", "names_person")


def think_split(spark, sf_dir):
    """Replies of eight shapes around every document."""
    text = F.col("text")
    shapes = (
        F.concat(F.lit(" <think>"), text, F.lit("</think>\n"), "source"), text, F.concat(F.lit("Here's a thinking process:"), text), F.concat(F.lit("Thinking process: "), text, F.lit("</think>"), "lang", F.lit(" </think> x")),
        F.concat(F.lit("思考过程"), text), F.concat(F.lit("\n Here is a thinking process:"), text), F.concat(F.lit("Thinking Process: "), text), F.concat(text, F.lit("</think>"), "source"),
    )
    think, answer = assist.split_thinking("reply")
    return _docs(spark, sf_dir).withColumn("reply", F.element_at(F.array(*shapes), F.pmod("doc_id", F.lit(8)).cast("int") + 1)).select("doc_id", think.alias("think"), answer.alias("answer"))


_RULE_SQL = r"""WITH c AS (SELECT doc_id, source, lang, n_chars, CASE source WHEN 'src1' THEN '课程代码: CS101 ' WHEN 'src2' THEN 'XCS101 of 2023 ' WHEN 'src3' THEN 'see CS101, 2024 ' ELSE '' END || text AS body FROM documents),
h AS (SELECT *, source || chr(10) || body AS hay FROM c), r AS (SELECT *, lower(hay) AS low, regexp_replace(lower(hay), '[^a-z0-9]+', '', 'g') AS compact, regexp_replace(lower(substr(body, 1, 1800)), '[^a-z0-9]+', '', 'g') AS head,
  regexp_extract_all(hay, '20\d{2}') AS ys, (n_chars % 100) / 100.0::DOUBLE AS quality FROM h),
b AS (SELECT *, 10.0::DOUBLE + 4.0 * quality + CASE lang WHEN 'de' THEN 5.0::DOUBLE WHEN 'en' THEN {pdf} ELSE 1.0 END + CASE WHEN source IN ('src1', 'src2') THEN 1.5 ELSE 0 END - CASE WHEN lang = 'en' THEN 2 ELSE 0 END AS base FROM r)
SELECT 1::BIGINT AS query_id, doc_id AS chunk_id, round(base
  + CASE WHEN contains(low, 'cs101') THEN 5 * 0.35::DOUBLE ELSE 0 END + CASE WHEN contains(low, 'nation') THEN 6 * 0.35::DOUBLE ELSE 0 END + CASE WHEN contains(low, '学分') THEN 2 * 0.35::DOUBLE ELSE 0 END
  + CASE WHEN contains(head, 'nation') THEN 28 WHEN contains(compact, 'nation') THEN 12 ELSE 0 END
  + CASE source WHEN 'src1' THEN 45 + 10 WHEN 'src3' THEN 18 - 8 ELSE -30 - 8 END, 6) AS score FROM b
UNION ALL SELECT 2::BIGINT, doc_id, round(base
  + CASE WHEN contains(low, 'office') THEN 6 * 0.35::DOUBLE ELSE 0 END + CASE WHEN contains(low, '2024') THEN 4 * 0.35::DOUBLE ELSE 0 END + CASE WHEN contains(low, '2025') THEN 4 * 0.35::DOUBLE ELSE 0 END + CASE WHEN contains(low, 'heat') THEN 4 * 0.35::DOUBLE ELSE 0 END
  + CASE WHEN contains(head, 'office') THEN 28 WHEN contains(compact, 'office') THEN 12 ELSE 0 END + CASE WHEN contains(head, 'heat') THEN 28 WHEN contains(compact, 'heat') THEN 12 ELSE 0 END
  + CASE WHEN lang = 'fr' OR contains(hay, '2024') OR contains(hay, '2025') THEN 16 + CASE WHEN lang = 'fr' THEN 8 ELSE 0 END ELSE -22 END
  + CASE WHEN len(ys) > 0 AND NOT list_has_any(ys, ['2024', '2025']) THEN -14 ELSE 0 END
  + CASE WHEN source = 'src2' THEN 8 ELSE 0 END + CASE WHEN contains(low, 'email') OR contains(low, 'office') OR contains(body, '邮箱:') OR contains(body, '办公室') THEN 4 ELSE 0 END, 6) FROM b"""


def _rule_sql() -> str:
    from ..functions import fixed

    return _RULE_SQL.replace("{pdf}", repr(float(fixed.SOURCE_PRIORITY["pdf_md"])))


#: Name: query and SQL.
WHOLE = {
    "normal_texts": (normal_texts, f"""SELECT doc_id, array_to_string(list_filter(list_transform(string_split(regexp_replace(replace(text, '　', ' '), '\\r\\n?', chr(10), 'g'), chr(10)), lambda x: {_strip(f"regexp_replace(x, '[{_S}]+', ' ', 'g')")}), lambda x: x <> ''), chr(10)) AS plain,
  {_strip("regexp_replace(regexp_replace(replace(text, '　', ' '), '(?i)&(?:nbsp|amp|lt|gt|quot);', ' ', 'g'), '[ \\t]+', ' ', 'g')")} AS line FROM documents"""),
    "text_forms": (text_forms, f"""SELECT doc_id, regexp_replace(lower(text), '[^a-z0-9]+', '', 'g') AS compact, CASE WHEN length(text) <= 120 THEN text ELSE regexp_replace(substr(text, 1, 117), '[{_S}]+$', '') || '...' END AS trimmed,
  replace(replace(text, 'the', '<1>'), '<1>n', '<2>') AS replaced, substr(concat_ws(chr(10), source, lang, nullif(text, '')), 1, 1800) AS embedded FROM documents"""),
    "match_queries": (match_queries, f"""WITH {_PLACED}, d AS (SELECT DISTINCT doc_id, t FROM p), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length(t) DESC, t DESC) AS k FROM d)
SELECT doc_id, coalesce(string_agg('"' || t || '"', ' OR ' ORDER BY k) FILTER (k <= 48), '') AS query FROM documents LEFT JOIN k USING (doc_id) GROUP BY doc_id"""),
    "parser_queries": (parser_queries, rf"""SELECT doc_id, {_strip(r"regexp_replace(regexp_replace(text, '[^\p{L}\p{M}\p{N}_+#.\-]+', ' ', 'g'), '\s+', ' ', 'g')")} AS query FROM documents"""),
    "unique_tokens": (unique_tokens, f"""WITH {_PLACED}, d AS (SELECT doc_id, t, min(i) AS i FROM p WHERE length(t) >= 2 GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM d)
SELECT doc_id, coalesce(string_agg(t, ' ' ORDER BY k) FILTER (k <= 2400), '') AS tokens FROM documents LEFT JOIN k USING (doc_id) GROUP BY doc_id"""),
    "marker_counts": (marker_counts, "SELECT doc_id, contains(lower(text), 'the')::BIGINT + contains(lower(text), 'and')::BIGINT + contains(lower(text), 'nation')::BIGINT + contains(text, '%')::BIGINT + contains(lower(text), 'qq')::BIGINT AS n, contains(lower(text), 'heat') OR contains(text, '$') AS some FROM documents"),
    "stable_ids": (stable_ids, "SELECT doc_id, substr(sha1(text), 1, 16) AS hash, substr(sha1(source || ':' || doc_id || ':' || substr(sha1(text), 1, 16)), 1, 32) AS uid, source || '#chunk=' || doc_id AS source_id FROM documents"),
    "snippets": (snippets, f"""WITH t AS (SELECT doc_id, text, length(text) AS n, nullif(coalesce(nullif(strpos(lower(text), 'nation'), 0), nullif(strpos(lower(text), 'heat'), 0), strpos(lower(text), 'the')), 0) - 1 AS hit FROM documents),
w AS (SELECT *, greatest(0, hit - 80) AS l FROM t), x AS (SELECT *, least(n, l + 240) AS r FROM w)
SELECT doc_id, CASE WHEN n <= 240 THEN text WHEN hit IS NULL THEN {_strip("substr(text, 1, 240)")} ELSE CASE WHEN l > 0 THEN '...' ELSE '' END || {_strip("substr(text, (l + 1)::BIGINT, (r - l)::BIGINT)")} || CASE WHEN r < n THEN '...' ELSE '' END END AS snippet FROM x"""),
    "mixed_tokens": (mixed_tokens, r"""WITH m AS (SELECT translate(text, 'aeiou', '学院的介绍') AS t FROM documents), w AS (SELECT unnest(regexp_extract_all(lower(t), '[a-zA-Z][a-zA-Z0-9_+#.-]*|\d+(?:\.\d+)?')) AS token FROM m),
r AS (SELECT unnest(regexp_extract_all(t, '[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]+')) AS run FROM m), g AS (SELECT run, count(*) AS n FROM r GROUP BY run), x AS (SELECT token, 1 AS n FROM w UNION ALL SELECT run, n FROM g WHERE length(run) <= 8
  UNION ALL SELECT substr(run, i, k), n FROM (SELECT run, n, k, unnest(range(1, length(run) - k + 2)) AS i FROM g, (VALUES (1), (2), (3)) v(k)) WHERE k > 1 OR NOT contains('的一是在了和与及或对中为有个们于年月日', substr(run, i, k)))
SELECT token, sum(n)::BIGINT AS n FROM x GROUP BY token"""),
    "date_extract": (date_extract, "WITH e AS (SELECT event_id % 4 AS k, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y-%m') AS month FROM events), d AS (SELECT CASE k WHEN 1 THEN month WHEN 3 THEN '2024-13-01' ELSE day END AS date, CASE k WHEN 1 THEN month ELSE day END AS valid_date FROM e) SELECT date, valid_date, count(*) AS n FROM d GROUP BY ALL"),
    "code_extract": (code_extract, r"""WITH t AS (SELECT p_partkey, 'CS' || p_partkey % 1000 || ', MATH' || p_size + 1000 || 'A x20' || p_partkey % 90 + 10 || ' see CS101' AS t FROM part)
SELECT p_partkey, array_to_string(list_sort(list_distinct(regexp_extract_all(t, '\b[A-Z]{2,}\d{2,4}[A-Z]?\b'))), ',') AS codes, array_to_string(list_sort(list_distinct(regexp_extract_all(t, '20\d{2}'))), ',') AS years, regexp_extract(t, '-?\d+(?:\.\d+)?')::DOUBLE AS number FROM t"""),
    "topic_terms": (topic_terms, "WITH t AS (SELECT doc_id, doc_id % 5 AS k, source, lang || CASE lang WHEN 'en' THEN '|english' WHEN 'fr' THEN '|french' ELSE '' END AS l FROM documents) SELECT doc_id, CASE k WHEN 0 THEN l WHEN 1 THEN source WHEN 2 THEN l || '|' || source WHEN 3 THEN source || 'a' ELSE '' END AS topics FROM t"),
    "url_forms": (url_forms, r"""WITH u AS (SELECT page_id, url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host, regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '^/+|/+$', '', 'g'), '[^A-Za-z0-9._/-]+', '_', 'g') AS p, regexp_extract(url, '\?([^#]*)', 1) AS q FROM pages)
SELECT page_id, replace(host, ':', '_') || '/' || CASE WHEN p = '' THEN 'index' ELSE p END || CASE WHEN q <> '' THEN '_' || substr(md5(q), 1, 8) ELSE '' END AS file,
  CASE WHEN coalesce(url, '') <> '' THEN 'url:' || lower(regexp_replace(regexp_replace(url, '[#?].*$', ''), '/+$', '')) ELSE 'path:' END AS key, 'path:' || lower(regexp_replace(regexp_replace(url, '#chunk=\d+.*$', ''), '/+$', '')) AS path_key FROM u"""),
    "allowed_hosts": (allowed_hosts, r"WITH u AS (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host FROM pages) SELECT page_id, host = 'example.org' OR ends_with(host, '.example.org') OR ends_with(host, '.com') AS allowed FROM u"),
    "file_kinds": (file_kinds, "SELECT 'x' || page_id % 7 AS ext, count(*) AS n FROM pages GROUP BY 1"),
    "longest_words": (longest_words, r"""WITH m AS (SELECT source AS query_id, doc_id AS rank, unnest(regexp_extract_all(text, '(?i)\b([a-z]+ nation)\b', 1)) AS value FROM documents)
SELECT query_id, value, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY length(value) DESC, rank, value) AS k FROM m) WHERE k = 1"""),
    "tier_scores": (tier_scores, None),
    "score_answers": (score_answers, rf"""WITH f AS (SELECT doc_id, source, text, regexp_replace(translate(lower(text), '（），。“”’', '(),.""' || chr(39)), '[{_S}]+', '', 'g') AS form FROM documents)
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN contains(form, 'the') AND (contains(form, 'nation') OR contains(form, 'ation')) WHEN 1 THEN contains(form, 'zzz') OR contains(form, 'heat') OR contains(form, 'wasthe')
  WHEN 2 THEN source IN ('src1', 'src2') ELSE regexp_matches(text, '(?is)n[a-z]+tion[.,]') OR regexp_matches(form, '(?is)n[a-z]+tion[.,]') OR regexp_matches(text, '(?is)^zz') OR regexp_matches(form, '(?is)^zz') END AS correct FROM f"""),
    "test_set_problems": (test_set_problems, "SELECT source, lang, sum((length(text) > 500)::INT)::BIGINT AS correct, count(*) AS total, round(avg((length(text) > 500)::INT), 6) AS accuracy FROM documents GROUP BY ALL"),
    "llm_rank_apply": (llm_rank_apply, """WITH h AS (SELECT source AS query_id, doc_id AS chunk_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents), c AS (SELECT *, CASE WHEN query_id = 'src1' THEN NULL WHEN r = 3 THEN 0 WHEN r = 1 THEN 3 END AS place FROM h WHERE r <= 10)
SELECT query_id, chunk_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place IS NULL, place, r) AS rank FROM c) WHERE rank <= 8"""),
    "promoted_hits": (promoted_hits, """WITH h AS (SELECT lang AS query_id, doc_id AS chunk_id, source, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS r FROM documents),
p AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY chunk_id DESC) AS r FROM h WHERE source = 'src1' AND chunk_id >= 300),
b AS (SELECT query_id, chunk_id, min(k) AS k FROM (SELECT query_id, chunk_id, r AS k FROM p WHERE r <= 3 UNION ALL SELECT query_id, chunk_id, 100 + r FROM h WHERE r <= 20) GROUP BY ALL)
SELECT query_id, chunk_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY k) AS rank FROM b) WHERE rank <= 12"""),
    "multi_key_order": (multi_key_order, "SELECT doc_id, source, lang, n_chars FROM documents ORDER BY source = 'src1' DESC, lang = 'fr' DESC, n_chars DESC, doc_id LIMIT 40"),
    "fts_by_category": (fts_by_category, None),
    "fts_phrases": (fts_phrases, rf"""WITH q(query_id, query) AS {_PHRASED}, d AS (SELECT doc_id, {_PARTS % f"array_to_string({_tokens('text')}, ' ')"} AS parts FROM documents),
st AS (SELECT count(*)::DOUBLE AS n, sum(len(parts))::DOUBLE / count(*) AS avg_len FROM d WHERE len(parts) > 0),
qt AS (SELECT query_id, array_to_string({_PARTS % 'token'}, ' ') AS phrase, count(*) AS qtf FROM (SELECT DISTINCT query_id, unnest({_tokens('query')}) AS token FROM q) GROUP BY ALL),
g AS (SELECT doc_id, len(parts) AS len, unnest(parts) AS phrase FROM d UNION ALL SELECT doc_id, len(parts), unnest(list_transform(range(1, len(parts)), lambda i: parts[i] || ' ' || parts[i + 1])) FROM d),
p AS (SELECT doc_id, phrase, any_value(len) AS len, count(*) AS tf FROM g SEMI JOIN qt USING (phrase) GROUP BY doc_id, phrase), df AS (SELECT phrase, count(*)::DOUBLE AS df FROM p GROUP BY phrase),
s AS (SELECT query_id, doc_id AS chunk_id, round(sum(qtf * greatest(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 1e-6::DOUBLE) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avg_len))), 6) AS score FROM p JOIN df USING (phrase) JOIN qt USING (phrase) CROSS JOIN st GROUP BY ALL)
SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 50"""),
    "rule_rerank": (rule_rerank, _rule_sql()),
    "exact_candidates": (exact_candidates, r"""WITH c AS (SELECT doc_id, n_chars, lower(source || chr(10) || CASE source WHEN 'src1' THEN '课程代码: CS101 ' WHEN 'src2' THEN 'XCS101 of 2023 ' WHEN 'src3' THEN 'see CS101, 2024 ' ELSE '' END || text || chr(10) || chr(10) || CASE WHEN lang = 'fr' THEN '2024-05' ELSE '' END) AS hay FROM documents),
q AS (SELECT 1::BIGINT AS query_id, * FROM c WHERE contains(hay, 'cs101') OR contains(hay, '学分') OR contains(hay, 'nation') UNION ALL SELECT 2, * FROM c WHERE contains(hay, '2024') OR contains(hay, '2025') OR contains(hay, 'office') OR contains(hay, 'heat'))
SELECT query_id, doc_id AS chunk_id, 20.0::DOUBLE AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY (n_chars % 100) DESC, doc_id) AS k FROM q) WHERE k <= 30"""),
    "name_alike": (name_alike, "SELECT a.n_name AS a, b.n_name AS b, a.n_name = b.n_name OR (len(list_intersect(list_distinct(string_split(a.n_name, '')), string_split(b.n_name, ''))) >= 2 AND len(list_intersect(list_distinct(string_split(a.n_name, '')), string_split(b.n_name, ''))) >= least(length(a.n_name), length(b.n_name)) - 1) AS alike FROM nation a JOIN nation b ON a.n_nationkey <= b.n_nationkey"),
    "person_lines": (person_lines, """WITH n AS (SELECT ['张三', '李四', '王小明', '赵敏'] AS h, ['San Zhang', 'Si Li', 'Xiaoming Wang', 'Min Zhao'] AS l), t AS (SELECT doc_id, doc_id % 4 AS a, doc_id // 4 % 4 AS b, doc_id // 16 % 3 AS k FROM documents)
SELECT doc_id, 0::BIGINT AS pos, CASE k WHEN 1 THEN '' ELSE h[a + 1] END AS cjk, l[a + 1] AS latin FROM t, n UNION ALL SELECT doc_id, 1, h[b + 1], l[b + 1] FROM t, n WHERE k = 2 AND a <> b"""),
    "reply_shapes": (reply_shapes, "SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN role || '|k' || conv_id WHEN 1 THEN 'alpha|' || role || '|k' || conv_id ELSE 'k' || conv_id END AS keywords, CASE turn % 3 WHEN 0 THEN 'answer' ELSE 'search' END AS action FROM conversations"),
    "hit_classes": (hit_classes, r"""WITH h AS (SELECT doc_id, ['# cs101 ', '任课教师 CS101, ', '任课教师 课程代码: CS101x ', '任课教师 XCS101 ', 'Research Interests: ', '办公室: 1 ', '张三老师 ', '张三丰 ', 'by Ada-LOVElace '][(doc_id % 9 + 1)::INT] || text AS text,
  CASE source WHEN 'src3' THEN 'cs101' WHEN 'src4' THEN 'My HomePage' ELSE source END AS title, CASE lang WHEN 'fr' THEN 'https://a.example/Faculty/1' WHEN 'de' THEN 'https://a.example/courses/1' ELSE 'https://a.example/1' END AS url,
  CASE source WHEN 'src1' THEN 'courses' WHEN 'src2' THEN 'contacts' ELSE 'web' END AS category FROM documents),
t AS (SELECT *, title || chr(10) || text || chr(10) || url AS hay, contains(text, '任课教师') AS taught FROM h)
SELECT doc_id, (category = 'courses' OR taught) AND (upper(title) = 'CS101' OR contains(text, '课程代码: CS101') OR regexp_matches(text, '(?i)^#\s*cs101\b')) AS primary_record,
  taught AND regexp_matches(upper(title || chr(10) || text), '(^|[^A-Z0-9])CS101($|[^A-Z0-9])') AS loose_record,
  category <> 'courses' AND NOT regexp_matches(lower(url), 'courses|schedule') AND (category = 'contacts' OR regexp_matches(lower(url), 'faculty|main[.]htm') OR contains(lower(title), 'homepage') OR contains(title, '主页')
    OR regexp_matches(lower(substr(text, 1, 1400)), 'research interests|contact me') OR regexp_matches(substr(text, 1, 1200), '(个人主页|研究方向|博士毕业院校|邮箱|办公室):')) AS profile,
  regexp_matches(hay, '(^|[^\x{4e00}-\x{9fff}])张三($|[^\x{4e00}-\x{9fff}]|博士|教授|老师|导师|副教授|研究员|的)') OR contains(regexp_replace(lower(hay), '[^a-z0-9]+', '', 'g'), 'adalovelace') AS names_person FROM t"""),
    "think_split": (think_split, f"""WITH d AS (SELECT doc_id, doc_id % 8 AS k, {_strip('text')} AS t, source, lang FROM documents)
SELECT doc_id, CASE WHEN k IN (1, 4, 6) THEN '' ELSE t END AS think, CASE k WHEN 0 THEN source WHEN 1 THEN t WHEN 3 THEN lang || ' </think> x' WHEN 4 THEN {_strip("'思考过程' || text")} WHEN 6 THEN {_strip("'Thinking Process: ' || text")} WHEN 7 THEN source ELSE '' END AS answer FROM (SELECT d.*, text FROM d JOIN documents USING (doc_id))"""),
}
