"""Rules as data: query intents, routed candidates and feature reranking.

An intent is found by trigger words in the query; a route turns an intent into a filter on chunks; a feature adds
weight to a hit. All three are rows of a rule list, so a corpus brings its own without code.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.extract import codes, emails, entities, names, years
from ..functions.text import compact_ascii, expand, query_tokens
from .rank import top_k


@dataclass(frozen=True)
class Intent:
    """A query has the intent if it holds a trigger (any case) and, where given, one of ``also`` too, and none of ``unless``."""

    name: str
    triggers: tuple[str, ...]
    also: tuple[str, ...] = ()
    unless: tuple[str, ...] = ()


@dataclass(frozen=True)
class Route:
    """Chunks of the categories, or of the source types at paths like a pattern, that hold what the query names.

    ``needs``: which of the query's codes, years and names must occur in the chunk, where the query has any.
    """

    intent: str
    categories: tuple[str, ...] = ()
    source_types: tuple[str, ...] = ()
    path_like: str | None = None
    url_like: str | None = None
    needs: tuple[str, ...] = ("codes", "years")


@dataclass(frozen=True)
class Feature:
    """``weight`` where ``field op pattern`` holds (op: equals, contains, like, matches), for queries with ``intent`` (any if None); ``otherwise`` where it doesn't."""

    weight: float
    field: str
    op: str
    pattern: str
    intent: str | None = None
    otherwise: float = 0.0


# The triggers of common intents.
INTENTS = (
    Intent("degree", ("培养方案", "degree program", "degree programmes", "program requirements", "bachelor", "master", "ph.d", "phd", "博士", "硕士", "本科", "毕业要求", "学位")),
    Intent("course", ("课程", "course", "courses", "任课", "老师", "instructor", "学分", "课程代码", "course code", "semester", "spring", "fall")),
    Intent("faculty", ("教授", "教师", "导师", "faculty", "professor", "邮箱", "email", "办公室", "office", "研究方向", "research interests", "个人主页")),
    Intent("contact", ("地址", "contact", "联系我们", "campus", "校区")),
)
FIELDS = ("codes", "years", "names", "entities", "emails")


def parsed(queries: DataFrame, intents: Sequence[Intent] = INTENTS, dictionary=fixed.EXPANSIONS) -> DataFrame:
    """Queries with ``intents, codes, years, names, entities, emails, terms`` (terms: tokens of the expanded query)."""
    low = F.lower("query")
    any_of = lambda words: reduce(lambda a, b: a | b, (low.contains(w.lower()) for w in words), F.lit(False))
    found = [F.when(any_of(i.triggers) & (any_of(i.also) if i.also else F.lit(True)) & ~any_of(i.unless), F.lit(i.name)) for i in intents]
    return queries.select("*", F.array_compact(F.array(*found)).alias("intents"), codes("query").alias("codes"), years("query").alias("years"), names("query").alias("names"), entities("query").alias("entities"), emails("query").alias("emails"), query_tokens(expand("query", dictionary)).alias("terms"))


def _holds(chunk_text: Column, wanted: Column) -> Column:
    return F.exists(wanted, lambda w: F.contains(chunk_text, F.lower(w)))


def _candidates(chunks: DataFrame, queries: DataFrame, condition, score: float, k: int, order: Sequence[Column] = (), most: int = 10_000) -> DataFrame:
    """Every chunk against every query of a stated set: about ``most`` queries are one broadcast array, each such block one scan of the chunks."""
    count = max(1, -(-queries.count() // most))
    found = []
    for n in range(count):
        block = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(count)) == n) if count > 1 else queries
        held = block.select(F.struct(*queries.columns).alias("q")).groupBy().agg(F.collect_list("q").alias("qs"))
        hit = chunks.join(F.broadcast(held)).select(*chunks.columns, F.explode(F.filter("qs", condition)).alias("q"))
        ranked = top_k(hit.withColumn("query_id", F.col("q.query_id")), k, order=[*order, F.desc("quality"), F.col("chunk_id")])
        found.append(ranked.select("query_id", "chunk_id", F.lit(float(score)).alias("score")))
    return reduce(DataFrame.unionByName, found)


def exact_candidates(chunks: DataFrame, queries: DataFrame, k: int = 40, score: float = 20.0, most: int = 10_000) -> DataFrame:
    """Chunks that hold one of a query's codes, e-mails, entities, years or names; best quality first, one score for all.

    ``chunks``: ``chunk_id, title, text, url, date, quality``; ``queries`` as ``parsed`` gives them.
    """
    hay = F.lower(F.concat_ws("\n", "title", "text", "url", "date"))
    return _candidates(chunks, queries, lambda q: reduce(lambda a, b: a | b, (_holds(hay, q[f]) for f in FIELDS)), score, k, most=most)


def routed_candidates(chunks: DataFrame, queries: DataFrame, routes: Sequence[Route], k: int = 80, score: float = 32.0) -> DataFrame:
    """Chunks that any route of a query's intents lets through; those that hold its codes first, then by quality."""
    hay = F.lower(F.concat_ws("\n", "title", "text", "url", "date"))

    def passes(q: Column) -> Column:
        out = F.lit(False)
        for r in routes:
            where = F.col("category").isin(list(r.categories)) if r.categories else F.lit(False)
            if r.source_types:
                where = where | (F.col("source_type").isin(list(r.source_types)) & (F.col("path").ilike(r.path_like) if r.path_like else F.lit(True)))
            if r.url_like:
                where = where | F.col("url").ilike(r.url_like)
            for f in r.needs:
                where = where & ((F.size(q[f]) == 0) | _holds(hay, q[f]))
            out = out | (F.array_contains(q["intents"], r.intent) & where)
        return out

    return _candidates(chunks, queries, passes, score, k, [F.desc(_holds(hay, F.col("q.codes")))])


def _test(feature: Feature) -> Column:
    field = F.coalesce(F.lower(F.col(feature.field)), F.lit(""))
    p = feature.pattern.lower()
    return {"equals": field == p, "contains": field.contains(p), "like": field.like(p), "matches": field.rlike(feature.pattern)}[feature.op]


def has_code(hay: Column, code: Column) -> Column:
    """Whether a code (a column) stands in upper-cased text with no letter or digit beside it."""
    return F.regexp_like(F.upper(hay), F.concat(F.lit(r"(?<![A-Z0-9])\Q"), code, F.lit(r"\E(?![A-Z0-9])")))


def rule_rerank(hits: DataFrame, chunks: DataFrame, queries: DataFrame, features: Sequence[Feature] = (), priority=fixed.SOURCE_PRIORITY, structured: Sequence[str] = fixed.STRUCTURED_CATEGORIES, courses: Sequence[str] = fixed.COURSE_CATEGORIES, contacts: Sequence[str] = fixed.CONTACT_CATEGORIES) -> DataFrame:
    """``query_id, chunk_id, score``: raw score plus source priority, quality, token, code, year, entity, contact and rule features.

    ``hits`` are candidate lists, a few hundred a query, so the joins are by chunk and query. Each code and entity of a
    query adds its own weights; its years are taken together: one that fits is enough.
    """
    rows = hits.select("query_id", "chunk_id", "score").join(chunks, "chunk_id").join(queries, "query_id")
    plain = lambda c: F.coalesce(F.col(c), F.lit(""))
    title, text, date, category = (plain(c) for c in ("title", "text", "date", "category"))
    hay = F.concat(title, F.lit("\n"), text)
    low, low_title = F.lower(hay), F.lower(title)
    add = lambda condition, weight, otherwise=0.0: F.when(condition, F.lit(weight)).otherwise(F.lit(otherwise))
    asks = lambda words: reduce(lambda a, b: a | b, (F.col("query").contains(w) for w in words))
    each = lambda c, weight: F.aggregate(c, F.lit(0.0), lambda s, x: s + weight(x))

    source = F.lit(1.0)
    for k, v in priority.items():
        source = F.when(F.col("source_type") == k, v).otherwise(source)
    total = F.col("score") + 4.0 * F.coalesce("quality", F.lit(0.0)) + source
    # All weights below.
    total += add(category.isin(list(structured)), 1.5) + add(F.col("source_type") == "pdf_md", -2.0)
    total += each("terms", lambda t: F.least(F.length(t), F.lit(8)) * F.when(F.contains(low_title, F.lower(t)), 1.2).when(F.contains(low, F.lower(t)), 0.35).otherwise(0.0))
    in_title, in_head, in_hay = compact_ascii(title), compact_ascii(F.substring(text, 1, 1800)), compact_ascii(hay)
    entities_ = F.filter(F.transform("entities", compact_ascii), lambda e: e != "")
    total += each(entities_, lambda e: add(F.contains(in_title, e), 38.0) + F.when(F.contains(in_head, e), 28.0).when(F.contains(in_hay, e), 12.0).otherwise(0.0))

    stated = lambda c: F.contains(text, F.concat(F.lit("课程代码: "), c)) | F.contains(text, F.concat(F.lit("# "), c))
    of_course = F.contains(text, F.lit("任课教师:")) | F.contains(text, F.lit("课程代码:")) | category.isin(list(courses))
    asked = F.when(asks(("任课", "老师", "教师", "学分", "课程")), add(of_course, 10.0, -8.0)).otherwise(0.0)
    total += each("codes", lambda c: add(F.upper(title) == c, 35.0) + F.when(stated(c), 45.0).when(has_code(hay, c), 18.0).otherwise(-30.0) + asked)

    dated = F.exists("years", lambda y: F.startswith(date, y))
    fits = dated | F.exists("years", lambda y: F.contains(hay, y))
    off = lambda c: (F.size(years(c)) > 0) & ~F.arrays_overlap(years(c), "years")
    total += F.when(F.size("years") > 0, F.when(fits, 16.0 + add(dated, 8.0)).otherwise(-22.0) + add(off(hay), -14.0) + add(off(title), -18.0)).otherwise(0.0)

    contact = add(category.isin(list(contacts)), 8.0) + add(reduce(lambda a, b: a | b, (text.contains("邮箱:"), low.contains("email"), text.contains("办公室"), low.contains("office"))), 4.0)
    total += F.when(asks(("邮箱", "email", "邮件", "电话", "office", "办公室")), contact).otherwise(0.0)
    for f in features:
        on = F.array_contains("intents", f.intent) if f.intent else F.lit(True)
        total = total + F.when(on & _test(f), f.weight).when(on, f.otherwise).otherwise(0.0)
    return rows.select("query_id", "chunk_id", total.alias("score"))


def tier_rerank(hits: DataFrame, chunks: DataFrame, queries: DataFrame, features: Sequence[Feature] = (), k: int = 8) -> DataFrame:
    """The second build's ranking: one hit of each text, tier boost, quality, exact-term and rule boosts; rounded, best ``k``.

    Repeated texts go before scores are known, the hit with the least chunk id staying.
    """
    rows = hits.select("query_id", "chunk_id", "score").join(chunks, "chunk_id").join(queries, "query_id")
    rows = top_k(rows.withColumn("_key", F.xxhash64(F.regexp_replace(F.substring("text", 1, 260), r"(?U)\s+", ""))), 1, ("query_id", "_key"), [F.col("chunk_id")], "_first")
    title, hay = F.lower(F.coalesce("title", F.lit(""))), F.lower(F.concat_ws("\n", "title", "category", "text", "url"))
    tier = F.lit(1.0)
    for name, v in fixed.TIER_BOOST.items():
        tier = F.when(F.col("source_type") == name, v).otherwise(tier)
    total = F.col("score") + tier + 5.0 * F.coalesce("quality", F.lit(0.0))
    total = total + F.aggregate("terms", F.lit(0.0), lambda s, t: s + F.when(F.contains(title, t), F.least(F.length(t), F.lit(10)) * 0.9).when(F.contains(hay, t), F.least(F.length(t), F.lit(10)) * 0.22).otherwise(0.0))
    for f in features:
        on = F.array_contains("intents", f.intent) if f.intent else F.lit(True)
        total = total + F.when(on & _test(f), f.weight).when(on, f.otherwise).otherwise(0.0)
    return top_k(rows.select("query_id", "chunk_id", F.round(total, 4).alias("score")), k)


def precise_scores(hits: DataFrame, chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id, chunk_id, score, raw``: how surely a hit holds the facts a query names (dates, Latin phrases)."""
    rows = hits.select("query_id", "chunk_id", F.col("score").alias("raw")).join(chunks.select("chunk_id", "text"), "chunk_id").join(queries.select("query_id", "query"), "query_id")
    # Weights of a written month, a numeric one and a phrase.
    parts = ((r"\d{4}年\d{1,2}月", 220.0, 1), (r"\d{4}[-/]\d{1,2}", 160.0, 1), (r"[A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z&-]+){1,5}", 160.0, 8))
    total = F.lit(0.0)
    for pattern, weight, least in parts:
        total = total + F.aggregate(F.regexp_extract_all("query", F.lit(pattern), F.lit(0)), F.lit(0.0), lambda s, x, w=weight, n=least: s + F.when((F.length(x) >= n) & F.contains(F.lower("text"), F.lower(x)), w).otherwise(0.0))
    return rows.select("query_id", "chunk_id", total.alias("score"), "raw")
