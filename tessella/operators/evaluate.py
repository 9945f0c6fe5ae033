"""Scoring of answers, checks of test sets and facts, report tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import answer_form, col


def score(answer, form, kind, targets) -> Column:
    """Whether an answer meets its targets (``array<array<string>>``: groups of alternatives), by kind: contains_all, contains_any, exact_any or regex.

    ``form``: a column that holds ``answer_form`` of the answer (lambdas can't call Python, which that takes).
    """
    raw, form, targets, kind = F.coalesce(col(answer), F.lit("")), col(form), col(targets), col(kind)
    # the normal form of alternatives, by a native translation, since lambdas can't call Python
    plain = lambda x: F.regexp_replace(F.translate(F.lower(x), "（），。“”’", "(),.\"\"'"), r"(?U)\s+", "")
    has = lambda group: F.exists(group, lambda x: F.contains(form, plain(x)))
    return (
        F.when(kind == "contains_all", F.forall(targets, has))
        .when(kind == "contains_any", F.exists(targets, has))
        .when(kind == "exact_any", F.exists(F.flatten(targets), lambda x: form == plain(x)))
        .when(kind == "regex", F.exists(F.flatten(targets), lambda x: F.regexp(raw, F.concat(F.lit("(?is)"), x)) | F.regexp(form, F.concat(F.lit("(?is)"), x))))
        .otherwise(F.raise_error(F.concat(F.lit("unsupported kind of evaluation: "), F.coalesce(kind, F.lit("null")))).cast("boolean"))
    )


def scored(items: DataFrame, answers: DataFrame, columns: Sequence[str] = ("sys_answer",)) -> DataFrame:
    """Items joined with their answers by ``id``, and ``<column>_correct`` for each answer column."""
    joined = items.join(answers, "id").withColumns({f"{c}_form": answer_form(c) for c in columns})
    return joined.withColumns({f"{c}_correct": score(c, f"{c}_form", "eval_type", "targets") for c in columns}).drop(*[f"{c}_form" for c in columns])


def unknown_answers(items: DataFrame, answers: DataFrame) -> DataFrame:
    return answers.join(items.select("id"), "id", "left_anti")


def accuracy(results: DataFrame, correct: str, by: Sequence[str] = ()) -> DataFrame:
    """``correct, total, accuracy`` overall or by columns."""
    c = F.col(correct).cast("int")
    return results.groupBy(*by).agg(F.sum(c).alias("correct"), F.count("*").alias("total"), F.avg(c).alias("accuracy"))


def latency(results: DataFrame, seconds: str) -> DataFrame:
    return results.agg(F.avg(seconds).alias("avg"), F.percentile(seconds, F.lit(0.5)).alias("median"), F.min(seconds).alias("min"), F.max(seconds).alias("max"))


def problems(items: DataFrame, required: Sequence[str]) -> DataFrame:
    """``id, problem``: missing required fields, empty targets and repeated ids."""
    missing = [F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", F.lit(f"no {c}")) for c in required]
    empty = F.when(F.coalesce(F.size("targets"), F.lit(0)) <= 0, F.lit("no targets")) if "targets" in items.columns else F.lit(None)
    each = items.select("id", F.explode(F.array_compact(F.array(*missing, empty.cast("string")))).alias("problem"))
    return each.unionByName(items.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id", F.lit("repeated id").alias("problem")))


def verify_sources(items: DataFrame, pages: DataFrame) -> DataFrame:
    """``id, checked, failed``: whether evidence groups occur in an item's pages and negative targets don't.

    ``items``: ``id, urls, evidence array<array<string>>, negatives array<string>``; ``pages``: ``url, text``.
    """
    texts = items.select("id", F.explode(F.array_distinct("urls")).alias("url")).join(pages, "url").groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("text")), " ").alias("page_text"))
    joined = items.join(texts, "id", "left").withColumn("form", answer_form("page_text"))
    plain = lambda x: F.regexp_replace(F.lower(x), r"(?U)\s+", "")
    lost = F.size(F.filter("evidence", lambda g: ~F.exists(g, lambda x: F.contains(F.col("form"), plain(x)))))
    present = F.size(F.filter("negatives", lambda x: F.contains(F.col("form"), plain(x))))
    return joined.select("id", (F.size("evidence") + F.size("negatives")).alias("checked"), (lost + present).alias("failed"))


def verify_facts(facts: DataFrame, hits: DataFrame) -> DataFrame:
    """``id, ok, matched, source_hit``: whether search results (``query_id, text, url``) bear a fact out (``id, expected, source_url``)."""
    seen = hits.groupBy(F.col("query_id").alias("id")).agg(F.lower(F.array_join(F.collect_list("text"), "\n")).alias("all_text"), F.collect_list(F.coalesce("url", F.lit(""))).alias("all_urls"))
    rows = facts.join(seen, "id", "left")
    matched = F.size(F.filter("expected", lambda t: F.contains(F.coalesce("all_text", F.lit("")), F.lower(t))))
    source = F.coalesce(F.exists("all_urls", lambda u: (F.col("source_url") != "") & F.contains(u, F.col("source_url"))), F.lit(False))
    rows = rows.withColumn("matched", matched).withColumn("source_hit", source)
    ok = F.col("all_text").isNotNull() & (F.col("matched") >= F.greatest(F.lit(1), F.least(F.size("expected"), F.lit(2)))) & (F.col("source_hit") | (F.col("matched") == F.size("expected")))
    return rows.select("id", ok.alias("ok"), "matched", "source_hit")


def group_report(rows: DataFrame, by: str, quality: str, empty: str = "(none)") -> DataFrame:
    """Count and mean quality of each value; empty values under one name."""
    key = F.coalesce(F.nullif(F.col(by), F.lit("")), F.lit(empty))
    return rows.groupBy(key.alias(by)).agg(F.count("*").alias("n"), F.round(F.avg(quality), 3).alias("avg_quality")).orderBy(F.desc("n"), by)


def top_values(rows: DataFrame, by: str, n: int = 30, empty: str = "(none)") -> DataFrame:
    key = F.coalesce(F.nullif(F.col(by), F.lit("")), F.lit(empty))
    return rows.groupBy(key.alias(by)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by).limit(n)


def extensions(files: DataFrame, path_col: str = "path") -> DataFrame:
    ext = F.lower(F.regexp_extract(path_col, r"\.([^./]+)$", 1))
    return files.groupBy(ext.alias("ext")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ext")


def longest_match(hits: DataFrame, patterns: Sequence[str], text_col: str = "text") -> DataFrame:
    """``query_id, value, rank``: the longest text that a pattern (first group, if it has one) finds in a query's hits, and where."""
    import re

    found = F.concat(*[F.regexp_extract_all(text_col, F.lit("(?i)" + p), F.lit(min(1, re.compile(p).groups))) for p in patterns])
    each = hits.select("query_id", "rank", F.explode(found).alias("value")).withColumn("value", F.regexp_replace(F.regexp_replace("value", r"(?U)\s+", " "), r"^[ |,，;；。]+|[ |,，;；。]+$", ""))
    return each.groupBy("query_id").agg(F.min_by(F.struct("value", "rank"), F.struct(-F.length("value"), F.col("rank"), F.col("value"))).alias("v")).select("query_id", "v.value", "v.rank")
