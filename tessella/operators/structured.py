"""Structured rows: validity, titles, text forms, keys and JSON flattening."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed
from ..functions.extract import first_number, host_of
from ..functions.text import contains_any, nfkc, strip


def scalar(df: DataFrame, name: str) -> Column:
    """A column as trimmed text: lists joined by the ideographic comma, structs and maps as JSON with sorted keys; empty for null or no such column."""
    if name not in df.columns:
        return F.lit("")
    kind, c = df.schema[name].dataType, F.col(name)
    if isinstance(kind, T.ArrayType):
        text = F.array_join(F.filter(F.transform(c, lambda x: F.trim(x.cast("string"))), lambda x: x != ""), "、")
    elif isinstance(kind, T.MapType):
        text = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(c))))
    elif isinstance(kind, T.StructType):
        text = F.to_json(F.struct(*[c[f.name].alias(f.name) for f in sorted(kind, key=lambda f: f.name)]))
    else:
        text = c.cast("string")
    return F.coalesce(strip(F.regexp_replace(F.regexp_replace(nfkc(text), r"\r\n?", "\n"), r"[ \t]+", " ")), F.lit(""))


def first_of(df: DataFrame, fields: Sequence[str], placeholders: Sequence[str] = ()) -> Column:
    """The first field that isn't empty (nor a placeholder), else empty."""
    values = [F.when(~scalar(df, f).isin(["", *placeholders]), scalar(df, f)) for f in fields if f in df.columns]
    return F.coalesce(*values, F.lit(""))


def confidence(df: DataFrame) -> Column:
    return F.coalesce(F.col("confidence").cast("string").try_cast("double"), F.lit(1.0)) if "confidence" in df.columns else F.lit(1.0)


def row_title(df: DataFrame, table: str) -> Column:
    named = first_of(df, fixed.ROW_TITLE_FIELDS, fixed.PLACEHOLDERS)
    where = host_of(first_of(df, ("source_url", "profile_url", "homepage")), F.lit(""))
    return F.substring(F.coalesce(F.nullif(named, F.lit("")), F.nullif(first_of(df, ("name_en",), fixed.PLACEHOLDERS), F.lit("")), F.nullif(where, F.lit("")), F.lit(table)), 1, 180)


def row_url(df: DataFrame) -> Column:
    return first_of(df, fixed.URL_FIELDS)


# Words that a table's rows must or must not have.
_GOOD_REQUIREMENT = ("培养方案", "学位申请", "答辩", "课程", "学分", "毕业要求", "degree", "program", "academics", "graduate", "undergraduate", "requirement", "defence", "defense", "pyfa")
_BAD_REQUIREMENT = ("毕业生故事", "人物专访", "学生活动", "新闻", "讲座", "论坛", "风采")
_GOOD_SOURCE = ("培养方案", "课程", "学位", "本科", "硕士", "博士", "degree", "program", "academics", "graduate", "undergraduate", "requirement", "pyfa")
_BAD_SOURCE = ("招聘", "实习", "宣讲", "讲座", "新闻", "人物专访", "毕业生故事")
_BAD_NAMES = ("vice dean", "dean", "previous academic and professional roles")


def valid_row(df: DataFrame, table: str) -> Column:
    """Whether a row of a structured table is meaningful: confident enough, and with what its table needs."""
    ok = confidence(df) >= fixed.CONFIDENCE.get(table, 0.0)
    has = lambda f: scalar(df, f) != ""
    title = first_of(df, ("program_name", "title"))
    if table == "courses":
        ok = ok & (has("course_code") | has("course_name") | has("course_name_en") | has("instructor"))
    if table == "program_requirements":
        ok = ok & ~contains_any(title, _BAD_REQUIREMENT) & contains_any(F.concat_ws("\n", title, row_url(df), scalar(df, "requirement_text")), _GOOD_REQUIREMENT, lower=True)
    if table == "program_sources":
        ok = ok & ~contains_any(title, _BAD_SOURCE) & contains_any(F.concat_ws("\n", title, row_url(df), scalar(df, "evidence")), _GOOD_SOURCE, lower=True)
    if table == "facts":
        value = first_of(df, ("object_value", "object_json"))
        ok = ok & (F.length(scalar(df, "subject")) >= 2) & (F.length(value) >= 2) & ~((F.length(scalar(df, "evidence")) > 2500) & (confidence(df) < 0.9))
    if table == "leadership_roles":
        ok = ok & has("name") & has("role") & ~F.lower(scalar(df, "name")).isin(list(_BAD_NAMES))
    return ok


def teachers(c: Column) -> Column:
    """A list of teachers without parts that are no names."""
    parts = F.filter(F.transform(F.split(c, r"\s*[、;；]\s*"), lambda x: strip(x)), lambda x: (x != "") & ~x.rlike("矩阵分析|下一年|教学中心|星期[一二三四五六日天]|课程表"))
    return F.array_join(parts, "、")


def valid_course(df: DataFrame) -> Column:
    """Whether a course record names a code, a course or a teacher, and has credits of 20 at most."""
    people = teachers(first_of(df, ("instructor", "teacher", "teachers")))
    named = (first_of(df, ("course_code", "code")) != "") | (first_of(df, ("course_name", "name_cn", "name_en")) != "") | (people != "")
    return named & (F.coalesce(first_number(scalar(df, "credits")), F.lit(0.0)) <= 20)


def row_markdown(df: DataFrame, table: str) -> Column:
    """A row as a small markdown document: preferred fields first, then the others in their order."""

    def entry(f: str) -> Column:
        value = scalar(df, f)
        for p in (r"!\[.*?\]\([^)]*\)", r"!\[[^\]]*\]\([^)\s;]*\)?"):
            value = F.regexp_replace(value, p, " ")
        value = strip(F.regexp_replace(value, r"\[\s*\]\(([^)]*)\)", "$1"))
        if f in ("instructor", "teacher", "teachers"):
            value = teachers(value)
        bad = value == ""
        if f in ("name", "name_en", "title"):
            bad = bad | value.isin(list(fixed.PLACEHOLDERS))
        if f in ("name_en", "course_name_en"):
            bad = bad | value.rlike(r"^\d+(?:\.\d+)?$")
        if f not in fixed.ROW_FIELDS:
            most = 700 if f == "evidence" else 1400
            bad = bad | ((F.regexp_count(value, F.lit(r"\]\(")) >= 5) & ~value.rlike(fixed.DATE))
            value = F.when(F.length(value) > most, F.concat(F.rtrim(F.substring(value, 1, most)), F.lit("..."))).otherwise(value)
        return F.when(~bad, F.concat(F.lit(f"- {fixed.ROW_LABELS.get(f, f)}: "), value))

    skipped = {"id", "source_document_id", "object_json", "raw_json"} | ({"evidence"} if table == "courses" else set())
    others = [c for c in df.columns if c not in fixed.ROW_FIELDS and c not in skipped]
    return F.concat_ws("\n", F.concat(F.lit("# "), row_title(df, table)), F.lit(""), F.lit(f"来源表: {table}"), *[entry(f) for f in fixed.ROW_FIELDS if f in df.columns], *[entry(f) for f in others])


def row_text(df: DataFrame, table: str) -> Column:
    """A row as ``label: value`` lines under its table's name."""
    pairs = [F.when(scalar(df, f) != "", F.concat(F.lit(f"{fixed.FIELD_LABELS.get(f, f)}: "), scalar(df, f))) for f in df.columns]
    return F.concat_ws("\n", F.lit(table), F.lit(f"table: {table}"), *pairs)


def row_key(df: DataFrame, table: str) -> Column:
    """What tells duplicate rows of a table: its key fields, at most 240 characters of each."""
    fields = fixed.DEDUP_FIELDS.get(table, fixed.TITLE_FIELDS)
    return F.concat_ws("|", F.lit(table), *[F.substring(scalar(df, f), 1, 240) for f in fields])


def rag_records(chunks: DataFrame, least: int = 0, categories: Sequence[str] | None = None) -> DataFrame:
    """``id, text, metadata``: chunks long enough and of the categories, what else is known of them nested."""
    kept = chunks.filter(F.length("text") >= least)
    if categories:
        kept = kept.filter(F.col("category").isin(list(categories)))
    rest = [c for c in chunks.columns if c not in ("id", "text")]
    return kept.select(F.concat(F.lit("chunk:"), F.col("id").cast("string")).alias("id"), "text", F.struct(*rest).alias("metadata"))


def structured_records(df: DataFrame, table: str, least: int = 20) -> DataFrame:
    """Rows of a structured table as ``id, text, metadata``."""
    text = row_text(df, table)
    meta = F.struct(first_of(df, fixed.TITLE_FIELDS).alias("title"), row_url(df).alias("url"), F.lit(table).alias("category"), row_key(df, table).alias("dedup_key"))
    key = F.concat(F.lit(f"{table}:"), scalar(df, "id"))
    return df.select(key.alias("id"), text.alias("text"), meta.alias("metadata")).filter(F.length("text") >= least)


def with_documents(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """Structured rows with ``doc_url, doc_published_at`` of their source document; rows without one stay."""
    docs = documents.select(F.col("id").cast("long").alias("source_document_id"), F.col("url").alias("doc_url"), F.col("source_published_at").alias("doc_published_at"))
    return rows.withColumn("source_document_id", F.coalesce(F.col("source_document_id").cast("string").try_cast("long"), F.lit(0))).join(docs, "source_document_id", "left")


def sorted_json(df: DataFrame) -> Column:
    """A whole row as JSON with its keys sorted."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]))


def flattened(texts: DataFrame, json_col: str = "value", pair: tuple[str, str] | None = None) -> DataFrame:
    """Records (JSON objects) of JSON documents: a list of objects; an object of lists or objects, each with its key as ``group``;
    with ``pair``, an object's keys and values as two fields."""
    v = texts.select(F.try_parse_json(json_col).alias("v"))
    as_map = F.from_json(F.to_json("v"), "map<string,string>")
    if pair:
        return v.select(F.explode(as_map).alias("k", "x")).select(F.to_json(F.struct(F.col("k").alias(pair[0]), F.col("x").alias(pair[1]))).alias("record"))
    items = F.from_json(F.to_json("v"), "array<string>")
    top = v.filter(F.to_json("v").startswith("[")).select(F.lit(None).cast("string").alias("group"), F.explode(items).alias("record"))
    groups = v.filter(F.to_json("v").startswith("{")).select(F.explode(as_map).alias("group", "x"))
    lists = groups.filter(F.col("x").startswith("[")).select("group", F.explode(F.from_json("x", "array<string>")).alias("record"))
    objects = groups.filter(F.col("x").startswith("{")).select("group", F.col("x").alias("record"))
    return top.unionByName(lists).unionByName(objects).filter(F.col("record").startswith("{"))
