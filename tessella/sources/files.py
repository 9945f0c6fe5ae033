"""Sources: JSON lines, JSON documents, texts, HTML, CSV, url lists and crawl manifests."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import pandas_udf

from ..functions.extract import valid_date
from ..functions.fixed import Domain
from ..functions.quality import irrelevant_pdf, skip_reason, voted_category
from ..functions.text import strip
from ..operators.clean import wanted_file
from .stored import exists


def jsonl(spark: SparkSession, path: str, schema: T.StructType | str | None = None, missing_ok: bool = False) -> DataFrame:
    """JSON lines. Blank lines are skipped and a malformed line is an error that names the file; ``missing_ok``: no file, no rows (``schema`` needed)."""
    if missing_ok and not exists(spark, path):
        return spark.createDataFrame([], schema)
    reader = spark.read.option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def json_objects(spark: SparkSession, path: str) -> DataFrame:
    """``path, line_no, value``: each line that is a JSON object, with its number; a line that is no JSON is an error with its place.

    Lines are numbered inside each file's own text, so files are read whole; give large tables to ``jsonl`` instead.
    """
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\r?\n", -1)).alias("i", "value"))
    kept = whole.select("path", (F.col("i") + 1).alias("line_no"), "value").filter(strip("value") != "")
    broken = F.raise_error(F.concat(F.col("path"), F.lit(":"), F.col("line_no").cast("string"), F.lit(": invalid JSON"))).cast("string")
    checked = kept.withColumn("value", F.when(F.try_parse_json("value").isNotNull(), F.col("value")).otherwise(broken))
    return checked.filter(F.ltrim("value").startswith("{"))


def json_document(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document a file, parsed with an inferred schema."""
    return spark.read.option("multiLine", True).json(path)


def tables_in(spark: SparkSession, folder: str) -> list[str]:
    """Names of the JSON-lines tables in a folder, sorted."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(folder)
    names = [f.getPath().getName() for f in p.getFileSystem(conf).listStatus(p)]
    return sorted(n.removesuffix(".jsonl") for n in names if n.endswith(".jsonl"))


class Dataset:
    """A folder of JSON-lines tables and of the files they name."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def tables(self) -> list[str]:
        return tables_in(self.spark, f"{self.root}/jsonl")

    def table(self, name: str, schema: T.StructType | str | None = None, limit: int | None = None) -> DataFrame:
        df = jsonl(self.spark, f"{self.root}/jsonl/{name.removesuffix('.jsonl')}.jsonl", schema)
        return df if limit is None else df.limit(limit)

    def count(self, name: str) -> int:
        return self.table(name).count()

    def chunks(self, least: int = 0, categories: Sequence[str] | None = None, with_document: bool = False) -> DataFrame:
        """Chunks long enough and of the categories, their documents beside them if asked."""
        out = self.table("chunks").filter(F.length("text") >= least)
        if categories:
            out = out.filter(F.col("category").isin(list(categories)))
        if with_document:
            docs = self.table("documents")
            out = out.join(docs.select(F.col("id").alias("document_id"), F.struct(*docs.columns).alias("document")), "document_id", "left")
        return out

    def document(self, doc_id: int) -> DataFrame:
        return self.table("documents").filter(F.col("id") == doc_id)

    def document_text(self, doc_id: int) -> str | None:
        row = self.document(doc_id).select("text_path").first()
        found = self.spark.read.text(f"{self.root}/{row['text_path']}", wholetext=True).first() if row and row["text_path"] else None
        return found["value"] if found else None

    def extensions(self, folder: str = "raw") -> DataFrame:
        from ..operators.evaluate import extensions

        return extensions(file_list(self.spark, f"{self.root}/{folder}"))


def file_list(spark: SparkSession, folder: str) -> DataFrame:
    """``path, length, modificationTime`` of all files below a folder; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length", "modificationTime")


def texts(spark: SparkSession, folder: str, pattern: str = "*.txt", source_type: str = "text", base_quality: float = 1.0, ordinal: int = 0) -> DataFrame:
    """``path, text, source_type, base_quality, source_order``: files below a folder, one row each; bytes that are no UTF-8 become the replacement character."""
    read = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(folder, wholetext=True)
    return read.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"), F.lit(source_type).alias("source_type"), F.lit(base_quality).alias("base_quality"), F.lit(ordinal).alias("source_order"))


def crawled_texts(spark: SparkSession, folders: Sequence[tuple[str, str, float]], domain: Domain = Domain()) -> DataFrame:
    """Markdown and text files of several folders ``(folder, source type, base quality)`` in order; scripts' files, addresses with credentials and PDFs off topic are left out."""
    parts = [texts(spark, f, "*.{md,txt}", kind, q, i) for i, (f, kind, q) in enumerate(folders)]
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return ordered_union(*parts).filter(wanted_file("path") & ~((F.col("source_type") == "pdf_md") & irrelevant_pdf(name, "text", domain)))


def ordered_union(*parts: DataFrame) -> DataFrame:
    """All rows; what comes first is told by ``source_order`` and path, not by their place in a file."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def with_text(documents: DataFrame, files: DataFrame, path_col: str = "text_path") -> DataFrame:
    """Documents joined with their text files by path; those without a file go."""
    return documents.join(files.select(F.col("path").alias(path_col), "text"), path_col)


class _Page(HTMLParser):
    """Text nodes outside scripts and forms; title and headings apart."""

    HIDDEN = ("script", "style", "noscript", "svg", "canvas", "form")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.hidden, self.stack, self.out, self.titles = 0, [], [], {"title": [], "h1": []}

    def handle_starttag(self, tag, attrs):
        if tag in self.HIDDEN:
            self.hidden += 1
        named = dict(attrs).get("class") or ""
        self.stack.append("h1" if tag == "h1" or "arti_title" in named or named == "title" else tag)
        if self.stack[-1] in self.titles:
            self.titles[self.stack[-1]].append("")

    def handle_endtag(self, tag):
        if tag in self.HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        if self.stack:
            self.stack.pop()

    def handle_data(self, data):
        if self.hidden or not data.strip():
            return
        self.out.append(data.strip())
        if self.stack and self.stack[-1] in self.titles and self.titles[self.stack[-1]]:
            self.titles[self.stack[-1]][-1] += data.strip()


PAGE = T.StructType([T.StructField("title", T.StringType()), T.StructField("text", T.StringType())])


@pandas_udf(PAGE)
def page_parts(html: pd.Series) -> pd.DataFrame:
    """Title (a longer heading wins over it) and text of HTML."""

    def one(x):
        page = _Page()
        page.feed(x or "")
        title = next(iter(page.titles["title"]), "")
        return max([title, *page.titles["h1"]], key=len), "\n".join(page.out)

    return pd.DataFrame([one(x) for x in html], columns=PAGE.names)


@pandas_udf(T.StringType())
def decoded(content: pd.Series) -> pd.Series:
    """Bytes of a page as text, by the first charset that fits."""

    def one(b):
        for charset in ("utf-8", "gb18030", "gbk"):
            try:
                return b.decode(charset)
            except UnicodeDecodeError:
                continue
        return b.decode("latin-1")

    return content.map(lambda b: None if b is None else one(b))


def crawled_pages(manifest: DataFrame, pages: DataFrame, domain: Domain = Domain()) -> DataFrame:
    """Fetched pages of a crawl manifest (``status = ok``) as documents with ``skip_reason, category, date``; ``pages``: ``raw_path, content``."""
    got = manifest.filter("status = 'ok'").join(pages, "raw_path").withColumn("page", page_parts(decoded("content")))
    rows = got.select(F.coalesce(F.nullif("final_url", F.lit("")), "url").alias("url"), "host", F.col("page.title").alias("title"), F.col("page.text").alias("text"), F.lit("live_official").alias("source_tier"))
    return rows.withColumns({"skip_reason": skip_reason("host", "url", "title", "text", domain), "category": voted_category("title", "text", "url", domain), "date": valid_date("text", "url")})


def mirrored_pages(documents: DataFrame, files: DataFrame, domain: Domain = Domain()) -> DataFrame:
    """Documents of a local mirror with their texts, in the same form."""
    rows = with_text(documents, files).select("url", "host", "title", "text", F.lit("local_official_mirror").alias("source_tier"))
    return rows.withColumns({"skip_reason": skip_reason("host", "url", "title", "text", domain), "category": voted_category("title", "text", "url", domain), "date": valid_date("text", "url")})


def seed_documents(facts: DataFrame) -> DataFrame:
    """Verified facts (``id, question, answer, expected_terms, source_note, source_url``) as documents of the first tier."""
    text = F.concat_ws("\n", "question", "answer", F.array_join("expected_terms", " "), "source_note", "source_url")
    return facts.select(F.col("source_url").alias("url"), F.col("question").alias("title"), text.alias("text"), F.lit("verified_seed").alias("source_tier"), "category")


def url_list(spark: SparkSession, path: str | None = None, inline: str = "") -> DataFrame:
    """``url``: lines of a file without comments, and a comma list; each once, in order."""
    given = [x.strip() for x in inline.split(",") if x.strip()]
    out = spark.createDataFrame([(i, x) for i, x in enumerate(dict.fromkeys(given))], "i long, url string")
    if path:
        lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("i") + len(given), strip("value").alias("url")).filter("url <> '' AND NOT url LIKE '#%'")
        out = out.unionByName(lines)
    return out.groupBy("url").agg(F.min("i").alias("i")).orderBy("i").select("url")


def url_candidates(spark: SparkSession, hosts: Sequence[str], paths: Sequence[str]) -> DataFrame:
    """Every path on every host (both short lists of the caller's)."""
    return spark.createDataFrame([(f"https://{h}{p}",) for h in hosts for p in paths], "url string")


def csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, quoted line ends and, maybe, a byte order mark."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def css_rows(selectors: Sequence[dict]) -> Column:
    """A Python UDF ``html -> array<map<string,string>>``: for each element of a tag or class (``base``) its fields ``{name, tag, attribute}``."""
    base, fields = selectors[0]["base"], selectors[0]["fields"]

    @pandas_udf(T.ArrayType(T.MapType(T.StringType(), T.StringType())))
    def rows(html: pd.Series) -> pd.Series:
        return html.map(lambda x: _css(x or "", base, fields))

    return rows


def _css(html: str, base: str, fields: Sequence[dict]) -> list[dict]:
    class Rows(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.depth, self.rows, self.open = 0, [], []

        def handle_starttag(self, tag, attrs):
            named = dict(attrs)
            if self.depth:
                self.depth += 1
            elif tag == base or (base.startswith(".") and base[1:] in (named.get("class") or "").split()):
                self.depth = 1
                self.rows.append({})
            if self.depth:
                for f in fields:
                    if f["tag"] == tag or (f["tag"].startswith(".") and f["tag"][1:] in (named.get("class") or "").split()):
                        if f.get("attribute"):
                            self.rows[-1].setdefault(f["name"], named.get(f["attribute"]) or "")
                        else:
                            self.open.append((f["name"], self.depth))

        def handle_endtag(self, tag):
            self.open = [x for x in self.open if x[1] < self.depth]
            self.depth = max(0, self.depth - 1)

        def handle_data(self, data):
            for name, _ in self.open:
                self.rows[-1][name] = (self.rows[-1].get(name, "") + " " + data.strip()).strip()

    parser = Rows()
    parser.feed(html)
    return parser.rows


__all__ = ["Dataset", "crawled_pages", "crawled_texts", "css_rows", "csv", "decoded", "file_list", "json_document", "json_objects", "jsonl", "mirrored_pages", "ordered_union", "page_parts", "seed_documents", "tables_in", "texts", "url_candidates", "url_list", "with_text"]
