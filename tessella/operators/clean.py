"""Line cleaning: noise predicates, boilerplate by document frequency, repeat caps, filter chains with counters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.extract import is_static
from ..functions.fixed import Domain
from ..functions.quality import academic_pdf, adjusted_quality, garbled
from ..functions.text import col, lines, nfkc, normal_line, normal_space, strip

#: Lines of a blacklist that may be broadcast.
MOST_LINES = 200_000


def inline_text(c) -> Column:
    """A line without images, link targets, urls and outer marks."""
    out = F.regexp_replace(col(c), r"!\[[^\]]*\]\([^)]*\)", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"\[([^\]]*)\]\([^)]*\)", "$1"), fixed.URL, " ")
    return strip(F.regexp_replace(out, r"(?U)\s+", " "), r" #|*\-_\t")


def without_noise_links(c, labels: Sequence[str] = fixed.NOISE_LABELS) -> Column:
    """A line without links that have no label or the label of a menu."""
    import re

    menu = "|".join(re.escape(x) for x in labels)
    return F.regexp_replace(col(c), rf"(?:\*\s*)?\[[\s!#|*\-_]*(?:(?:{menu})[\s!#|*\-_]*|微信扫一扫[^\]]{{0,55}})?\]\([^)]*\)", " ")


def noise_line(c, extra: Sequence[str] = ()) -> Column:
    """Whether a normal line is page furniture."""
    c = col(c)
    out = (c == "") | c.isin([*fixed.NOISE_LINES, *extra]) | c.rlike(fixed.TABLE_RULE) | c.rlike(r"^\s*\[?\s*\]?\([^)]*\)\s*$") | c.rlike(r"^[-_*=#| !]+$")
    link = c.rlike(r"^(?:\* \[|- \[|\[)") & (F.regexp_count(c, F.lit(r"\]\(")) == 1) & ~c.rlike(fixed.DATE)
    out = out | (link & ((F.length(inline_text(c)) <= 24) | inline_text(c).isin(list(fixed.NOISE_LINES))))
    for p in fixed.NOISE_PATTERNS:
        out = out | c.rlike("(?U)" + p)
    return out


def noise_line_2(c) -> Column:
    """The second build's test, on a line stripped of outer marks."""
    c = strip(col(c), r" #|*\-_\s")
    out = (c == "") | c.isin(list(fixed.NOISE_LINES_2)) | c.rlike(r"^[-_*=#| !.]+$") | ((F.length(c) <= 2) & ~c.rlike(r"(?U)\w"))
    for p in fixed.NOISE_PATTERNS_2:
        out = out | c.rlike("(?U)" + p)
    return out


def blacklist_candidate(c) -> Column:
    """Whether a line may be boilerplate: short, or of middle length with a link or copyright mark."""
    c = col(c)
    marked = c.startswith("* [") | c.startswith("[") | c.contains("javascript:;") | c.contains("Copyright") | c.contains("公网安备") | c.contains("邮编")
    return (c != "") & (c.isin(list(fixed.NOISE_LINES)) | (F.length(c) <= 36) | ((F.length(c) <= 120) & marked))


def line_frequency(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", compatible: bool = True) -> DataFrame:
    """``line, n_docs``: in how many documents each candidate line stands. Lines are made distinct inside their row, so nothing but (line, 1) sums is shuffled."""
    text = nfkc(col(text_col)) if compatible else col(text_col)
    split = docs.select(F.array_distinct(F.transform(lines(text), lambda x: normal_line(x, compatible=False))).alias("ls"))
    return split.select(F.explode("ls").alias("line")).filter(blacklist_candidate("line")).groupBy("line").agg(F.count("*").alias("n_docs"))


def line_blacklist(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 20, share: float = 0.018, static: bool = True, compatible: bool = True) -> DataFrame:
    """``line, n_docs``: lines in at least ``max(least, share of documents)`` documents, and the fixed noise lines."""
    total = docs.agg(F.count("*").alias("total"))
    often = line_frequency(docs, id_col, text_col, compatible).join(F.broadcast(total))
    short = (F.length("line") <= 64) | F.col("line").contains("javascript") | F.col("line").contains("Copyright") | F.col("line").contains("公网安备")
    found = often.filter((F.col("n_docs") >= F.greatest(F.lit(least), F.floor(F.greatest(F.col("total"), F.lit(1)) * share))) & short).select("line", "n_docs")
    if not static:
        return found
    known = docs.sparkSession.createDataFrame([(x,) for x in fixed.NOISE_LINES], "line string")
    return found.join(known, "line", "full").select("line", F.coalesce("n_docs", F.lit(0).cast("long")).alias("n_docs"))


def top_lines(docs: DataFrame, n: int = 40, **how) -> DataFrame:
    return line_frequency(docs, **how).orderBy(F.desc("n_docs"), "line").limit(n)


def percent_decoded(c: Column) -> Column:
    """Text with its percent escapes decoded; text whose escapes are no UTF-8 stays as it is."""
    safe = F.regexp_replace(F.replace(c, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.when(c.rlike("%[0-9A-Fa-f]{2}"), F.coalesce(F.try_url_decode(safe), c)).otherwise(c)


def exploded_lines(docs: DataFrame, id_col: str, split: Column) -> DataFrame:
    return docs.select(F.col(id_col), F.posexplode(split).alias("pos", "line"))


def repeat_cap(rows: DataFrame, id_col: str, most: int = 2) -> DataFrame:
    """Of each line of a document the first ``most`` occurrences. Rows are dealt by document once, for this and for putting lines together again."""
    nth = F.row_number().over(Window.partitionBy(id_col, "line").orderBy("pos"))
    return rows.repartition(id_col).withColumn("_nth", nth).filter(F.col("_nth") <= most).drop("_nth")


def _put_together(docs: DataFrame, kept: DataFrame, id_col: str, raw_lines: Column) -> DataFrame:
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda s: s["line"]), "\n")
    done = kept.groupBy(id_col).agg(text.alias("cleaned"), F.count("*").alias("kept_lines"))
    out = docs.withColumn("raw_lines", raw_lines).join(done, id_col, "left").withColumns({"cleaned": F.coalesce("cleaned", F.lit("")), "kept_lines": F.coalesce("kept_lines", F.lit(0).cast("long"))})
    return out.withColumn("removed_lines", F.greatest(F.col("raw_lines") - F.col("kept_lines"), F.lit(0)))


def clean(docs: DataFrame, blacklist: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", compatible: bool = True, most_lines: int = MOST_LINES) -> DataFrame:
    """``docs`` with ``cleaned, raw_lines, kept_lines, removed_lines``: markdown noise, furniture, blacklisted and repeated lines dropped."""
    text = F.coalesce(col(text_col), F.lit(""))
    text = percent_decoded(nfkc(text) if compatible else text)
    text = F.replace(F.regexp_replace(text, r"\r\n?", "\n"), F.lit("\x00"), F.lit(""))
    text = F.regexp_replace(text, r"\[\]\([^)]*\)", " ")
    text = F.regexp_replace(F.regexp_replace(text, r"\s+(?=\* \[[^\]]{1,80}\]\()", "\n"), r"\s+(?=#{1,6}\s+)", "\n")
    split = F.split(text, "\n", -1)

    def tidy(x: Column) -> Column:
        for p in (r"!\[.*?\]\([^)]*\)", r"!\[[^\]]*\]\([^)]*\)", r"!\[[^\]]*\]\([^)\s;]*\)?", r"\[\s*\]\([^)]*\)"):
            x = F.regexp_replace(x, p, " ")
        return normal_line(F.regexp_replace(without_noise_links(normal_line(x, compatible=False)), "分享到.*$", ""), compatible=False)

    rows = exploded_lines(docs, id_col, F.transform(split, tidy)).filter(~noise_line("line"))
    rows = rows.filter(~((F.regexp_count("line", F.lit(r"\]\(")) >= 3) & ~F.col("line").rlike(fixed.DATE)))
    rows = rows.filter(~(F.col("line").startswith("Source:") & F.col("line").rlike("[0-9a-f]{32,}")) & ~(F.col("line").startswith("URL:") & F.col("line").rlike(fixed.URL)) & ~F.col("line").startswith("!["))
    if blacklist is not None:
        few = blacklist.limit(most_lines + 1).count() <= most_lines
        black = blacklist.select("line").distinct()
        rows = rows.join(F.broadcast(black) if few else black, "line", "left_anti").select(id_col, "pos", "line")
    return _put_together(docs, repeat_cap(rows, id_col), id_col, F.size(split).cast("long"))


def clean_2(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 2) -> DataFrame:
    """The second build's cleaning: markdown, tags and urls stripped from each line, its own noise test, repeats capped."""
    split = F.split(F.regexp_replace(normal_space(F.coalesce(col(text_col), F.lit(""))), r"\[\]\([^)]*\)", " "), "\n", -1)

    def tidy(x: Column) -> Column:
        x = F.regexp_replace(F.regexp_replace(x, r"!\[[^\]]*\]\([^)]*\)", " "), r"\[([^\]]*)\]\([^)]*\)", "$1")
        return strip(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"<[^>]+>", " "), fixed.URL, " "), r"[ \t]+", " "))

    rows = exploded_lines(docs, id_col, F.transform(split, tidy)).filter(~noise_line_2("line") & (F.length("line") >= least) & (F.regexp_count("line", F.lit(r"\]\(")) < 2))
    return _put_together(docs, repeat_cap(rows, id_col), id_col, F.size(split).cast("long"))


def filter_reason(cleaned: Column, path, url, source_type, quality: Column, least: int = 120, least_quality: float = 0.30) -> Column:
    """The first reason for which a cleaned document is skipped, or null."""
    return F.when(garbled(cleaned), "garbled").when(academic_pdf(path, url, source_type, cleaned), "academic_pdf").when(F.length(cleaned) < least, "short").when(quality < least_quality, "low_quality")


def with_quality(docs: DataFrame, domain: Domain = Domain()) -> DataFrame:
    """Cleaned documents with ``quality`` and ``skip_reason``."""
    scored = docs.withColumn("quality", adjusted_quality("base_quality", "cleaned", "source_type", "category", "host", "path", domain))
    return scored.withColumn("skip_reason", filter_reason(F.col("cleaned"), "path", "url", "source_type", F.col("quality")))


def skip_counts(docs: DataFrame) -> DataFrame:
    """``source_type, reason, n``: kept documents have the reason ``kept``."""
    return docs.groupBy("source_type", F.coalesce("skip_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def wanted_file(path) -> Column:
    """Whether a stored file is markdown or text and no script's or style's."""
    name = F.lower(F.regexp_extract(col(path), r"([^/]*)$", 1))
    return name.rlike(r"\.(?:md|txt)$") & ~name.rlike(r"\.(?:js|css)\.md$") & ~name.contains("chunk-vendors") & ~col(path).rlike(r"(?:^|/)web/[^/]*@")


def wanted_page(url, text, keywords: Sequence[str] = (), least: int = 50) -> Column:
    """Whether a fetched page is worth keeping: no asset, no error page, long enough, with a keyword."""
    from ..functions.extract import is_not_found
    from ..functions.text import contains_any

    out = ~is_static(url) & ~is_not_found(text) & (F.length(col(text)) >= least)
    return out & contains_any(text, keywords, lower=True) if keywords else out
