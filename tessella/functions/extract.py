"""Codes, dates, addresses, urls and links found in text, as columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from urllib.parse import urldefrag, urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import pandas_udf

from . import fixed
from .text import col, contains_any, cut, lines, matches, strip, tokens


def codes(c, pattern: str = fixed.COURSE_CODE, group: int = 0) -> Column:
    """Distinct codes in upper case, sorted."""
    return F.array_sort(F.array_distinct(F.transform(matches(c, pattern, group), F.upper)))


def years(c) -> Column:
    return F.array_sort(F.array_distinct(matches(c, fixed.YEAR)))


def emails(c) -> Column:
    return F.array_distinct(matches(c, "(?U)" + fixed.EMAIL))


def program_codes(c, of: Sequence[str]) -> Column:
    """Which of the given codes stand alone in the text, in any case."""
    return codes(c, rf"(?i)(?<![A-Za-z0-9])({'|'.join(of)})(?![A-Za-z0-9])", 1)


def entities(c, stop: Sequence[str] = (), most: int = 5) -> Column:
    """Latin names of four characters or more that are neither codes nor stop words; the first of each, at most ``most``."""
    found = F.transform(matches(c, r"[A-Za-z][A-Za-z0-9_+-]{3,}"), lambda x: F.struct(strip(F.lower(x), "_+-").alias("key"), x.alias("value")))
    good = F.filter(found, lambda s: ~s["key"].isin(list(stop)) & ~s["value"].rlike("^[A-Z]{2,}\\d{2,4}[A-Z]?$") if stop else ~s["value"].rlike("^[A-Z]{2,}\\d{2,4}[A-Z]?$"))
    first = F.filter(good, lambda s, i: F.array_position(F.transform(good, lambda g: g["key"]), s["key"]) == i + 1)
    return F.slice(F.transform(first, lambda s: s["value"]), 1, most)


def names(c, stop: Sequence[str] = (), most: int = 5) -> Column:
    """CJK names: before words that go with persons, then any run of two to four characters."""
    han = r"[\x{4e00}-\x{9fff}]"
    # What follows the name of a person in a question.
    after = ("的(?:研究方向|研究兴趣|邮箱|办公室|个人主页|主页|电话)", "(?:主页|个人主页)", "(?:教授|老师|导师|副教授|研究员)", "(?:是否|是不是|能否|可否)(?:匹配|合适|适合|可以|列出|获得|是)", "(?:是哪一年|哪一年|何时)(?:加入|晋升|获得|毕业|任)")
    found = F.concat(*[matches(c, f"({han}{{2,4}}){x}", 1) for x in after], F.filter(matches(c, f"{han}+"), lambda x: F.length(x).between(2, 4)))
    return F.slice(F.array_except(F.array_distinct(found), F.array(*map(F.lit, stop)).cast("array<string>")), 1, most)


def _maximal(values: Column) -> Column:
    """Values that lie in no other, in order of arrival: one that an earlier one holds is left out, earlier ones that it holds go. Those not of 2 to 24 characters only make others go."""

    def add(kept: Column, v: Column) -> Column:
        covered = F.exists(kept, lambda e: F.contains(e, v) | (F.lower(e) == F.lower(v)))
        others = F.filter(kept, lambda e: ~F.contains(v, e))
        return F.when(covered, kept).when(F.length(v).between(2, 24), F.concat(others, F.array(v))).otherwise(others)

    return F.aggregate(values, F.array().cast("array<string>"), add)


def topics(c, places: Sequence[str] = (), known: Sequence[str] = (), stop: Sequence[str] = fixed.TOPIC_STOP, latin_stop: Sequence[str] = fixed.TOPIC_LATIN_STOP, most: int = 8) -> Column:
    """Topics that a question names, at most ``most``: those its wording marks, or else its tokens.

    ``places``: names that may stand between a topic and a person's role; ``known``: topics that pass whatever they are
    made of. Null and empty questions have none.
    """
    c = F.coalesce(col(c), F.lit(""))
    among = lambda x, words: x.isin(list(words)) if words else F.lit(False)
    named = "的?" + (f"(?:{'|'.join(rf'\Q{p}\E' for p in places)})?" if places else "")

    def bare(x: Column) -> Column:
        for pattern in (f"(?s)(?:{'|'.join(fixed.TOPIC_BREAKS)}).*$", fixed.TOPIC_LEAD, f"(?i){named}$", r"(?U)[，。？?、；;：:\s]+$"):
            x = F.regexp_replace(strip(x) if pattern.startswith("(?s)") else x, pattern, "")
        return x

    def good(x: Column) -> Column:
        return (x != "") & ~among(F.lower(x), stop) & ~among(x, fixed.TOPIC_NONE) & (~x.rlike(f"[{fixed.TOPIC_CHARS}]") | among(x, known))

    of = lambda found: F.slice(_maximal(F.filter(F.transform(found, bare), good)), 1, most)
    before, asked = fixed.TOPIC_PATTERNS
    marked = of(F.concat(matches(c, before, 1), matches(c, asked % named, 1)))
    plain = F.filter(tokens(c), lambda t: (F.length(t) >= 2) & ~among(F.lower(t), stop) & F.when(t.rlike(r"^[\x{4e00}-\x{9fff}]+$"), (F.length(t) <= 4) | among(t, known)).otherwise(~among(F.lower(t), latin_stop)))
    return F.when(F.size(marked) > 0, marked).otherwise(of(plain))


def expanded_topics(c, expansions: Mapping[str, Sequence[str]], most: int = 18, **how) -> Column:
    """Topics, each followed by what ``expansions`` has for it, each value once in any case."""
    found = topics(c, known=tuple(expansions), **how)
    if not expansions:
        return F.slice(found, 1, most)
    more = F.create_map(*[x for k, v in expansions.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    values = F.flatten(F.transform(found, lambda t: F.concat(F.array(t), F.coalesce(more[t], F.array().cast("array<string>")))))
    first = F.filter(values, lambda v, i: F.array_position(F.transform(values, F.lower), F.lower(v)) == i + 1)
    return F.slice(first, 1, most)


def first_number(c) -> Column:
    return F.nullif(F.regexp_extract(col(c), r"-?\d+(?:\.\d+)?", 0), F.lit("")).try_cast("double")


def _date_of(match: Column) -> Column:
    part = lambda k: F.regexp_extract(match, "^(?:" + fixed.DATE + ")$", k)
    two = lambda k: F.lpad(part(k), 2, "0")
    return F.concat_ws("-", part(1), two(2), F.when(part(3) != "", two(3)))


def date(text, *before, head: int = 8000) -> Column:
    """The first date of the columns ``before``, in order, or of the text's head: ``YYYY-MM`` or ``YYYY-MM-DD`` as written, or empty."""
    found = [F.get(matches(F.coalesce(col(c), F.lit("")), fixed.DATE), 0) for c in before]
    return F.coalesce(_date_of(F.coalesce(*found, F.get(matches(cut(text, head), fixed.DATE), 0))), F.lit(""))


def valid_date(text, *before, head: int = 6000) -> Column:
    """As ``date``, but matches whose month or day can't be are passed over."""
    every = F.concat(*[matches(F.coalesce(col(c), F.lit("")), fixed.DATE) for c in before], matches(cut(text, head), fixed.DATE))
    number = lambda m, k: F.regexp_extract(m, "^(?:" + fixed.DATE + ")$", k)
    good = F.filter(every, lambda m: number(m, 2).cast("int").between(1, 12) & ((number(m, 3) == "") | F.coalesce(number(m, 3).try_cast("int"), F.lit(1)).between(1, 31)))
    return F.coalesce(_date_of(F.get(good, 0)), F.lit(""))


def host(url) -> Column:
    """Network location of a url in lower case, port included; empty without one."""
    return F.lower(F.regexp_extract(F.coalesce(col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def url_path(url) -> Column:
    return F.regexp_extract(F.coalesce(col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def is_static(url) -> Column:
    """Whether a url is of an asset or template, or has credentials."""
    path = F.lower(url_path(url))
    ends = "|".join(x.replace(".", r"\.") for x in fixed.STATIC_EXTENSIONS)
    return host(url).contains("@") | path.rlike(f"(?:{ends})$") | path.contains("/_upload/tpl/") | path.contains("/template")


def host_of(url, path) -> Column:
    """Host from a stored path ``web/<host>/...``, else from the url."""
    stored = F.lower(F.regexp_extract(F.coalesce(col(path), F.lit("")), r"(?:^|/)web/([^/@]+)", 1))
    from_url = F.when(~is_static(url) & ~host(url).contains("@"), host(url)).otherwise("")
    return F.when(stored != "", stored).otherwise(from_url)


def normal_url(url) -> Column:
    """Without fragment and without slashes at the end of the path."""
    bare = F.regexp_replace(col(url), r"#.*$", "")
    path = F.regexp_replace(url_path(bare), r"/+$", "")
    start = F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    return F.concat(start, F.when(path == "", F.lit("/")).otherwise(path), F.regexp_extract(bare, r"(\?.*)$", 1))


def source_key(url, path) -> Column:
    """What counts as one source when results are made diverse: url without query, or stored path without chunk."""
    form = lambda c, cut_at: F.lower(F.regexp_replace(F.regexp_replace(col(c), cut_at, ""), "/+$", ""))
    return F.when(F.coalesce(col(url), F.lit("")) != "", F.concat(F.lit("url:"), form(url, r"[#?].*$"))).otherwise(F.concat(F.lit("path:"), form(path, r"#chunk=\d+.*$")))


@pandas_udf(T.StringType())
def joined_url(base: pd.Series, link: pd.Series) -> pd.Series:
    """``link`` as seen from ``base``, without fragment; null unless it is http."""

    def one(b, x):
        try:
            out = urldefrag(urljoin(b or "", x or ""))[0]
        except ValueError:
            return None
        return out if out.startswith(("http://", "https://")) else None

    return pd.Series([one(b, x) for b, x in zip(base, link, strict=True)])


def links(text) -> Column:
    """Absolute and relative targets in markdown or HTML, distinct: markdown links, bare urls, href and src."""
    marked = matches(text, r"\[.*?\]\((https?://[^\)]+)\)", 1)
    bare = F.transform(matches(text, r"(?<!\()(https?://[^\s<>\"')\]]+)", 1), lambda u: F.regexp_replace(u, r"[.,;:!?\"')]+$", ""))
    return F.array_distinct(F.concat(marked, F.filter(bare, lambda u: F.regexp_count(u, F.lit("http")) <= 1), matches(text, r"(?:href|src)\s*=\s*[\"']([^\"']+)[\"']", 1)))


def hrefs(html) -> Column:
    return matches(html, r"(?i)<a\b[^>]*?\bhref\s*=\s*[\"']([^\"']+)[\"']", 1)


def pdf_urls(text) -> Column:
    """Urls of PDF files, without trailing punctuation, distinct."""
    return F.array_distinct(F.transform(matches(text, r"(?i)https?://[^\s<>\"'\)\]]+\.pdf[^\s<>\"'\)\]]*", 0), lambda u: F.regexp_replace(u, r"[.,;:!?]+$", "")))


def first_url(text, fallback=None) -> Column:
    """The first url of the first 80 lines, then of the first 4000 characters, that isn't static."""
    head = F.array_join(F.slice(lines(text), 1, 80), "\n")
    found = F.transform(F.concat(matches(head, fixed.URL), matches(cut(text, 4000), fixed.URL)), lambda u: F.regexp_replace(u, r"[。.,，]+$", ""))
    if fallback is not None:
        found = F.concat(found, F.when(F.coalesce(col(fallback), F.lit("")) != "", F.array(col(fallback))).otherwise(F.array().cast("array<string>")))
    return F.coalesce(F.get(F.filter(found, lambda u: ~is_static(u)), 0), F.lit(""))


def file_name(url) -> Column:
    """A safe file name: host and path, and a digest of the query."""
    path = F.regexp_replace(strip(url_path(url), "/"), r"[^A-Za-z0-9._/-]+", "_")
    query = F.regexp_extract(col(url), r"\?([^#]*)", 1)
    return F.concat(F.regexp_replace(host(url), ":", "_"), F.lit("/"), F.when(path == "", "index").otherwise(path), F.when(query != "", F.concat(F.lit("_"), F.substring(F.md5(F.encode(query, "UTF-8")), 1, 8))).otherwise(""))


def profile_slugs(*values, ignored: Sequence[str] = ("faculty", "main", "index", "list", "people", "professors", "www"), most: int = 6) -> Column:
    """Last part of each url's path that looks like a person's page name."""
    urls = matches(F.concat_ws(" ", *[col(v) for v in values]), r"https?://[^\s|<>()\"']+")

    def slug(u: Column) -> Column:
        parts = F.transform(F.reverse(F.split(F.regexp_replace(u, r"^https?://[^/]+", ""), r"[/#?]")), lambda p: F.regexp_replace(F.regexp_replace(F.lower(p), r"\.(?:htm|html|php|jsp|psp|md)$", ""), "_en$", ""))
        return F.get(F.filter(parts, lambda p: p.rlike("^[a-z][a-z0-9]{2,16}$") & ~p.isin(list(ignored))), 0)

    return F.slice(F.array_distinct(F.array_compact(F.transform(urls, slug))), 1, most)


def allowed_host(h, hosts: Sequence[str], suffixes: Sequence[str]) -> Column:
    low = F.lower(col(h))
    out = low.isin([x.lower() for x in hosts]) if hosts else F.lit(False)
    for s in suffixes:
        out = out | low.endswith(s.lower())
    return out


def is_web_page(url) -> Column:
    """Whether a url can be a page: not a binary or asset by its extension."""
    return ~F.lower(url_path(url)).rlike(r"\.(?:" + "|".join(fixed.BINARY_EXTENSIONS) + ")$")


def is_text_file(url, extensions: Sequence[str] = ("pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "txt", "csv", "md")) -> Column:
    return F.lower(url_path(url)).rlike(r"\.(?:" + "|".join(extensions) + ")$")


def should_follow(url, hosts: Sequence[str] = (), suffixes: Sequence[str] = ()) -> Column:
    return col(url).rlike("^https?://") & is_web_page(url) & (allowed_host(host(url), hosts, suffixes) if hosts or suffixes else F.lit(True))


def is_not_found(text) -> Column:
    """Whether a page says that it isn't there (first 800 characters), or is empty."""
    return (F.coalesce(col(text), F.lit("")) == "") | contains_any(cut(text, 800), fixed.NOT_FOUND, lower=True)


def page_text(html) -> Column:
    """Text of simple HTML: scripts, styles and tags dropped, common entities replaced, white space collapsed."""
    out = F.regexp_replace(col(html), r"(?is)<(script|style)\b.*?</(?:script|style)>", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]+>", " ")
    for name, char in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("amp", "&")):
        out = F.replace(out, F.lit(f"&{name};"), F.lit(char))
    return F.trim(F.regexp_replace(out, r"[ \t\n\r]+", " "))
