"""Garbled text, relevance, categories and quality scores as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .extract import host, is_static, url_path
from .fixed import Domain
from .text import col, contains_any, count_of, cut, strip

_CJK, _CYRILLIC, _GREEK = r"[\x{4e00}-\x{9fff}]", r"[\x{0400}-\x{04ff}]", r"[\x{0370}-\x{03ff}]"


def _sum_of(c: Column, terms) -> Column:
    """Occurrences of the terms, each counted without overlap."""
    return sum((((F.length(c) - F.length(F.replace(c, F.lit(t), F.lit("")))) / len(t)) for t in terms), F.lit(0.0))


def garbled(c) -> Column:
    """Whether a text seems decoded with the wrong charset, or is made of PDF character ids."""
    c = col(c)
    head = cut(c, 5000)
    cjk, foreign = F.regexp_count(head, F.lit(_CJK)), F.regexp_count(head, F.lit(f"{_CYRILLIC}|{_GREEK}"))
    long = F.length(head) >= 300
    return (
        c.rlike(r"\(cid:\d+\)") | c.contains("â") | c.contains("ä ̧") | head.contains("Ã") | head.contains("�")
        | (long & (cjk < 20) & (foreign > 80)) | (long & (cjk < 30) & (_sum_of(head, fixed.MOJIBAKE) > 50)) | contains_any(head, fixed.MISREAD)
    )


def garbled_head(c) -> Column:
    """The narrower test of the second build: the first 5000 characters alone."""
    head = cut(c, 5000)
    return contains_any(head, ("�", "â", "Ã")) | ((F.length(head) >= 300) & (F.regexp_count(head, F.lit(_CJK)) < 30) & (_sum_of(head, fixed.MOJIBAKE_2) > 30))


def irrelevant_pdf(name, text, domain: Domain = Domain()) -> Column:
    """Whether a PDF's text is off topic, or a paper: no relevance term, or two academic terms and no term worth keeping."""
    head = F.concat_ws("\n", col(name), cut(text, 5000))
    wide = F.concat_ws("\n", col(name), cut(text, 8000))
    off = ~contains_any(wide, domain.relevance_terms, lower=True) if domain.relevance_terms else F.lit(False)
    return off | ((count_of(head, fixed.PDF_KEEP) == 0) & (count_of(head, fixed.PDF_ACADEMIC) >= 2))


def academic_pdf(path, url, source_type, text) -> Column:
    """Whether a document that is a PDF has an academic term and none worth keeping."""
    where = F.lower(F.concat_ws("\n", col(path), col(url)))
    head = F.concat_ws("\n", where, F.lower(cut(text, 5000)))
    return (where.contains(".pdf") | (col(source_type) == "pdf_md")) & (count_of(head, fixed.PDF_KEEP) == 0) & (count_of(head, fixed.PDF_ACADEMIC) >= 1)


def adjusted_quality(base, text, source_type, category, host_name, path, domain: Domain = Domain()) -> Column:
    low = F.lower(F.concat_ws("\n", cut(text, 5000), col(path)))
    ends = lambda names: contains_end(host_name, names)
    pdf = col(source_type) == "pdf_md"
    score = (
        col(base) + F.when(ends(domain.host_suffixes), 0.04).otherwise(0.0) + F.when(contains_any(host_name, domain.favoured_hosts), 0.03).otherwise(0.0)
        + F.when(col(category).isin(list(domain.favoured_categories)), 0.04).otherwise(0.0)
        + F.when(pdf & contains_any(low, fixed.PDF_KEEP, lower=True), 0.18).otherwise(0.0) - F.when(pdf & contains_any(low, fixed.PDF_ACADEMIC), 0.22).otherwise(0.0)
        - F.when(F.length(col(text)) < 300, 0.08).otherwise(0.0)
    )
    return F.greatest(F.lit(0.05), F.least(score, F.lit(1.0)))


def contains_end(c, ends) -> Column:
    out = F.lit(False)
    for x in ends:
        out = out | F.coalesce(col(c).endswith(x), F.lit(False))
    return out


def tier_quality(tier, category, url, text, domain: Domain = Domain()) -> Column:
    """Quality from a document's tier of origin, host, url, category, e-mail, length and garbling, from 0 to 0.99."""
    steps = F.lit(0.0)
    for k, v in fixed.TIER_QUALITY.items():
        steps = F.when(col(tier) == k, v).otherwise(steps)
    where = host(url)
    score = (
        F.lit(0.45) + steps + F.when(where.isin(list(domain.hosts)), 0.08).otherwise(0.0) + F.when(where.isin(list(domain.favoured_hosts)) | contains_end(where, ["." + h for h in domain.favoured_hosts]), 0.10).otherwise(0.0)
        + F.when(F.coalesce(col(url), F.lit("")) != "", 0.05).otherwise(0.0) + F.when(col(category).isin(list(domain.favoured_categories)), 0.05).otherwise(0.0)
        + F.when(col(text).rlike("(?U)" + fixed.EMAIL), 0.02).otherwise(0.0) - F.when(F.length(col(text)) < 120, 0.08).otherwise(0.0)
        - F.when(garbled_head(text), 0.25).otherwise(0.0) - F.when(where.isin(list(domain.noise_hosts)), 0.40).otherwise(0.0)
    )
    return F.greatest(F.lit(0.0), F.least(score, F.lit(0.99)))


def structured_quality(base, confidence) -> Column:
    return F.greatest(F.lit(0.05), F.least(col(base) * col(confidence), F.lit(1.0)))


def path_category(source_type, path, domain: Domain = Domain()) -> Column:
    low, out = F.lower(col(path)), F.when(F.lit(False), "")
    for words, category in domain.path_categories:
        out = out.when(contains_any(low, words), category)
    return out.when(col(source_type) == "pdf_md", "pdf").when(col(source_type) == "training", "program").otherwise(col(source_type))


def voted_category(title, text, url, domain: Domain, fallback: str = "general") -> Column:
    """The category most of whose words occur (ties: first by name)."""
    hay = F.lower(F.concat_ws("\n", col(title), cut(text, 5000), col(url)))
    votes = F.array(*[F.struct((-count_of(hay, words)).alias("n"), F.lit(c).alias("c")) for c, words in sorted(domain.category_words.items())]) if domain.category_words else None
    if votes is None:
        return F.lit(fallback)
    best = F.array_min(votes)
    return F.when(best["n"] < 0, best["c"]).otherwise(fallback)


def skip_reason(host_name, url, title, text, domain: Domain = Domain(), noise_terms=("arxiv", "doi.org")) -> Column:
    """Why a page isn't taken: the first reason that holds, or null."""
    solid = F.length(F.regexp_replace(col(text), r"(?U)\s+", ""))
    official = contains_end(host_name, domain.host_suffixes) | col(host_name).isin(list(domain.hosts)) if domain.hosts or domain.host_suffixes else F.lit(True)
    return (
        F.when(~official, "non_official_host").when(is_static(url), "static_or_binary_url").when(garbled_head(text), "garbled")
        .when(col(host_name).isin(list(domain.noise_hosts)) | contains_any(F.concat_ws("\n", url_path(url), col(title)), noise_terms, lower=True), "external_or_academic_noise")
        .when(solid < 120, "too_short")
    )


def title_of(text, fallback=None) -> Column:
    """The first heading of the first 80 lines, else their first line that is no noise; at most 180 characters."""
    from ..operators.clean import inline_text, noise_line

    head = F.slice(F.split(F.regexp_replace(col(text), r"\r\n?", "\n"), "\n", -1), 1, 80)
    good = lambda t: (F.length(t) >= 1) & ~noise_line(t) & ~F.lower(t).contains("http")
    headings = F.filter(F.transform(F.filter(head, lambda x: x.rlike(fixed.HEADING)), lambda x: inline_text(F.regexp_extract(x, fixed.HEADING, 1))), good)
    plain = F.filter(F.transform(head, lambda x: inline_text(F.regexp_replace(x, r"^#+\s*", ""))), lambda t: good(t) & (F.length(t) >= 2))
    last = inline_text(fallback) if fallback is not None else F.lit("")
    return cut(F.coalesce(F.get(headings, 0), F.get(plain, 0), last), 180)


def solid_length(c) -> Column:
    return F.length(strip(c))
