"""Tokens, normal forms, snippets and other string functions as columns.

Java's regular expressions and Spark's ``trim`` know fewer white-space characters than Unicode has, so patterns carry
the flag ``(?U)`` where any white space is meant.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import pandas_udf

from . import fixed


@pandas_udf(T.StringType())
def nfkc(values: pd.Series) -> pd.Series:
    """Unicode compatibility form; Spark has no function for it."""
    return values.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c, chars: str = r"\s") -> Column:
    """``c`` without the characters of the class ``chars`` at both ends."""
    return F.regexp_replace(col(c), rf"(?U)^[{chars}]+|[{chars}]+$", "")


def lines(c) -> Column:
    """Lines of a text; CR LF and CR end lines too."""
    return F.split(F.regexp_replace(col(c), r"\r\n?", "\n"), "\n", -1)


def cut(c, n) -> Column:
    """The first ``n`` characters."""
    return F.substring(col(c), 1, n) if isinstance(n, int) else col(c).substr(F.lit(1), n)


def matches(c, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(col(c), F.lit(pattern), F.lit(group))


def contains_any(c, terms: Iterable[str], lower: bool = False) -> Column:
    """Whether one of the terms occurs (``lower``: in lower case on both sides)."""
    c = F.lower(col(c)) if lower else col(c)
    out = F.lit(False)
    for t in terms:
        out = out | c.contains(t.lower() if lower else t)
    return out


def count_of(c, terms: Iterable[str]) -> Column:
    """How many of the terms occur, in lower case."""
    low = F.lower(col(c))
    return sum((low.contains(t.lower()).cast("int") for t in terms), F.lit(0))


# tokens


def _windows(run: Column, n: int) -> Column:
    return F.when(F.length(run) >= n, F.transform(F.sequence(F.lit(1), F.length(run) - n + 1), lambda i: F.substring(run, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def tokens(c, wide: bool = False) -> Column:
    """Mixed-script tokens, duplicates kept: ASCII words and numbers in lower case, then for each CJK run the run itself
    if it is short, its characters that aren't stop characters, and its n-grams. ``wide``: the larger ASCII alphabet, runs to 12, n to 4."""
    c, longest, sizes = col(c), 12 if wide else 8, (2, 3, 4) if wide else (2, 3)
    words = matches(F.lower(c), fixed.ASCII_TOKEN_WIDE if wide else fixed.ASCII_TOKEN)

    def of(run: Column) -> Column:
        whole = F.when(F.length(run) <= longest, F.array(run)).otherwise(F.array().cast("array<string>"))
        single = F.filter(_windows(run, 1), lambda x: ~F.lit(fixed.CJK_STOP).contains(x))
        return F.concat(whole, single, *[_windows(run, n) for n in sizes])

    return F.when(c.isNull(), F.array().cast("array<string>")).otherwise(F.concat(words, F.flatten(F.transform(matches(c, fixed.CJK_RUN), of))))


def query_tokens(c, wide: bool = False) -> Column:
    """Distinct tokens of two characters or more, in order."""
    return F.array_distinct(F.filter(tokens(c, wide), lambda x: F.length(x) >= 2))


def text_parts(c, wide: bool = False) -> Column:
    """The runs of letters and digits in a text's tokens: what an index makes of them that splits at all other characters."""
    return matches(F.array_join(tokens(c, wide), " "), fixed.INDEX_PART)


def match_terms(c, most: int = 48, wide: bool = False, least: int = 1) -> Column:
    """Distinct tokens from the longest (equal lengths: last in order first), at most ``most``."""
    found = F.filter(F.array_distinct(tokens(c, wide)), lambda x: F.length(x) >= least)
    return F.slice(F.transform(F.sort_array(F.transform(found, lambda x: F.struct(F.length(x).alias("n"), x.alias("t"))), asc=False), lambda s: s["t"]), 1, most)


def match_query(terms: Column) -> Column:
    """A full-text query string: quoted terms joined by OR."""
    return F.array_join(F.transform(terms, lambda t: F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))), " OR ")


def parser_query(c) -> Column:
    """A query without the characters that a query parser would read as its own."""
    return strip(F.regexp_replace(F.regexp_replace(col(c), r"(?U)[^\w\x{4e00}-\x{9fff}+#.\-]+", " "), r"\s+", " "))


def unique_tokens(c, most: int = 2400) -> Column:
    return F.slice(F.array_distinct(F.filter(F.transform(tokens(c), F.lower), lambda x: F.length(x) >= 2)), 1, most)


def search_text(*values, wide: bool = False) -> Column:
    """Tokens of the non-empty values, joined by spaces."""
    return F.array_join(tokens(F.concat_ws("\n", *[F.nullif(col(v), F.lit("")) for v in values]), wide), " ")


def embedding_text(title, category, url, text, most: int = 1800) -> Column:
    return cut(F.concat_ws("\n", *[F.nullif(col(v), F.lit("")) for v in (title, category, url, text)]), most)


def expand(c, dictionary: Mapping[str, Sequence[str]] = fixed.EXPANSIONS) -> Column:
    """A query and the synonyms of every trigger it holds, in the dictionary's order."""
    c = col(c)
    low = F.lower(c)
    return F.concat_ws(" ", c, *[F.when(low.contains(k.lower()), F.lit(" ".join(v))) for k, v in dictionary.items()])


# normal forms


def normal_plain(c) -> Column:
    """Ideographic spaces as spaces, one kind of line end, white space collapsed, no empty lines."""
    kept = F.filter(F.transform(lines(F.replace(col(c), F.lit("　"), F.lit(" "))), lambda x: strip(F.regexp_replace(x, r"(?U)\s+", " "))), lambda x: x != "")
    return F.array_join(kept, "\n")


def normal_space(c) -> Column:
    return strip(F.regexp_replace(F.replace(F.regexp_replace(nfkc(col(c)), r"\r\n?", "\n"), F.lit("　"), F.lit(" ")), r"[ \t]+", " "))


def normal_line(c, compatible: bool = True) -> Column:
    """``compatible=False`` leaves out the compatibility form, for text that has it."""
    c = nfkc(col(c)) if compatible else col(c)
    spaced = F.regexp_replace(F.replace(c, F.lit("　"), F.lit(" ")), r"(?i)&(?:nbsp|amp|lt|gt|quot);", " ")
    return strip(F.regexp_replace(spaced, r"[ \t]+", " "))


def normal_for_hash(c, compatible: bool = True) -> Column:
    """The form whose hash tells duplicates: compatibility form, white space collapsed, lower case."""
    c = nfkc(col(c)) if compatible else col(c)
    return F.lower(strip(F.regexp_replace(c, r"(?U)\s+", " ")))


def stable_hash(c, n: int = 16) -> Column:
    return F.substring(F.sha1(F.encode(col(c), "UTF-8")), 1, n)


def chunk_uid(doc_key, index, chunk_hash) -> Column:
    return stable_hash(F.concat_ws(":", col(doc_key), col(index).cast("string"), col(chunk_hash)), 32)


def chunk_uid_short(doc_uid, index, text) -> Column:
    return stable_hash(F.concat_ws(":", col(doc_uid), col(index).cast("string"), normal_for_hash(cut(text, 220))), 24)


def answer_form(c) -> Column:
    """The form in which answers are compared: compatibility form, lower case, ASCII punctuation, no white space."""
    plain = F.translate(F.lower(nfkc(F.coalesce(col(c), F.lit("")))), "（），。“”’", "(),.\"\"'")
    return F.regexp_replace(plain, r"(?U)\s+", "")


def trim_text(c, n: int) -> Column:
    """At most ``n`` characters, an ellipsis in place of what is cut."""
    c = col(c)
    if n <= 3:
        return cut(c, n)
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.regexp_replace(cut(c, n - 3), r"(?U)\s+$", ""), F.lit("...")))


def replace_all(c, aliases: Mapping[str, str]) -> Column:
    """Replacements one after the other, in order."""
    c = col(c)
    for old, new in aliases.items():
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def compact_ascii(c) -> Column:
    return F.regexp_replace(F.lower(col(c)), r"[^a-z0-9]+", "")


_EDGE = r" ,，;；、。.!！?？:：\"'`\[\]{}()（）<>《》"


def keyword(c) -> Column:
    """A search keyword without generic words and outer punctuation; empty if nothing else is in it."""
    c = strip(F.regexp_replace(nfkc(F.coalesce(col(c), F.lit(""))), r"(?U)\s+", " "))
    for term in fixed.GENERIC_TERMS:
        c = strip(F.regexp_replace(c, "(?iu)" + term, ""))
    return strip(strip(F.regexp_replace(c, r"(?U)\s+", " ")), _EDGE)


def query_form(c, most: int = 180) -> Column:
    return cut(strip(strip(F.regexp_replace(nfkc(F.coalesce(col(c), F.lit(""))), r"(?U)\s+", " ")), _EDGE), most)


def snippet(text, terms: Column, most: int = 240) -> Column:
    """A window of ``most`` characters about the longest of the terms (two characters or more) that occurs; else the beginning."""
    text = col(text)
    low = F.lower(text)
    by_length = F.array_sort(F.transform(F.filter(terms, lambda t: F.length(t) >= 2), lambda t: F.struct((-F.length(t)).alias("n"), F.array_position(terms, t).alias("p"), t.alias("t"))))
    hits = F.filter(F.transform(by_length, lambda s: F.position(F.lower(s["t"]), low)), lambda p: p > 0)
    at = F.get(hits, 0) - 1
    left = F.greatest(F.lit(0), at - most // 3)
    right = F.least(F.length(text), left + most)
    window = F.concat(F.when(left > 0, "...").otherwise(""), strip(text.substr((left + 1).cast("int"), (right - left).cast("int"))), F.when(right < F.length(text), "...").otherwise(""))
    return F.when(F.length(text) <= most, text).when(at.isNull(), strip(cut(text, most))).otherwise(window)


def source_id(path, index, kind=None, title=None) -> Column:
    base = F.concat(col(path), F.lit("#chunk="), col(index).cast("string"))
    return base if kind is None else F.concat(col(kind), F.lit(":"), base, F.lit("; title="), col(title))


def contains_phrase(c, phrase: str, followed_by: Sequence[str] = ()) -> Column:
    """Whether ``phrase`` occurs with no CJK character before it and none after, but for the suffixes ``followed_by``."""
    import re

    after = "|".join([r"(?![\x{4e00}-\x{9fff}])", *[f"(?={re.escape(x)})" for x in followed_by]])
    return col(c).rlike(rf"(?<![\x{{4e00}}-\x{{9fff}}])\Q{phrase}\E(?:{after})")


def contains_code(c, code: str) -> Column:
    """Whether a code occurs, upper-cased, with no letter or digit beside it."""
    return F.upper(col(c)).rlike(rf"(?<![A-Z0-9])\Q{code.upper()}\E(?![A-Z0-9])")
