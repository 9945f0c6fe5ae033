"""Two-hop evidence: from the record a query names to the persons in it and on to their own pages."""

from __future__ import annotations

import re
from collections.abc import Sequence
from itertools import zip_longest

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import pandas_udf

from ..functions.text import compact_ascii
from .rank import top_k

PERSONS = T.ArrayType(T.StructType([T.StructField("cjk", T.StringType()), T.StructField("latin", T.StringType())]))

#: What a line of names is made of: a parenthesis, a mark between persons, a run of Han letters, a Latin name.
_TOKEN = re.compile(r"(?P<group>[（(][^()（）]+[）)])|(?P<mark>[,，、;；/])|(?P<cjk>[一-鿿]{2,4})|(?P<latin>\b[A-Z][a-z]+(?:[ -][A-Z][a-z]+){1,3}\b)")
# Parts of runs that look like names and are none.
NOT_PERSONS = {
    "cjk": ("教师", "老师", "教授", "导师", "任课", "课程", "学院", "大学", "学分"),
    "latin": ("University", "School", "Institute", "Department", "College"),
}


def _names(text: str) -> pd.DataFrame:
    """``piece, kind, inside, name`` of the names in a line: pieces lie between marks, ``inside`` those in parentheses."""
    rows: list[tuple[int, str, bool, str]] = []
    piece = 0

    def put(kind: str, name: str, inside: bool) -> None:
        if not any(w in name for w in NOT_PERSONS[kind]) and (piece, kind, inside, name) not in rows:
            rows.append((piece, kind, inside, name))

    for token in _TOKEN.finditer(text):
        kind = token.lastgroup
        if kind == "mark":
            piece += 1
        elif kind == "group":
            for inner in _TOKEN.finditer(token[0][1:-1]):
                if inner.lastgroup == "latin":
                    put("latin", inner[0], True)
        else:
            put(kind, token[0], False)
    return pd.DataFrame(rows, columns=["piece", "kind", "inside", "name"])


def _paired(cjk: Sequence[str], latin: Sequence[str]) -> list[tuple[str, str]]:
    """Names of two scripts by place; Latin ones alone only where there are no others."""
    return [(a, b or "") for a, b in zip_longest(cjk, latin[: len(cjk)])] if len(cjk) else [("", b) for b in latin]


def persons_of(text: str | None) -> list[tuple[str, str]]:
    """(CJK name, Latin name) of each person in a line of names; names pair by place, or inside one piece.

    One parenthesis with several Latin names belongs to the CJK names before it, in order.
    """
    line = re.sub(r"\s+", " ", (text or "").replace(".", " "))
    found = _names(line)
    han, inner = (list(dict.fromkeys(found.name[k])) for k in ((found.kind == "cjk"), found.inside.astype(bool)))
    if len(inner) > 1 and han and line.count("(") + line.count("（") == 1:
        pairs = _paired(han, inner)
    else:
        pairs = []
        for _, own in found.groupby("piece", sort=True):
            latin = own[own.kind == "latin"]
            latin = latin[latin.inside] if latin.inside.any() else latin
            pairs += _paired(list(own.name[own.kind == "cjk"]), list(latin.name))
    # rows that share a name are one person
    persons: list[list[str]] = []
    known: dict[str, list[str]] = {}
    for pair in pairs:
        forms = [x.lower() for x in pair if x]
        person = next((known[x] for x in forms if x in known), None)
        if person is None:
            person = ["", ""]
            persons.append(person)
        person[:] = [old or new for old, new in zip(person, pair, strict=True)]
        known |= dict.fromkeys(forms, person)
    return [tuple(p) for p in persons]


@pandas_udf(PERSONS)
def persons(values: pd.Series) -> pd.Series:
    return values.map(lambda v: [{"cjk": a, "latin": b} for a, b in persons_of(v)])


def alike(a: Column, b: Column) -> Column:
    """Whether two CJK names are the same but for a character: two shared at least, and all but one of the shorter."""
    shared = F.size(F.array_intersect(F.split(a, ""), F.split(b, "")))
    return (a == b) | ((shared >= 2) & (shared >= F.least(F.length(a), F.length(b)) - 1))


def needs_hop(query, attributes: Sequence[str], roles: Sequence[str] = ("任课", "教师", "老师", "instructor", "teacher", "profile", "homepage", "个人主页"), code: str = r"\b[A-Z]{2,}\d{2,4}[A-Z]?\b") -> Column:
    """Whether a query names a course code, asks for an attribute of a person, and speaks of a role."""
    low = F.lower(query)
    some = lambda words: F.exists(F.array(*[F.lit(w.lower()) for w in words]), lambda w: F.contains(low, w))
    return F.upper(query).rlike(code) & some(attributes) & some(roles)


def hop(records: DataFrame, profiles: DataFrame, k: int = 8) -> DataFrame:
    """``query_id, chunk_id, score, rank``: profile chunks of the persons that a query's records name.

    ``records``: ``query_id, names`` (a line of names); ``profiles``: ``chunk_id, title, text, url, score``. Names are
    joined by their first two characters, or their Latin words without spaces, and then checked in the chunk.
    """
    people = records.select("query_id", F.explode(persons("names")).alias("p")).select("query_id", "p.cjk", "p.latin").distinct()
    hay = F.concat_ws("\n", "title", F.substring("text", 1, 3000), "url")
    tokens = F.array_distinct(F.concat(F.flatten(F.transform(F.regexp_extract_all(hay, F.lit(r"[\x{4e00}-\x{9fff}]{2,}"), F.lit(0)), lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2))))), F.transform(F.regexp_extract_all(hay, F.lit(r"[A-Za-z]{2,}"), F.lit(0)), F.lower)))
    keyed = profiles.select("*", F.explode(tokens).alias("key"))
    wanted = people.withColumn("key", F.when(F.col("cjk") != "", F.substring("cjk", 1, 2)).otherwise(F.lower(F.regexp_extract("latin", r"^(\w+)", 1))))
    found = keyed.join(wanted, "key")
    named = ((F.col("cjk") != "") & F.contains(hay, F.col("cjk"))) | ((F.col("latin") != "") & F.contains(compact_ascii(hay), compact_ascii("latin")))
    return top_k(found.filter(named).groupBy("query_id", "chunk_id").agg(F.max("score").alias("score")), k)


def hop_merge(original: DataFrame, records: DataFrame, profiles: DataFrame, k: int) -> DataFrame:
    """Two records first, then profiles (``max(3, k - 2)`` at most), then the original hits; each chunk once."""
    part = lambda df, n, most: df.filter(F.col("rank") <= most).select("query_id", "chunk_id", F.lit(n).alias("part"), "rank")
    both = part(records, 0, 2).unionByName(part(profiles, 1, max(3, k - 2))).unionByName(part(original, 2, 1 << 30))
    first = both.groupBy("query_id", "chunk_id").agg(F.min(F.struct("part", "rank")).alias("p"))
    return top_k(first, k, order=[F.col("p.part"), F.col("p.rank"), F.col("chunk_id")]).select("query_id", "chunk_id", "rank")
