"""Classes of search hits: what a hit is evidence of, for the codes and persons of its query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import compact_ascii, contains_any
from .routes import has_code

_FIELDS = ("title", "text", "url", "path", "category")


def _any(values: Column, test) -> Column:
    """Whether any value of an array passes; false for null arrays."""
    return F.coalesce(F.exists(values, test), F.lit(False))


def names_cjk(hay: Column, name: Column) -> Column:
    """Whether a name (a column) stands in a text with no Han letter beside it, but for a title or particle behind it."""
    behind = "|".join([r"(?![\x{4e00}-\x{9fff}])", *(f"(?={x})" for x in fixed.AFTER_NAMES)])
    return F.regexp_like(hay, F.concat(F.lit(r"(?<![\x{4e00}-\x{9fff}])\Q"), name, F.lit(rf"\E(?:{behind})")))


def hit_classes(hits: DataFrame, mail_domain: str | None = None, codes: str = "codes", persons: str = "persons") -> DataFrame:
    """``hits`` with four booleans: ``primary_record, loose_record, profile, names_person``.

    Of ``title, text, url, path, category`` those that are absent or null are empty; ``codes`` holds a query's codes
    in upper case, ``persons`` its persons (``cjk``, ``latin``), null or empty ones fit nothing. A primary record
    has a code as its title, on its code line or in its heading, and is a course by its category or names teachers; a
    loose one names teachers and the code anywhere. A profile is known by category, url, title or the words at its head
    (``fixed.PROFILE_HEADS``; that they stand there is what tells it), unless it is a course or a listing; with
    ``mail_domain``, so is a page whose head has that domain and an academic rank. Persons are sought in whole texts.
    Columns only: no shuffle, no Python.
    """
    title, text, url, path, category = (F.coalesce(hits[c], F.lit("")) if c in hits.columns else F.lit("") for c in _FIELDS)
    course = category.isin(*fixed.COURSE_EVIDENCE)
    taught = F.contains(text, F.lit(fixed.TEACHERS_LABEL))

    def heads(c: Column) -> Column:
        heading = F.regexp_like(text, F.concat(F.lit(r"(?iU)^#\s*\Q"), c, F.lit(r"\E\b")))
        return (F.upper(title) == c) | F.contains(text, F.concat(F.lit(fixed.CODE_LABEL), c)) | heading

    listing = contains_any(F.lower(url), fixed.LISTING_PATHS) | contains_any(F.lower(path), fixed.LISTING_PATHS)
    known = [category.isin(*fixed.PROFILE_EVIDENCE), contains_any(F.lower(url), fixed.PROFILE_PATHS), contains_any(F.lower(title), fixed.PROFILE_TITLES)]
    known += [contains_any(F.lower(F.substring(text, 1, n)), words) for n, words in fixed.PROFILE_HEADS]
    if mail_domain:
        head = F.lower(F.substring(text, 1, fixed.PROFILE_HEADS[0][0]))
        known.append(F.contains(head, F.lit("associate professor")) & F.contains(head, F.lit("@" + mail_domain.lower())))
    profile = known[0]
    for other in known[1:]:
        profile = profile | other

    hay = F.concat_ws("\n", title, text, url, path)
    low, compact = F.lower(hay), compact_ascii(hay)

    def named(p: Column) -> Column:
        cjk, latin = F.coalesce(p["cjk"], F.lit("")), F.coalesce(p["latin"], F.lit(""))
        short = compact_ascii(latin)
        return ((cjk != "") & names_cjk(hay, cjk)) | ((latin != "") & (F.contains(low, F.lower(latin)) | ((short != "") & F.contains(compact, short))))

    return hits.withColumns(
        {
            "primary_record": (course | taught) & _any(F.col(codes), heads),
            "loose_record": taught & _any(F.col(codes), lambda c: has_code(F.concat_ws("\n", title, text), c)),
            "profile": ~course & ~listing & profile,
            "names_person": _any(F.col(persons), named),
        }
    )
