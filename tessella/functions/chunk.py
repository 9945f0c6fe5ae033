"""Chunkers as columns that return arrays of strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, lines, normal_plain, normal_space, strip

_NONE = "array<string>"


def windows(c, most: int = 900, overlap: int = 120, least: int = 80) -> Column:
    """Windows of ``most`` characters that share ``overlap``; each stripped, those below ``least`` characters dropped."""
    c, step = col(c), most - overlap
    # starts go on until a window reaches the end: 0, step, 2 * step, ...
    last = F.greatest(F.lit(0), F.ceil((F.length(c) - most) / step).cast("int") * step)
    cuts = F.transform(F.sequence(F.lit(0), last, F.lit(step)), lambda s: strip(F.substring(c, s + 1, F.lit(most))))
    return F.filter(cuts, lambda x: F.length(x) >= least)


def chunk_plain(c, most: int = 900, overlap: int = 120, least: int = 80) -> Column:
    """Chunks of the plain form, which is one paragraph: itself, or windows."""
    return windows(normal_plain(c), most, overlap, least)


def _packed(units: Column, most: int, overlap: int, least: int) -> Column:
    """Units packed in order, joined by line ends, while they fit; longer ones are cut into windows."""
    start = F.struct(F.array().cast(_NONE).alias("out"), F.lit(None).cast("string").alias("held"))

    def flushed(acc: Column) -> Column:
        held = strip(acc["held"])
        return F.when(F.coalesce(F.length(held), F.lit(0)) >= least, F.concat(acc["out"], F.array(held))).otherwise(acc["out"])

    def add(acc: Column, unit: Column) -> Column:
        fits = F.coalesce(F.length(acc["held"]) + 1, F.lit(0)) + F.length(unit) <= most
        return (
            F.when(F.length(unit) > most, F.struct(F.concat(flushed(acc), windows(unit, most, overlap, least)).alias("out"), F.lit(None).cast("string").alias("held")))
            .when(fits, F.struct(acc["out"].alias("out"), F.concat_ws("\n", acc["held"], unit).alias("held")))
            .otherwise(F.struct(flushed(acc).alias("out"), unit.alias("held")))
        )

    return F.aggregate(units, start, add, flushed)


def _stripped(parts: Column) -> Column:
    return F.filter(F.transform(parts, lambda x: strip(x)), lambda x: x != "")


def chunk_lines(c, most: int = 950, overlap: int = 120, least: int = 120) -> Column:
    """Paragraphs, or lines where there is but one paragraph, packed into chunks."""
    paragraphs = _stripped(F.split(col(c), "\n{2,}", -1))
    return _packed(F.when(F.size(paragraphs) > 1, paragraphs).otherwise(_stripped(lines(c))), most, overlap, least)


def chunk_paragraphs(c, most: int = 900, overlap: int = 120, least: int = 120) -> Column:
    """Paragraphs of the space-normalised text, packed into chunks."""
    return _packed(_stripped(F.split(normal_space(c), "\n{2,}", -1)), most, overlap, least)
