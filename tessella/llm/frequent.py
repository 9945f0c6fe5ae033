"""The rows of largest weight, as many as fit a bound, without sorting or a single task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def heaviest(rows: DataFrame, weight: str, most: int) -> DataFrame:
    """Those rows whose weight (1 or more) is in the top bins, with ``most`` rows at most: bins are eighths of powers of two.

    Only the counts of bins, some hundred numbers, come to the driver. A bin is taken whole or not at all, but if
    even the top one is too large, none is: rows are then all alike and no choice among them helps.
    """
    bin_of = F.floor(F.log2(F.col(weight).cast("double")) * 8).cast("long")
    bins = sorted(((r["bin"], r["n"]) for r in rows.groupBy(bin_of.alias("bin")).agg(F.count("*").alias("n")).collect()), reverse=True)
    least, total = None, 0
    for b, n in bins:
        total += n
        if total > most:
            break
        least = b
    return rows.filter(bin_of >= least) if least is not None else rows.limit(0)
