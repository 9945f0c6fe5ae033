"""Duplicates and diversity."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.extract import source_key
from ..functions.text import normal_for_hash, stable_hash
from ..sources.stored import scratch


def content_hash(c, n: int = 40, compatible: bool = True) -> Column:
    return stable_hash(normal_for_hash(c, compatible), n)


def first_wins(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key. Rows are reduced in each task before they are shuffled, so a hot key costs no more than others."""
    rest = [c for c in rows.columns if c not in keys]
    lead = F.struct(*[F.col(c) for c in order]).alias("_order")
    least = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), lead).alias("_row")) if rest else rows.select(*keys).distinct()
    return least.select(*keys, "_row.*").select(*rows.columns) if rest else least


def duplicates(rows: DataFrame, key: Column, id_col: str) -> DataFrame:
    """Each row's id and the least id of the rows with its key."""
    keyed = rows.select(F.col(id_col), key.alias("_key"))
    return keyed.join(keyed.groupBy("_key").agg(F.min(id_col).alias("first_id")), "_key").select(id_col, "first_id")


def exclude(rows: DataFrame, seen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key isn't in ``seen``."""
    return rows.join(seen.select(*keys), list(keys), "left_anti")


def append_new(hits: DataFrame, more: DataFrame, most: int) -> DataFrame:
    """``hits`` and the best ``most`` rows of ``more`` whose chunk isn't there yet, by query."""
    new = exclude(more, hits, ["query_id", "chunk_id"])
    ranked = new.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))).filter(F.col("_n") <= most).drop("_n")
    return hits.unionByName(ranked)


def cap_per(rows: DataFrame, groups: Sequence[str], most: int, order: Sequence[Column]) -> DataFrame:
    """At most ``most`` rows of each group, best first."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).filter(F.col("_n") <= most).drop("_n")


def solid(c, n: int) -> Column:
    """The first ``n`` characters of a text that aren't white space; where the text's beginning has as many, the rest is not searched."""
    c = F.col(c) if isinstance(c, str) else c
    lead = F.regexp_replace(F.substring(c, 1, 2 * n), r"(?U)\s+", "")
    return F.substring(F.when(F.length(lead) >= n, lead).otherwise(F.regexp_replace(c, r"(?U)\s+", "")), 1, n)


def greedy_diverse(hits: DataFrame, top_k: int, codes: str | None = None, phrases: str | None = None, pool: int | None = None) -> DataFrame:
    """Per query the first ``top_k`` hits, by score, that repeat no text, place or title and keep to a cap per source and per title.

    ``hits``: ``query_id, chunk_id, chunk_index, score, title, url, path, text`` (arrays ``codes`` and ``phrases`` of the
    query lift the cap of titles that name them). Caps depend on what was taken before, so a query's candidates, a few
    hundred, are one group; only keys are sent, not texts. For more candidates, ``pool`` is how many are one group at once:
    what the hits taken so far rule out is dropped and the next best follow, until ``top_k`` are taken or none is left.
    """
    low = F.lower(F.coalesce("title", F.lit("")))
    lists = [F.col(c) if c else F.array().cast("array<string>") for c in (codes, phrases)]
    named = F.exists(lists[0], lambda c: F.contains(F.upper("title"), c)) | F.exists(lists[1], lambda p: (p != "") & F.contains(F.col("title"), p))
    # Titles of pages that hold many facts.
    many = low.contains("schedule") | low.contains("class sched") | low.contains("课程表") | low.contains("课表") | low.contains("培养方案") | low.contains("program")
    keys = hits.select(
        "query_id", "chunk_id", "score",
        F.xxhash64(solid("text", 700)).alias("text_key"),
        F.xxhash64("path", "title", "chunk_index").alias("place_key"),
        F.xxhash64(F.regexp_replace(low, r"(?U)\s+", ""), solid("text", 240)).alias("title_text_key"),
        source_key("url", "path").alias("source_key"),
        F.regexp_replace(low, r"(?U)\s+", "").alias("title_key"),
        F.when(named | many, 2).otherwise(1).alias("title_limit"),
    )
    per_source = 2 if top_k >= 6 else 1
    columns = keys.columns

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["rank", "score", "chunk_id"], ascending=[True, False, True], kind="stable", na_position="last")
        seen: set = set()
        counts: dict = {}
        out = []
        for r in rows.itertuples(index=False):
            marks = {("text", r.text_key), ("place", r.place_key), ("title", r.title_text_key)}
            source, title = ("source", r.source_key), ("title", r.title_key)
            if marks & seen or counts.get(source, 0) >= per_source or (r.title_key and counts.get(title, 0) >= r.title_limit):
                continue
            seen |= marks
            counts[source] = counts.get(source, 0) + 1
            if r.title_key:
                counts[title] = counts.get(title, 0) + 1
            out.append((*[getattr(r, c) for c in columns], len(out) + 1))
            if len(out) >= top_k:
                break
        return pd.DataFrame(out, columns=[*columns, "rank"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keys.schema) + ", rank int"
    unranked = lambda rows: rows.withColumn("rank", F.lit(None).cast("int"))
    if pool is None:
        taken = unranked(keys).groupBy("query_id").applyInPandas(pick, schema)
    else:
        keys = scratch(keys, "diverse-keys")
        taken = scratch(unranked(_best(keys, pool)).groupBy("query_id").applyInPandas(pick, schema), "diverse-taken")
        # the best hit that is open is always taken, so each round but the last adds one to every query that isn't done
        for _ in range(top_k - 1):
            left = scratch(_best(_open_hits(keys, taken, top_k, per_source), pool), "diverse-left")
            if not left.limit(1).count():
                break
            taken = scratch(taken.unionByName(unranked(left)).groupBy("query_id").applyInPandas(pick, schema), "diverse-taken")
    return hits.join(taken.select("query_id", "chunk_id", "rank"), ["query_id", "chunk_id"])


def _best(keys: DataFrame, most: int) -> DataFrame:
    return cap_per(keys, ["query_id"], most, [F.desc("score"), F.col("chunk_id")])


def _open_hits(keys: DataFrame, taken: DataFrame, top_k: int, per_source: int) -> DataFrame:
    """The hits that ``taken`` doesn't rule out, of the queries with fewer than ``top_k``."""
    marks = ["text_key", "place_key", "title_text_key"]
    sets = taken.groupBy("query_id").agg(F.count("*").alias("n"), *[F.collect_list(F.struct(F.col(c))).alias(f"_{c}") for c in (*marks, "source_key", "title_key")]).filter(F.col("n") < top_k)
    # one row a query, of fewer than top_k keys each
    both = keys.join(sets, "query_id")
    times = lambda c: F.size(F.filter(F.col(f"_{c}"), lambda x: x[c].eqNullSafe(F.col(c))))
    free = (times("source_key") < per_source) & ((F.col("title_key") == "") | (times("title_key") < F.col("title_limit")))
    for c in marks:
        free = free & (times(c) == 0)
    return both.filter(free).select(keys.columns)
