"""Indexes as tables, ranking, fusion and expansion of ranked lists. A query set is a table ``query_id, query``."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import col, matches, text_parts, tokens
from ..sources.stored import scratch

#: Distinct query terms, and query vectors in one block, that may be broadcast.
MOST_TERMS, MOST_VECTORS = 100_000, 4096
#: Distinct query terms that are looked up inside a row; more are joined.
MOST_LISTED = 1000


def top_k(rows: DataFrame, k: int, by: Sequence[str] = ("query_id",), order: Sequence[Column] | None = None, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group, numbered; Spark keeps no more than ``k`` a group in each task before it shuffles."""
    order = order or [F.desc("score"), F.asc("chunk_id")]
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(rank) <= k)


def within_budget(rows: DataFrame, size: str, budget: int, by: Sequence[str], order: Sequence[str], used: str = "used") -> DataFrame:
    """Rows of each group, in ascending ``order``, as long as their sizes (whole numbers; null is 0) add up to ``budget`` at most; ``used`` is the sum.

    Of rows with a size no more than ``budget + 1`` of a group can matter, so no task takes a whole group; rows without one
    come only from before the place where the budget ends. A total order makes the result one.
    """
    columns = [F.col(c) for c in order]
    window = Window.partitionBy(*by).orderBy(*columns).rowsBetween(Window.unboundedPreceding, 0)
    sized = F.coalesce(F.col(size), F.lit(0))
    running = F.sum(sized).over(window)
    place, end = (f"_{name}_{'_'.join(rows.columns)}" for name in ("place", "end"))
    lead = top_k(rows.filter(sized > 0), budget + 1, by, columns, place).drop(place)
    ends = lead.withColumn(used, running).filter(F.col(used) > budget).groupBy(*by).agg(F.min(F.struct(*order)).alias(end))
    free = rows.filter(sized == 0).join(ends, list(by), "left").filter(F.col(end).isNull() | (F.struct(*order) < F.col(end))).select(*rows.columns)
    return lead.union(free).withColumn(used, running).filter(F.col(used) <= budget)


# the inverted index


def postings(docs: DataFrame, fields: Sequence[str], id_col: str = "chunk_id", wide: bool = False) -> DataFrame:
    """``chunk_id, field, token, tf, len``. A document's tokens are counted inside its row, as runs of the sorted array; nothing is shuffled."""
    parts = []
    for f in fields:
        words = docs.select(F.col(id_col).alias("chunk_id"), F.sort_array(tokens(f, wide)).alias("toks"))
        runs = _runs(words.withColumn("len", F.size("toks").cast("long")))
        parts.append(runs.select("chunk_id", F.lit(f).alias("field"), "token", "tf", "len"))
    return reduce(DataFrame.unionByName, parts)


def _runs(words: DataFrame) -> DataFrame:
    """``chunk_id, token, tf, len`` of rows ``chunk_id, toks`` (sorted), ``len``."""
    starts = words.withColumn("starts", F.expr("filter(transform(toks, (t, i) -> if(i > 0 AND t = get(toks, i - 1), null, i)), i -> i is not null)"))
    run = F.expr("transform(starts, (s, k) -> struct(toks[s] AS token, cast(coalesce(get(starts, k + 1), size(toks)) - s AS long) AS tf))")
    return starts.select("chunk_id", F.explode(run).alias("run"), "len").select("chunk_id", "run.token", "run.tf", "len")


def phrase_postings(docs: DataFrame, lengths: Sequence[int], text_col: str = "text", id_col: str = "chunk_id", wide: bool = False) -> DataFrame:
    """``chunk_id, token, tf, len``: every phrase of so many adjacent parts (``text_parts``), joined by spaces; ``len`` counts parts. Counted inside a row, like ``postings``."""
    words = docs.select(F.col(id_col).alias("chunk_id"), text_parts(text_col, wide).alias("parts"))
    size = F.size("parts")
    phrase = lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.array_join(F.slice("parts", i, F.lit(n)), " "))
    of = [F.col("parts") if n == 1 else F.when(size >= n, phrase(n)).otherwise(F.array().cast("array<string>")) for n in lengths]
    return _runs(words.select("chunk_id", F.sort_array(F.concat(*of)).alias("toks"), size.cast("long").alias("len")))


def field_stats(docs: DataFrame, fields: Sequence[str], wide: bool = False) -> DataFrame:
    """``field, n_docs, avg_len``."""
    parts = [docs.select(F.lit(f).alias("field"), F.size(tokens(f, wide)).alias("len")) for f in fields]
    return _length_stats(reduce(DataFrame.unionByName, parts))


def _length_stats(lengths: DataFrame) -> DataFrame:
    return lengths.groupBy("field").agg(F.count("*").alias("n_docs"), F.greatest(F.sum("len") / F.count("*"), F.lit(1e-9)).alias("avg_len"))


def document_frequency(posted: DataFrame) -> DataFrame:
    """``token, df``: documents that have the token in any field."""
    return posted.select("token", "chunk_id").distinct().groupBy("token").agg(F.count("*").alias("df"))


def row_document_frequency(docs: DataFrame, fields: Sequence[str], wide: bool = False) -> DataFrame:
    """``token, df`` as ``document_frequency`` of the postings gives them, where each row is a document of its own.

    A row's tokens are made distinct inside it, so no (document, token) pair is shuffled, only each task's counts. Null fields have no tokens.
    """
    none = F.array().cast("array<string>")
    own = F.array_distinct(F.concat(*[F.coalesce(tokens(f, wide), none) for f in fields]))
    return docs.select(F.explode(own).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def query_terms(queries: DataFrame, wide: bool = False, most: int | None = None) -> DataFrame:
    """``query_id, token, qtf``; ``most``: of each query the longest distinct terms only, each once."""
    if most:
        from ..functions.text import match_terms

        return queries.select("query_id", F.explode(match_terms("query", most, wide)).alias("token")).withColumn("qtf", F.lit(1).cast("long"))
    return queries.select("query_id", F.explode(tokens("query", wide)).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("qtf"))


def _only(posted: DataFrame, terms: DataFrame):
    """Postings of the queries' tokens, and what to do with tables of one row a term: they are broadcast if the terms are few."""
    wanted = terms.select("token").distinct()
    small = F.broadcast if wanted.limit(MOST_TERMS + 1).count() <= MOST_TERMS else lambda table: table
    return posted.join(small(wanted), "token", "left_semi"), small


def query_postings(docs: DataFrame, fields: Sequence[str], terms: DataFrame, id_col: str = "chunk_id", wide: bool = False) -> tuple[DataFrame, DataFrame]:
    """Postings (all that are among ``terms``), and the ``field_stats`` of all documents, from one reading of the texts.

    A row's tokens are cut once, for its length and for the queries' tokens in it, and only these are sorted and written.
    With more than ``MOST_LISTED`` terms, all postings, nothing written.
    """
    listed = [r[0] for r in terms.select("token").distinct().limit(MOST_LISTED + 1).collect()]
    if len(listed) > MOST_LISTED:
        return postings(docs, fields, id_col, wide), field_stats(docs, fields, wide)
    cut = reduce(DataFrame.unionByName, [docs.select(F.col(id_col).alias("chunk_id"), F.lit(f).alias("field"), tokens(f, wide).alias("all")) for f in fields])
    words = scratch(cut.select("chunk_id", "field", F.sort_array(F.filter("all", lambda t: t.isin(listed))).alias("toks"), F.size("all").cast("long").alias("len")), "query-postings")
    posted = [_runs(words.filter(F.col("field") == f)).withColumn("field", F.lit(f)).select("chunk_id", "field", "token", "tf", "len") for f in fields]
    return reduce(DataFrame.unionByName, posted), _length_stats(words)


def bm25f(docs: DataFrame, queries: DataFrame, weights: Mapping[str, float] = fixed.BM25F_WEIGHTS, b: Mapping[str, float] = fixed.BM25F_B, k1: float = 1.5, categories: Sequence[str] | None = None, id_col: str = "chunk_id", posted: DataFrame | None = None, stats: DataFrame | None = None) -> DataFrame:
    """``query_id, chunk_id, score``. Document frequencies and lengths are of all documents, whatever ``categories`` lets through."""
    fields = list(weights)
    terms = query_terms(queries)
    if posted is None:
        posted, own = query_postings(docs, fields, terms, id_col)
        stats = stats if stats is not None else own
    posted, small = _only(posted, terms)
    stats = stats if stats is not None else field_stats(docs, fields)
    table = stats.select("field", "n_docs", "avg_len")
    weight, slope = F.create_map(*[F.lit(x) for p in weights.items() for x in p]), F.create_map(*[F.lit(x) for f in fields for x in (f, float(b.get(f, 0.75)))])
    norm = 1.0 - slope[F.col("field")] + slope[F.col("field")] * F.col("len") / F.col("avg_len")
    # one row a field, so the table of statistics is always broadcast
    wtf = posted.join(F.broadcast(table), "field").groupBy("token", "chunk_id").agg(F.sum(weight[F.col("field")] * F.col("tf") / F.greatest(norm, F.lit(1e-9))).alias("wtf"), F.max("n_docs").alias("n"))
    df = wtf.groupBy("token").agg(F.count("*").alias("df"))
    scored = wtf.join(small(df), "token").join(terms, "token")
    idf = F.log(1.0 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    if categories:
        scored = scored.join(docs.filter(F.col("category").isin(list(categories))).select(F.col(id_col).alias("chunk_id")), "chunk_id", "left_semi")
    return scored.groupBy("query_id", "chunk_id").agg(F.sum(F.col("qtf") * idf * (k1 + 1.0) * F.col("wtf") / (k1 + F.col("wtf"))).alias("score"))


def fts_bm25(docs: DataFrame, queries: DataFrame, text_col: str = "text", k1: float = 1.2, b: float = 0.75, most_terms: int = 48, wide: bool = False, id_col: str = "chunk_id", categories: Sequence[str] | None = None, found: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """``query_id, chunk_id, score`` of a full-text search: one field, inverse frequency never below 1e-6; frequencies are of all documents, whatever ``categories`` lets through.

    ``found``: the field's postings and statistics, as ``query_postings`` gives them, if they are there already.
    """
    terms = query_terms(queries, wide, most_terms)
    posted, stats = found or query_postings(docs, [text_col], terms, id_col, wide)
    return _full_text(docs, posted, stats, terms, k1, b, id_col, categories)


def fts_phrases(docs: DataFrame, queries: DataFrame, text_col: str = "text", k1: float = 1.2, b: float = 0.75, most_terms: int = 48, wide: bool = False, id_col: str = "chunk_id", categories: Sequence[str] | None = None) -> DataFrame:
    """``fts_bm25`` as an index has it that splits the tokens again: at all but letters and digits, so ``3.14`` is ``3`` and ``14``.

    A query's token of several parts is a phrase, found where its parts follow each other, across tokens too; tokens with
    the same parts count each. Texts without parts are not in the index and count nowhere. Only phrases of the lengths
    that the queries have are made, and only the queries' own are shuffled.
    """
    phrase = F.array_join(matches("token", fixed.INDEX_PART), " ")
    terms = query_terms(queries, wide, most_terms).select("query_id", phrase.alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("qtf"))
    # as many rows as there are lengths of single tokens
    lengths = sorted(r[0] for r in terms.select(F.size(F.split("token", " "))).distinct().collect()) or [1]
    sized = docs.select(F.size(text_parts(text_col, wide)).alias("len")).filter("len > 0")
    stats = sized.agg(F.count("*").alias("n_docs"), (F.sum("len") / F.count("*")).alias("avg_len"))
    return _full_text(docs, phrase_postings(docs, lengths, text_col, id_col, wide), stats, terms, k1, b, id_col, categories)


def _full_text(docs: DataFrame, posted: DataFrame, stats: DataFrame, terms: DataFrame, k1: float, b: float, id_col: str, categories: Sequence[str] | None) -> DataFrame:
    posted, small = _only(posted, terms)
    df = posted.groupBy("token").agg(F.count("*").alias("df"))
    scored = posted.join(small(df), "token").join(terms, "token").join(F.broadcast(stats.select("n_docs", "avg_len")))
    if categories:
        scored = scored.join(docs.filter(F.col("category").isin(list(categories))).select(F.col(id_col).alias("chunk_id")), "chunk_id", "left_semi")
    idf = F.greatest(F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    return scored.groupBy("query_id", "chunk_id").agg(F.sum(F.col("qtf") * idf * F.col("tf") * (k1 + 1.0) / (F.col("tf") + k1 * (1.0 - b + b * F.col("len") / F.col("avg_len")))).alias("score"))


def boosted_bm25(docs: DataFrame, queries: DataFrame, boosts: Mapping[str, float] | None = None, **how) -> DataFrame:
    """The sum of each field's own BM25, boosted."""
    # Boosts of a title, of its tokens and of the body.
    boosts = boosts or {"title": 2.6, "tokens": 2.0, "body": 0.6}
    parts = [fts_bm25(docs, queries, f, **how).withColumn("score", F.col("score") * w) for f, w in boosts.items()]
    return reduce(DataFrame.unionByName, parts).groupBy("query_id", "chunk_id").agg(F.sum("score").alias("score"))


def deduplicated(scored: DataFrame, docs: DataFrame, k: int, key: Column | None = None, id_col: str = "chunk_id") -> DataFrame:
    """The first ``k`` hits of each query, one of each key (default: url and beginning of the text)."""
    key = key if key is not None else F.xxhash64("url", F.substring("text", 1, 500))
    keyed = scored.join(docs.select(F.col(id_col).alias("chunk_id"), key.alias("_key")), "chunk_id")
    return top_k(top_k(keyed, 1, ("query_id", "_key"), rank="_first").drop("_first", "_key"), k)


# vectors


def unit(c) -> Column:
    """A vector over its length; a zero vector as it is."""
    c = col(c)
    length = F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(c, lambda x: x.cast("double") / F.when(length == 0, 1.0).otherwise(length))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dense_topk(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", query_vector_col: str = "embedding", half: bool = False, block: int = MOST_VECTORS) -> DataFrame:
    """``query_id, chunk_id, score, rank``: exact cosine top-k of every query.

    Queries are broadcast in blocks; each task multiplies its batches with a block and keeps ``k`` hits a query, so what
    is shuffled depends on tasks, queries and ``k`` alone. ``half``: vectors rounded to half precision, as a stored index has them.
    """
    spark = vectors.sparkSession
    kinds = (queries.schema["query_id"].dataType.simpleString(), vectors.schema[id_col].dataType.simpleString())
    narrow = vectors.select(F.col(id_col).alias("chunk_id"), F.col(vector_col).alias("v")).filter("v IS NOT NULL")
    total = queries.count()
    out: DataFrame | None = None
    count = max(1, -(-total // block))
    for n in range(count):
        part = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(count)) == n) if count > 1 else queries
        rows = part.select("query_id", F.col(query_vector_col).alias("v")).collect()  # at most about ``block`` query vectors
        if not rows:
            continue
        q = np.array([r["v"] for r in rows], np.float64)
        q /= np.where((s := np.linalg.norm(q, axis=1, keepdims=True)) == 0, 1, s)
        known = spark.sparkContext.broadcast(([r["query_id"] for r in rows], q))

        def search(batches: Iterator[pd.DataFrame], known=known) -> Iterator[pd.DataFrame]:
            names, q = known.value
            best: list[pd.DataFrame] = []
            for pdf in batches:
                if not len(pdf):
                    continue
                m = np.array(pdf["v"].tolist(), np.float64)
                m /= np.where((s := np.linalg.norm(m, axis=1, keepdims=True)) == 0, 1, s)
                if half:
                    m = m.astype(np.float16).astype(np.float64)
                scores, keys = q @ m.T, pdf["chunk_id"].to_numpy()
                for i, name in enumerate(names):
                    near = np.lexsort((keys, -scores[i]))[:k] if len(keys) > k else np.arange(len(keys))
                    best.append(pd.DataFrame({"query_id": name, "chunk_id": keys[near], "score": scores[i][near]}))
                if len(best) > 4 * len(names):
                    best = [_best(pd.concat(best), k)]
            if best:
                yield _best(pd.concat(best), k)

        found = narrow.mapInPandas(search, f"query_id {kinds[0]}, chunk_id {kinds[1]}, score double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], f"query_id {kinds[0]}, chunk_id {kinds[1]}, score double, rank int")
    return top_k(out, k)


def _best(rows: pd.DataFrame, k: int) -> pd.DataFrame:
    return rows.sort_values(["query_id", "score", "chunk_id"], ascending=[True, False, True]).groupby("query_id", sort=False).head(k)


# ranked lists


def merge_max(*lists: DataFrame) -> DataFrame:
    """Union of candidate lists with the largest score of each chunk."""
    return reduce(DataFrame.unionByName, [x.select("query_id", "chunk_id", "score") for x in lists]).groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))


def rrf(ranked: DataFrame, weights: Mapping[str, float] = fixed.RRF_WEIGHTS, k: int = 60) -> DataFrame:
    """``query_id, chunk_id, score, best``: reciprocal rank fusion of ``query_id, channel, chunk_id, rank, score``.

    Channels without a weight above 0 are left out; ``best``, the largest raw score, breaks ties.
    """
    table = F.create_map(*[F.lit(x) for p in weights.items() for x in (p[0], float(p[1]))]) if weights else F.create_map(F.lit(""), F.lit(0.0))
    weight = F.coalesce(table[F.col("channel")], F.lit(0.0))
    return ranked.withColumn("w", weight).filter("w > 0").groupBy("query_id", "chunk_id").agg(F.sum(F.col("w") / (F.lit(k) + F.col("rank"))).alias("score"), F.max("score").alias("best"))


def pinned_merge(original: DataFrame, planned: DataFrame, k: int, pinned: int = 2) -> DataFrame:
    """The first ``pinned`` hits of ``original``, then all others of both lists by score; each chunk once."""
    first = original.filter(F.col("rank") <= pinned).select("query_id", "chunk_id", F.lit(0).alias("part"), (-F.col("rank")).cast("double").alias("s"), "score")
    rest = original.select("query_id", "chunk_id", "score").unionByName(planned.select("query_id", "chunk_id", "score")).select("query_id", "chunk_id", F.lit(1).alias("part"), F.col("score").alias("s"), "score")
    best = first.unionByName(rest).groupBy("query_id", "chunk_id").agg(F.min_by(F.struct("part", "s"), F.struct("part", -F.col("s"))).alias("p"), F.max("score").alias("score"))
    return top_k(best, k, order=[F.col("p.part"), F.desc("p.s"), F.col("chunk_id")]).select("query_id", "chunk_id", "score", "rank")


def promote(ranked: DataFrame, precise: DataFrame, k: int, least: float = 300.0, most: int = 3) -> DataFrame:
    """Hits of ``precise`` that score ``least`` or more go first (``most`` of them), the ranked list after them."""
    lead = top_k(precise.filter(F.col("score") >= least), most, order=[F.desc("score"), F.desc("raw"), F.col("chunk_id")]).select("query_id", "chunk_id", F.lit(0).alias("part"), "rank")
    both = lead.unionByName(ranked.select("query_id", "chunk_id", F.lit(1).alias("part"), "rank"))
    first = both.groupBy("query_id", "chunk_id").agg(F.min(F.struct("part", "rank")).alias("p"))
    return top_k(first, k, order=[F.col("p.part"), F.col("p.rank"), F.col("chunk_id")]).select("query_id", "chunk_id", "rank")


def neighbours(hits: DataFrame, chunks: DataFrame, window: int = 1, limit: int = 48, drop: float = 0.05) -> DataFrame:
    """``query_id, chunk_id, score``: chunks up to ``window`` places from a hit in its document, that aren't hits; ``hits`` has ``query_id, chunk_id, score``, ``chunks`` has ``chunk_id, doc_id, chunk_index``.

    An equi-join on (document, place), since every place is named by its offset.
    """
    placed = hits.join(chunks.select("chunk_id", "doc_id", "chunk_index"), "chunk_id")
    offsets = F.explode(F.array(*[F.lit(i) for i in range(-window, window + 1) if i]))
    wanted = placed.withColumn("d", offsets).withColumn("chunk_index", (F.col("chunk_index") + F.col("d")).cast(chunks.schema["chunk_index"].dataType)).filter("chunk_index >= 0")
    wanted = wanted.groupBy("query_id", "doc_id", "chunk_index").agg(F.max(F.col("score") - drop).alias("score"))
    found = wanted.join(chunks.select("chunk_id", "doc_id", "chunk_index"), ["doc_id", "chunk_index"]).join(hits.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    return top_k(found, limit, order=[F.desc("score"), F.col("doc_id"), F.col("chunk_index"), F.col("chunk_id")]).select("query_id", "chunk_id", "score")


def multi_get(rows: DataFrame, wanted: DataFrame, id_col: str, most: int = 100_000) -> DataFrame:
    """Rows whose id is wanted; the ids are broadcast if they are few."""
    keys = wanted.select(id_col).distinct()
    return rows.join(F.broadcast(keys) if keys.limit(most + 1).count() <= most else keys, id_col, "left_semi")


def apply_ranking(candidates: DataFrame, order: DataFrame, k: int) -> DataFrame:
    """Candidates (``query_id, chunk_id, rank``) in a given order (``query_id, indices``: 1-based places, invalid and repeated ones dropped), then those it leaves out."""
    named = order.select("query_id", F.posexplode("indices").alias("at", "rank")).groupBy("query_id", "rank").agg(F.min("at").alias("at"))
    both = candidates.join(named.withColumn("rank", F.col("rank").cast(candidates.schema["rank"].dataType)), ["query_id", "rank"], "left").withColumn("old", F.col("rank"))
    return top_k(both, k, order=[F.col("at").isNull(), F.col("at"), F.col("old"), F.col("chunk_id")], rank="new").select("query_id", "chunk_id", F.col("new").alias("rank"))


def lcg_sample(rows: DataFrame, k: int, group: str, id_col: str = "id") -> DataFrame:
    """``k`` rows of each group in the order of a linear congruence of their ids."""
    # The congruence's constants.
    order = (F.col(id_col) * F.lit(1103515245) + F.lit(12345)).bitwiseAND(F.lit(2147483647))
    return top_k(rows, k, (group,), [order, F.col(id_col)], rank="sample_rank")
