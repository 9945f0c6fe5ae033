"""Searching: lexical, structured and dense channels fused, neighbours added, results made diverse."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import query_tokens, snippet, strip
from ..operators import assist, dedup, hop, rank
from ..operators import routes as rules
from ..sources.stored import build_once, scratch


@dataclass(frozen=True)
class SearchConfig:
    top_k: int = 8
    lexical: int = 240
    structured: int = 160
    dense: int = 160
    neighbour_window: int = 1
    neighbour_limit: int = 48
    context_chars: int = 7200
    rrf_k: int = 60
    weights: Mapping[str, float] = field(default_factory=lambda: dict(fixed.RRF_WEIGHTS))
    routes: Sequence[rules.Route] = ()
    features: Sequence[rules.Feature] = ()
    intents: Sequence[rules.Intent] = rules.INTENTS
    expansions: Mapping[str, Sequence[str]] = field(default_factory=lambda: dict(fixed.EXPANSIONS))


class KeywordIndex:
    """BM25F over the columns of ``weights``: postings and statistics are written once and reused by every search.

    With ``path`` they stay there, with their metadata (``meta`` and what the index is made of) as the mark of a finished
    build; they are made again where that mark is missing or differs, or on ``rebuild``. ``limit``: only the chunks of
    the least ids, for a trial.
    """

    def __init__(self, docs: DataFrame, id_col: str = "chunk_id", weights: Mapping[str, float] = fixed.BM25F_WEIGHTS, b: Mapping[str, float] = fixed.BM25F_B, k1: float = 1.5, path: str | None = None, meta: Mapping | None = None, limit: int | None = None, rebuild: bool = False):
        docs = docs if limit is None else docs.orderBy(id_col).limit(limit)
        self.docs, self.id_col, self.weights, self.b, self.k1 = docs, id_col, weights, b, k1
        tables = {"postings": rank.postings(docs, list(weights), id_col), "field-stats": rank.field_stats(docs, list(weights))}
        if path is None:
            self.built = True
            self.posted, self.stats = (scratch(t, name) for name, t in tables.items())
        else:
            self.built = build_once(tables, path, {**(meta or {}), "id": id_col, "fields": list(weights), "limit": limit}, rebuild)
            self.posted, self.stats = (docs.sparkSession.read.parquet(f"{path}/{name}") for name in tables)

    def search(self, queries: DataFrame, top_k: int = 5, categories: Sequence[str] | None = None, deduplicate: bool = True, expand: bool = False, expansions=fixed.EXPANSIONS) -> DataFrame:
        """``query_id, chunk_id, score, rank, snippet``."""
        from ..functions.text import expand as expanded

        asked = queries.withColumn("query", expanded("query", expansions)) if expand else queries
        scored = rank.bm25f(self.docs, asked, self.weights, self.b, self.k1, categories, self.id_col, self.posted, self.stats)
        hits = rank.deduplicated(scored, self.docs, top_k, None, self.id_col) if deduplicate else rank.top_k(scored, top_k)
        texts = self.docs.select(F.col(self.id_col).alias("chunk_id"), "text")
        return hits.join(texts, "chunk_id").join(queries, "query_id").select("query_id", "chunk_id", "score", "rank", snippet("text", query_tokens("query")).alias("snippet"))


class HybridIndex:
    """Chunks (``chunk_id, doc_id, chunk_index, title, text, category, url, path, source_type, date, quality``) and maybe their vectors."""

    def __init__(self, chunks: DataFrame, vectors: DataFrame | None = None, config: SearchConfig = SearchConfig()):
        self.chunks, self.vectors, self.config = chunks, vectors, config

    def structured(self, parsed: DataFrame) -> DataFrame:
        c = self.config
        lists = [rules.exact_candidates(self.chunks, parsed, max(8 * c.top_k, 40))]
        if c.routes:
            lists.append(rules.routed_candidates(self.chunks, parsed, c.routes, max(12 * c.top_k, 80)))
        return rank.merge_max(*lists)

    def candidates(self, queries: DataFrame, query_vectors: DataFrame | None = None) -> DataFrame:
        """``query_id, channel, chunk_id, rank, score`` of each channel."""
        c = self.config
        parsed = rules.parsed(queries, c.intents, c.expansions)
        lexical = rules.rule_rerank(rank.top_k(rank.fts_bm25(self.chunks, queries), c.lexical), self.chunks, parsed, c.features)
        structured = rules.rule_rerank(self.structured(parsed), self.chunks, parsed, c.features)
        channels = [("lexical", rank.top_k(lexical, c.lexical)), ("structured", rank.top_k(structured, c.structured))]
        if self.vectors is not None and query_vectors is not None:
            channels.append(("dense", rank.dense_topk(self.vectors, query_vectors, c.dense, "chunk_id")))
        out = None
        for name, hits in channels:
            rows = hits.select("query_id", F.lit(name).alias("channel"), "chunk_id", "rank", "score")
            out = rows if out is None else out.unionByName(rows)
        return out

    def search(self, queries: DataFrame, query_vectors: DataFrame | None = None, rerank: Callable[[list[str]], list[str]] | None = None) -> DataFrame:
        """``query_id, chunk_id, rank`` and the chunks' columns: fused, neighbours added, diverse; ``rerank`` is a model that orders what is left."""
        c = self.config
        fused = rank.rrf(self.candidates(queries, query_vectors), c.weights, c.rrf_k)
        base = scratch(rank.top_k(fused, max(c.lexical, c.structured), order=[F.desc("score"), F.desc("best"), F.col("chunk_id")]), "fused")
        seeds = base.filter(F.col("rank") <= max(8, 3 * c.top_k)).select("query_id", "chunk_id", "score")
        near = rank.top_k(rank.neighbours(seeds, self.chunks, c.neighbour_window, c.neighbour_limit), c.neighbour_limit)
        both = base.select("query_id", F.lit("base").alias("channel"), "chunk_id", "rank", "score").unionByName(near.select("query_id", F.lit("near").alias("channel"), "chunk_id", "rank", "score"))
        merged = rank.rrf(both, {"base": 1.0, "near": 0.85}, c.rrf_k).select("query_id", "chunk_id", "score")
        parsed = rules.parsed(queries, c.intents, c.expansions).select("query_id", "codes", F.col("names").alias("phrases"))
        hits = merged.join(self.chunks, "chunk_id").join(parsed, "query_id")
        picked = dedup.greedy_diverse(hits, c.top_k, "codes", "phrases")
        if rerank is None:
            return picked
        asked = assist.contexts(picked.withColumnRenamed("source_type", "type"), c.context_chars).join(queries, "query_id").withColumn("prompt", F.concat_ws("\n\n", "query", "context"))
        sizes = picked.groupBy("query_id").agg(F.count("*").alias("n"))
        order = assist.replies(asked.select("query_id", "prompt"), rerank).join(sizes, "query_id").select("query_id", assist.parse_ranking("reply", "n").alias("indices"))
        ranked = rank.apply_ranking(picked.select("query_id", "chunk_id", F.col("rank").cast("int").alias("rank")), order, c.top_k)
        return picked.drop("rank").join(ranked, ["query_id", "chunk_id"])

    def planned_search(self, queries: DataFrame, pool: int | None = None) -> DataFrame:
        """``query_id, chunk_id, rank``: up to ``pool`` hits of ``query_id, query, planned``, where ``planned`` is a query that was made of the asked one.

        Where the two differ (case and outer white space aside), both are searched, twice as deep, and merged: the asked
        query's first hits stay first. An empty or null one counts as the other; where both are, nothing is found.
        """
        k = pool or self.config.top_k
        plain = lambda c: strip(F.coalesce(F.col(c), F.lit("")))
        both = queries.select("query_id", plain("query").alias("query"), plain("planned").alias("planned"))
        both = both.withColumn("planned", F.when(F.col("planned") == "", F.col("query")).otherwise(F.col("planned"))).filter("planned <> ''")
        two = (F.col("query") != "") & (F.lower("query") != F.lower("planned"))
        deep, flat = (HybridIndex(self.chunks, self.vectors, replace(self.config, top_k=n)) for n in (max(2 * k, 12), k))
        asked, planned = (deep.search(both.filter(two).select("query_id", F.col(c).alias("query"))) for c in ("query", "planned"))
        single = flat.search(both.filter(~two).select("query_id", F.col("planned").alias("query")))
        return rank.pinned_merge(asked, planned, k).select("query_id", "chunk_id", "rank").unionByName(single.select("query_id", "chunk_id", "rank"))

    def with_profiles(self, queries: DataFrame, hits: DataFrame, record_names: DataFrame) -> DataFrame:
        """Hits of each query with the pages of the persons its records name (``record_names``: ``query_id, names``)."""
        people = hop.hop(record_names, self.chunks.withColumn("score", F.coalesce("quality", F.lit(0.0))), self.config.top_k)
        records = hits.filter(F.col("rank") <= 2)
        return hop.hop_merge(hits, records, people, self.config.top_k)

    def contexts(self, hits: DataFrame) -> DataFrame:
        return assist.contexts(hits.withColumnRenamed("source_type", "type"), self.config.context_chars)


def rollout(index: HybridIndex, query: str, decide: Callable[[str], str], steps: int = 5, per_step: int = 5) -> dict:
    """Search, show a model the evidence, search again as it says: until it answers, repeats a query, finds nothing new, fails, or ``steps`` is reached."""
    spark = index.chunks.sparkSession
    asked, seen, evidence, note = query, set(), [], ""
    tried: set[str] = set()
    for step in range(steps):
        if asked.lower() in tried:
            note = "repeated query"
            break
        tried.add(asked.lower())
        rows = index.search(spark.createDataFrame([(0, asked)], "query_id long, query string")).orderBy("rank").limit(per_step).collect()
        new = [r.asDict() for r in rows if r["chunk_id"] not in seen]
        if step and not new:
            note = "no new hits"
            break
        seen |= {r["chunk_id"] for r in new}
        evidence += new
        try:
            decision = assist.decision_of(decide(f"{query}\n\n{assist.evidence_of(evidence)}"))
        except Exception as problem:  # the model's failure ends the search, not the answer
            note = f"{type(problem).__name__}: {problem}"
            break
        if decision["action"] == "answer":
            note = decision["note"]
            break
        asked = assist.search_query(query, decision["keywords"], decision["query"])
    return {"evidence": evidence, "queries": sorted(tried), "note": note}
