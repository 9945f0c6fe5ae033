"""The driver's queries over the reference's operators, each with the SQL that checks it in ``oracle``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chunk, extract, quality
from ..functions import text as txt
from ..operators import assist, clean, dedup, evaluate, graph, hop, rank, routes
from ..sources.stored import scratch
from ..streaming import events as ev
from . import whole


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def asked(spark: SparkSession) -> DataFrame:
    """The fixed query set."""
    # Questions about the driver's documents.
    rows = [(1, "the nation of the"), (2, "that with heat tion"), (3, "was entan ere"), (4, "de la que los"), (5, "und der die")]
    return spark.createDataFrame(rows, "query_id long, query string")


def documents(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "chunk_id")


def tok_ascii_tf(spark, sf_dir):
    return rank.postings(documents(spark, sf_dir), ["text"]).groupBy("token").agg(F.sum("tf").alias("tf"), F.count("*").alias("docs"))


def tok_cjk_inline(spark, sf_dir):
    # Short mixed texts.
    rows = [(1, "课程 CS101 的介绍"), (2, "研究方向是机器学习与数据挖掘技术"), (3, "c++ 3.14 老师"), (4, "")]
    df = spark.createDataFrame(rows, "id long, t string")
    return df.select("id", F.posexplode(txt.tokens("t")).alias("pos", "token")).select("id", F.col("pos").cast("long").alias("pos"), "token")


def doc_freq(spark, sf_dir):
    return rank.row_document_frequency(documents(spark, sf_dir), ["text", "source"])


def avg_field_len(spark, sf_dir):
    stats = rank.field_stats(documents(spark, sf_dir), ["text", "source", "lang"])
    return stats.select("field", "n_docs", F.round("avg_len", 6).alias("avg_len"))


def bm25f_topk(spark, sf_dir):
    scored = rank.bm25f(documents(spark, sf_dir), asked(spark), {"text": 1.0}, {"text": 0.75})
    return rank.top_k(scored.withColumn("score", F.round("score", 6)), 10).select("query_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


def bm25f_multifield(spark, sf_dir):
    docs = documents(spark, sf_dir)
    queries = spark.createDataFrame([(1, "en the src4"), (2, "fr la src7")], "query_id long, query string")
    scored = rank.bm25f(docs, queries, {"text": 1.0, "source": 3.0, "lang": 0.8}, {"text": 0.75, "source": 0.2, "lang": 0.0})
    return rank.top_k(scored.withColumn("score", F.round("score", 6)), 20).select("query_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


def fts_bm25_topk(spark, sf_dir):
    scored = rank.fts_bm25(documents(spark, sf_dir), asked(spark))
    return rank.top_k(scored.withColumn("score", F.round("score", 6)), 10).select("query_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


def _vectors(spark, sf_dir, k):
    v = table(spark, sf_dir, "embeddings")
    queries = v.filter(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    return rank.dense_topk(v, queries, k)


def dense_topk(spark, sf_dir):
    return _vectors(spark, sf_dir, 10).select("query_id", "chunk_id", F.round("score", 5).alias("score"))


def vector_norms(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return v.select("vec_id", F.round(rank.dot(rank.unit("embedding"), rank.unit("embedding")), 5).alias("norm"), F.round(rank.dot("embedding", "embedding"), 3).alias("square"))


def rrf_fusion(spark, sf_dir):
    docs = documents(spark, sf_dir)
    # both channels search one field: its texts are cut into tokens once
    found = rank.query_postings(docs, ["text"], rank.query_terms(asked(spark)))
    lexical = rank.top_k(rank.bm25f(docs, asked(spark), {"text": 1.0}, {"text": 0.75}, posted=found[0], stats=found[1]).withColumn("score", F.round("score", 6)), 50)
    full_text = rank.top_k(rank.fts_bm25(docs, asked(spark), found=found).withColumn("score", F.round("score", 6)), 50)
    both = lexical.select("query_id", F.lit("lexical").alias("channel"), "chunk_id", "rank", "score").unionByName(full_text.select("query_id", F.lit("structured").alias("channel"), "chunk_id", "rank", "score"))
    fused = rank.rrf(both).withColumn("score", F.round("score", 9))
    return rank.top_k(fused, 20, order=[F.desc("score"), F.desc("best"), F.col("chunk_id")]).select("query_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


def line_df_blacklist(spark, sf_dir):
    return clean.line_blacklist(table(spark, sf_dir, "documents"), static=False, compatible=False)


def line_repeat_cap(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = clean.exploded_lines(docs, "doc_id", F.split("text", "\n", -1)).filter("line <> ''")
    return clean.repeat_cap(rows, "doc_id").groupBy("doc_id").agg(F.count("*").alias("kept"), F.sum(F.length("line")).alias("chars"))


def chunk_windows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    flat = F.trim(F.regexp_replace("text", r"[ \t\n\r]+", " "))
    rows = docs.select("doc_id", F.posexplode(chunk.windows(flat)).alias("chunk_index", "chunk"))
    return rows.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "chunk")


def chunk_lines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.posexplode(chunk.chunk_lines("text")).alias("chunk_index", "chunk"))
    return rows.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "chunk")


def exact_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("hash", dedup.content_hash("text", compatible=False))
    return dedup.first_wins(docs.select("doc_id", "hash"), ["hash"], ["doc_id"])


def neighbor_expand(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    chunks = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("chunk_id"), F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk_index"))
    hits = chunks.filter("chunk_index = 1").select((F.col("doc_id") % 5).alias("query_id"), "chunk_id", F.lit(1.0).alias("score"))
    return rank.neighbours(hits, chunks, limit=1 << 30).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


def candidate_merge(spark, sf_dir):
    docs = documents(spark, sf_dir)
    lists = [docs.filter(F.col("source") == s).select(F.lit(1).cast("long").alias("query_id"), "chunk_id", (F.col("n_chars") * w).cast("double").alias("score")) for s, w in (("src1", 1.0), ("src2", 1.0))]
    lists.append(docs.filter(F.col("lang") == "en").select(F.lit(1).cast("long").alias("query_id"), "chunk_id", F.lit(700.0).alias("score")))
    return rank.merge_max(*lists)


def anti_new_hits(spark, sf_dir):
    docs = documents(spark, sf_dir)
    hits = docs.filter("lang = 'fr'").select(F.lit(1).cast("long").alias("query_id"), "chunk_id", F.col("n_chars").cast("double").alias("score"))
    more = docs.filter("source IN ('src1', 'src2', 'src3')").select(F.lit(1).cast("long").alias("query_id"), "chunk_id", F.col("n_chars").cast("double").alias("score"))
    return dedup.append_new(hits, more, 25)


def per_source_cap(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return dedup.cap_per(docs, ["source"], 2, [F.desc("n_chars"), F.col("doc_id")])


def greedy_dedup(spark, sf_dir):
    docs = documents(spark, sf_dir)
    # read for the keys and for the hits taken; of a text the keys need its first 700 solid characters, so no more is joined
    scored = scratch(rank.bm25f(docs, asked(spark), {"text": 1.0}, {"text": 0.75}).withColumn("score", F.round("score", 6)), "scored")
    hits = scored.join(docs.select("chunk_id", F.lit(0).alias("chunk_index"), F.substring("text", 1, 20).alias("title"), F.lit("").alias("url"), F.concat(F.lit("docs/"), "source").alias("path"), dedup.solid("text", 700).alias("text")), "chunk_id")
    return dedup.greedy_diverse(hits, 8, pool=60).select("query_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


def lcg_sample(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return rank.lcg_sample(docs, 3, "source", "doc_id").select("doc_id", "source", F.col("sample_rank").cast("long").alias("sample_rank"))


def group_report(spark, sf_dir):
    return evaluate.group_report(table(spark, sf_dir, "documents").withColumn("chars", F.col("n_chars").cast("double")), "lang", "chars")


def top_hosts(spark, sf_dir):
    return evaluate.top_values(table(spark, sf_dir, "pages").select(extract.host("url").alias("host")), "host", 30)


def garbled_filter(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", quality.garbled("text").alias("garbled"), quality.garbled_head("text").alias("garbled_head"))


def quality_score(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumns({"host": F.lit("www.example.org"), "path": F.concat(F.lit("docs/"), "source"), "source_type": F.when(F.col("lang") == "de", "pdf_md").otherwise("web"), "category": F.when(F.col("lang") == "en", "faculty").otherwise("web")})
    domain = quality.Domain(host_suffixes=("example.org",))
    return docs.select("doc_id", F.round(quality.adjusted_quality(F.lit(0.7), "text", "source_type", "category", "host", "path", domain), 4).alias("quality"))


def skip_reason(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumns({"source_type": F.col("lang"), "path": F.lit("a"), "url": F.lit("")})
    counted = docs.withColumn("skip_reason", clean.filter_reason(F.col("text"), "path", "url", "source_type", F.lit(0.5)))
    return clean.skip_counts(counted)


def html_to_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", extract.page_text("html").alias("text"))


def link_extract(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(extract.hrefs("html")).alias("link")).groupBy("page_id", "link").agg(F.count("*").alias("n"))


def url_normalize(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", extract.host("url").alias("host"), extract.url_path("url").alias("path"), extract.normal_url("url").alias("normal"), extract.is_static("url").alias("static"), extract.is_web_page("url").alias("web_page"))


def link_bfs(spark, sf_dir):
    links = table(spark, sf_dir, "pages").select(extract.host("url").alias("src"), F.explode(extract.hrefs("html")).alias("dst"))
    # hosts are neighbours if they have a link in common
    edges = links.union(links.select("dst", "src")).distinct()
    seeds = links.agg(F.min("src").alias("node"))
    return graph.bfs(edges, seeds, 3).select("node", F.col("depth").cast("long").alias("depth"))


def email_extract(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(txt.matches("text", r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_.-]+\.[A-Za-z]{2,}")).alias("email")).distinct()


def accuracy_report(spark, sf_dir):
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    out = evaluate.accuracy(joined.withColumn("ok", F.col("quality") == 1), "ok", ["lang"])
    return out.select("lang", "correct", "total", F.round("accuracy", 6).alias("accuracy"))


def left_lookup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", "lang", F.coalesce("quality", F.lit(-1)).alias("quality"))


def semi_multiget(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    wanted = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id")
    return rank.multi_get(docs.select("doc_id", "source", "n_chars"), wanted, "doc_id")


def contained_terms(spark, sf_dir):
    """How many distinct words of each benchmark item stand in each document, for those with nearly all."""
    words = lambda c: F.array_distinct(txt.matches(F.lower(c), "[a-z]+"))
    items = table(spark, sf_dir, "benchmark").select("item_id", words("text").alias("ws"))
    sized = items.select("item_id", F.size("ws").alias("size"), F.explode("ws").alias("word"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(words("text")).alias("word"))
    # words of the benchmark only, summed in each task before they are shuffled
    hit = docs.join(sized, "word").groupBy("doc_id", "item_id", "size").agg(F.count("*").alias("shared"))
    return hit.filter(F.col("shared") * 10 >= F.col("size") * 9).select("doc_id", "item_id", "shared")


def reply_parsers(spark, sf_dir):
    # Replies of several shapes.
    rows = [(1, '```json\n{"keywords": ["CS101", "instructor"]}\n```'), (2, '[3, 1, 9]'), (3, '{"ranking": [{"index": 2}, "1"]}'), (4, '{"keywords": ["a b", "c'), (5, "alpha, beta; gamma"), (6, '{"action": "search", "query": "x", "keywords": ["k"]}')]
    df = spark.createDataFrame(rows, "id long, reply string")
    d = assist.parse_decision("reply")
    return df.select("id", F.array_join(assist.parse_keywords("reply"), "|").alias("keywords"), F.array_join(assist.parse_ranking("reply", F.lit(3)), ",").alias("ranking"), d["action"].alias("action"))


def pinned_merge(spark, sf_dir):
    docs = documents(spark, sf_dir)
    first = rank.top_k(docs.filter("lang = 'en'").select(F.lit(1).cast("long").alias("query_id"), "chunk_id", F.col("n_chars").cast("double").alias("score")), 10)
    second = docs.filter("lang = 'de'").select(F.lit(1).cast("long").alias("query_id"), "chunk_id", F.col("n_chars").cast("double").alias("score"))
    return rank.pinned_merge(first, rank.top_k(second, 10), 12).select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"))


def route_candidates(spark, sf_dir):
    docs = documents(spark, sf_dir).select("chunk_id", F.col("source").alias("category"), F.col("lang").alias("source_type"), F.lit("").alias("path"), F.lit("").alias("url"), F.lit("").alias("date"), F.lit("").alias("title"), "text", (F.length("text") % 97 / 100.0).cast("double").alias("quality"))
    queries = routes.parsed(spark.createDataFrame([(1, "which course has credits"), (2, "office of a professor")], "query_id long, query string"))
    rules = (routes.Route("course", categories=("src1", "src2")), routes.Route("faculty", categories=("src3",), source_types=("fr",)))
    return routes.routed_candidates(docs, queries, rules, 15)


def persons_inline(spark, sf_dir):
    # Lines of names.
    rows = [(1, "张三(San Zhang)"), (2, "张三、李四(San Zhang, Si Li)"), (3, "Ada Lovelace, Alan Turing"), (4, "")]
    df = spark.createDataFrame(rows, "id long, names string")
    return df.select("id", F.posexplode(hop.persons("names")).alias("pos", "p")).select("id", F.col("pos").cast("long").alias("pos"), "p.cjk", "p.latin")


def search_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", txt.search_text("source", "lang", "text").alias("search_text"))


def event_windows(spark, sf_dir):
    out = ev.tumbling(table(spark, sf_dir, "events"), "1 day")
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


def event_sessions(spark, sf_dir):
    out = ev.sessions(table(spark, sf_dir, "events"), "6 hours")
    return out.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


def page_titles(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


def running_budget(spark, sf_dir):
    """Ranked hits of each source under a running budget of characters."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return rank.within_budget(docs, "n_chars", 7200, ["source"], ["doc_id"])


QUERIES = {
    f.__name__: f
    for f in (
        tok_ascii_tf, tok_cjk_inline, doc_freq, avg_field_len, bm25f_topk, bm25f_multifield, fts_bm25_topk, dense_topk, vector_norms, rrf_fusion, line_df_blacklist, line_repeat_cap, chunk_windows, chunk_lines, exact_dedup,
        neighbor_expand, candidate_merge, anti_new_hits, per_source_cap, greedy_dedup, lcg_sample, group_report, top_hosts, garbled_filter, quality_score, skip_reason, html_to_text, link_extract, url_normalize, link_bfs,
        email_extract, accuracy_report, left_lookup, semi_multiget, contained_terms, reply_parsers, pinned_merge, route_candidates, persons_inline,
        search_texts, event_windows, event_sessions, page_titles, running_budget,
    )
}
QUERIES |= {name: query for name, (query, _) in whole.WHOLE.items()}
