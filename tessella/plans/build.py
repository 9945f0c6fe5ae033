"""Building a corpus: candidates, cleaning, filters, chunks without duplicates, a full-text table, reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chunk import chunk_lines
from ..functions.extract import date, first_url, host_of
from ..functions.fixed import Domain
from ..functions.quality import path_category, title_of
from ..functions.text import chunk_uid, search_text
from ..operators import clean, dedup, evaluate, rank, structured
from ..sources.stored import scratch


@dataclass
class Corpus:
    """``documents`` and ``chunks`` that were taken, ``skipped`` (source type, reason, count)."""

    documents: DataFrame
    chunks: DataFrame
    skipped: DataFrame


def candidates(texts: DataFrame, dataset: str, domain: Domain = Domain()) -> DataFrame:
    """Text files (``path, text, source_type, base_quality``) with ``doc_key, title, url, host, date, category``."""
    out = texts.withColumn("title", title_of("text", F.regexp_extract("path", r"([^/.]*)[^/]*$", 1))).withColumn("url", first_url("text"))
    out = out.withColumns({"host": host_of("url", "path"), "date": date("text", F.regexp_extract("path", r"([^/]*)$", 1)), "category": path_category("source_type", "path", domain)})
    return out.withColumn("doc_key", F.concat(F.lit(dataset + ":"), "path"))


def build_corpus(docs: DataFrame, domain: Domain = Domain(), least: int = 120, most: int = 950, overlap: int = 120) -> Corpus:
    """Clean, filter, chunk and deduplicate ``docs`` (as ``candidates`` gives them).

    Which document or chunk is first is told by ``(source_order, path)`` and the chunk's place, whatever the partitions.
    """
    black = scratch(clean.line_blacklist(docs, "doc_key"), "blacklist")
    cleaned = clean.with_quality(clean.clean(docs, black, "doc_key"), domain)
    first = dedup.first_wins(cleaned.withColumn("_good", F.col("skip_reason").isNotNull()), ["doc_key"], ["_good", "source_order", "path"]).drop("_good")
    judged = scratch(first, "judged")
    kept = judged.filter("skip_reason IS NULL")
    pieces = kept.select("doc_key", "source_order", "path", "source_type", "title", "url", "host", "date", "category", "quality", F.posexplode(chunk_lines("cleaned", most, overlap, least)).alias("chunk_index", "text"))
    hashed = pieces.withColumn("content_hash", dedup.content_hash("text"))
    chunks = dedup.first_wins(hashed, ["content_hash"], ["source_order", "path", "chunk_index"])
    chunks = chunks.withColumn("chunk_uid", chunk_uid("doc_key", "chunk_index", "content_hash")).withColumn("search_text", search_text("title", "text", "host", "url", "path", "date"))
    chunks = scratch(chunks, "chunks")
    with_chunks = kept.join(chunks.select("doc_key").distinct(), "doc_key", "left_semi")
    empty = kept.join(chunks.select("doc_key").distinct(), "doc_key", "left_anti").groupBy("source_type").agg(F.count("*").alias("n")).select("source_type", F.lit("no_chunks").alias("reason"), "n")
    skipped = clean.skip_counts(judged.filter("skip_reason IS NOT NULL")).unionByName(empty)
    return Corpus(with_chunks, chunks, skipped)


def numbered(rows: DataFrame, order: list[str], name: str = "id") -> DataFrame:
    """Rows with consecutive ids in the given order.

    Ranges are sorted in parallel; each range then adds the count of those before it, a number a partition.
    """
    ranged = scratch(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    before = ranged.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.join(F.broadcast(before.select("_part", "_before")), "_part").withColumn(name, F.col("_before") + within).drop("_part", "_before")


def add_structured(corpus: Corpus, rows: DataFrame, table: str, documents: DataFrame | None = None, base_quality: float | None = None) -> DataFrame:
    """Chunks of a structured table's meaningful rows that the corpus doesn't have yet, with the row as JSON."""
    from ..functions import fixed
    from ..functions.quality import garbled, structured_quality

    base = base_quality if base_quality is not None else fixed.TABLE_QUALITY.get(table, 0.5)
    good = rows.filter(structured.valid_row(rows, table))
    if documents is not None and "source_document_id" in rows.columns:
        good = structured.with_documents(good, documents)
    out = good.select(
        structured.scalar(good, "id").alias("record_id"), F.lit(table).alias("table_name"), structured.row_title(good, table).alias("title"),
        F.coalesce(F.nullif(structured.row_url(good), F.lit("")), F.col("doc_url") if "doc_url" in good.columns else F.lit("")).alias("url"),
        structured.row_markdown(good, table).alias("text"), structured_quality(F.lit(base), structured.confidence(good)).alias("quality"), structured.sorted_json(good).alias("raw_json"),
    )
    out = out.filter((F.length("text") >= 40) & ~garbled("text")).withColumn("content_hash", dedup.content_hash("text"))
    first = dedup.first_wins(out, ["content_hash"], ["record_id"])
    return first.join(corpus.chunks.select("content_hash"), "content_hash", "left_anti")


def reports(corpus: Corpus, hosts: int = 30, sample: int = 3) -> dict[str, DataFrame]:
    """The tables of a build report."""
    keyed = corpus.chunks.withColumn("id", F.conv(F.substring("chunk_uid", 1, 8), 16, 10).cast("long"))
    return {
        "documents": evaluate.group_report(corpus.documents, "source_type", "quality"),
        "chunks": evaluate.group_report(corpus.chunks, "source_type", "quality"),
        "hosts": evaluate.top_values(corpus.chunks, "host", hosts),
        "categories": evaluate.top_values(corpus.chunks, "category", hosts),
        "skipped": corpus.skipped,
        "sample": rank.lcg_sample(keyed, sample, "source_type"),
    }
