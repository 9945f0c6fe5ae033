"""From raw documents to packed training sequences: each stage calls one operator of ``tessella.llm`` on all that its predecessor kept.

In every stage empty tables give empty ones, texts of any length count whole, repeated rows are rows of their own unless
said otherwise, and columns beyond ``doc_id`` and ``text`` stay as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import ngram_join, quality_cnn
from tessella.llm.common import crc_mod, table, written
from tessella.llm.decontaminate import decontaminate
from tessella.llm.line_dedup import line_dedup
from tessella.llm.packing import pack
from tessella.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject. It learns from the labels of the pipeline's own documents.

    Null texts are judged like empty ones, null ids like others; without labels of both classes nothing can be told and every document stays.
    """
    net = quality_cnn.fit(docs, table(spark, sf_dir, "labels"), ~crc_mod("doc_id", 5).eqNullSafe(F.lit(0)))
    return docs if net.prior is not None else quality_cnn.keep_good(docs, net, threshold=0.3)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten documents or more share, but for each line's first occurrence.

    A document that had words and loses all its lines goes: every line of it stays elsewhere. A null text becomes an empty
    one and stays. The first occurrence is that of the least id; rows without an id only follow others, and where rows repeat
    the first one's id, each of them keeps the line.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    done = line_dedup(docs, min_docs=10, keep="first", carry=others)
    left = done.filter((F.col("n_dropped") == 0) | F.col("kept_text").rlike(r"[^\x20\x09-\x0D]"))
    columns = {"doc_id": F.col("doc_id"), "text": F.col("kept_text")} | {c: F.col("carried")[c] for c in others}
    if "n_chars" in columns:
        columns["n_chars"] = F.length("kept_text").cast(docs.schema["n_chars"].dataType)
    return left.select(*[columns[c].alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar ones (five-word shingles, similarity 0.8): that of the least id.

    Rows without words, or without an id, stay; of rows that repeat an id, one of each class stays.
    """
    return ngram_join.one_of_each(docs, words=5, percent=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of the benchmark; null and empty texts and items contain nothing and stay."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), min_match=5, coverage=0.5)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, at least one of each row; a null text is its end mark alone."""
    return pack(docs, tokenizer_path(), end_id=2, max_tokens=4096)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("packing", packing)]

#: No SQL: a trained network decides in the first stage, tokenisation and packing in the last.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's documents are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
