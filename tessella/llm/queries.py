"""The queries of this subpackage: each operator on its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id, quality_cnn
from .common import crc_mod, scratch_path, table
from .decontaminate import contamination
from .line_dedup import line_dedup
from .ngram_join import similar_classes
from .packing import pack
from .quality_rules import quality_rules
from .token_counts import token_counts
from .url_filter import url_verdicts
from .warc import read_archive, write_archive

#: The url rules of op8.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod("doc_id", 4).eqNullSafe(F.lit(2))
    model = language_id.fit(language_id.labelled_sample(docs, ~held_out, "doc_id", "text", "lang", docs_per_lang=40, doc_chars=4000))
    return language_id.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), min_match=5, coverage=0.5)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1).drop("kept_text")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_classes(table(spark, sf_dir, "documents"), words=4, percent=85, best_rounds=1)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), crc_mod("doc_id", 5).eqNullSafe(F.lit(0))
    net = quality_cnn.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    return quality_cnn.classify(docs, net, threshold=0.3).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2, max_tokens=4096)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages"), URL_RULES)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    path = scratch_path(spark, "warc")
    write_archive(pages, path)
    kind = pages.schema["page_id"].dataType
    return read_archive(spark, path).select(
        F.col("page_id").cast(kind).alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"),
        "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
    )


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path())


QUERIES = {
    f.__name__: f
    for f in (op1_language_id, op2_decontaminate, op3_line_dedup, op4_ngram_join, op5_quality, op6_quality_rules, op7_pack, op8_url_filter, op9_warc, op10_token_counts)
}
