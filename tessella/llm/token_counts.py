"""Token counts without token ids (operator 10).

Texts are cut into pre-tokens; each distinct pre-token of the corpus is tokenised once and
its number of pieces joined to the per-document frequencies. The most frequent pre-tokens (at
most ``head_size``, so the broadcast is bounded) are looked up in the scan itself; only what
is left, the rare tail, is shuffled for an exact join. No document's ids are ever built.

Defined cases: null text counts as empty (0 bytes, 0 tokens); any length of text is counted
whole; repeated rows and repeated or null ids each give a row of their own; an empty table
gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import ids, in_batches, pick, texts, written
from .frequent import heaviest
from .pretokens import PreTokenizer

#: Distinct pre-tokens that a task holds before it hands its partial sums on.
_HELD = 300_000


def vocabulary(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """``token, freq, n_pieces`` of every distinct pre-token of ``docs.text``; written once."""
    schema = T.StructType([T.StructField("token", T.StringType()), T.StructField("n", T.LongType())])
    arrow = to_arrow_schema(schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = PreTokenizer(tokenizer_path)
        held: Counter[str] = Counter()
        for batch in batches:
            for _, text in texts(batch):
                if text:
                    held.update(cut.tokens(text))
                if len(held) > _HELD:
                    yield from in_batches(held.items(), arrow, 50_000)
                    held.clear()
        yield from in_batches(held.items(), arrow, 50_000)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = PreTokenizer(tokenizer_path)
        for batch in batches:
            yield batch.append_column("n_pieces", pa.array([cut.count(t) for t in batch.column(0).to_pylist()], pa.int32()))

    counted = docs.select("text").mapInArrow(scan, schema).groupBy("token").agg(F.sum("n").alias("freq"))
    return written(counted.mapInArrow(pieces, "token string, freq long, n_pieces int"), "vocabulary")


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, head_size: int = 200_000) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` (more than ``limit`` tokens) for each row of ``docs``."""
    docs = pick(docs, id_col, text_col)
    vocab = vocabulary(docs, tokenizer_path)
    head = heaviest(vocab, "freq", head_size).select("token", "n_pieces").toArrow()
    known = docs.sparkSession.sparkContext.broadcast(dict(zip(head.column(0).to_pylist(), head.column(1).to_pylist(), strict=True)))
    pair = T.StructType([T.StructField("token", T.StringType()), T.StructField("f", T.LongType())])
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("head", T.LongType()), T.StructField("tail", T.ArrayType(pair))])
    arrow = to_arrow_schema(schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, pieces = PreTokenizer(tokenizer_path), known.value

        def rows(batch: pa.RecordBatch):
            for doc_id, (_, text) in zip(ids(batch), texts(batch), strict=True):
                text = text or ""
                total, tail = 0, []
                for token, f in Counter(cut.tokens(text)).items():
                    n = pieces.get(token)
                    if n is None:
                        tail.append((token, f))
                    else:
                        total += n * f
                yield doc_id, len(text.encode()), total, [{"token": t, "f": f} for t, f in tail]

        for batch in batches:
            yield from in_batches(rows(batch), arrow)

    counted = written(docs.mapInArrow(count, schema).withColumn("row", F.monotonically_increasing_id()), "token-frequencies")
    rest = counted.select("row", F.explode("tail").alias("t")).select("row", "t.token", "t.f")
    rest = rest.join(vocab.select("token", "n_pieces"), "token").groupBy("row").agg(F.sum(F.col("f") * F.col("n_pieces")).alias("rest"))
    total = F.col("head") + F.coalesce("rest", F.lit(0))
    return counted.select("row", "doc_id", "n_bytes", "head").join(rest, "row", "left").select("doc_id", "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit"))
