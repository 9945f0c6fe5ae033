"""The functions that SQL text can call, under their names in this engine."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .text import nfkc


def register(spark: SparkSession) -> list[str]:
    """Register scalar functions and the table function ``extract_persons``; the names."""
    from ..operators import assist, hop

    scalar = {"nfkc": nfkc, "parse_keywords": assist.parse_keywords, "parse_ranked_indices": assist.parse_ranking, "parse_decision": assist.parse_decision, "persons": hop.persons}
    for name, f in scalar.items():
        spark.udf.register(name, f)

    @F.udtf(returnType="cjk string, latin string")
    class Persons:
        def eval(self, names: str):
            yield from hop.persons_of(names)

    spark.udtf.register("extract_persons", Persons)
    # native functions of one text, as temporary SQL functions
    native = {
        "tokenize_ascii": "CREATE OR REPLACE TEMPORARY FUNCTION tokenize_ascii(t STRING) RETURNS ARRAY<STRING> RETURN regexp_extract_all(lower(t), '[a-zA-Z][a-zA-Z0-9_+#.-]*|\\\\d+(?:\\\\.\\\\d+)?', 0)",
        "stable_hash": "CREATE OR REPLACE TEMPORARY FUNCTION stable_hash(t STRING, n INT) RETURNS STRING RETURN substring(sha1(t), 1, n)",
        "chunk_windows": "CREATE OR REPLACE TEMPORARY FUNCTION chunk_windows(t STRING, most INT, overlap INT) RETURNS ARRAY<STRING> RETURN transform(sequence(0, greatest(0, cast(ceil((length(t) - most) / (most - overlap)) AS INT) * (most - overlap)), most - overlap), s -> trim(substring(t, s + 1, most)))",
    }
    for sql in native.values():
        spark.sql(sql)
    return [*scalar, "extract_persons", *native]
