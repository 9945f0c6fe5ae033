import random

import pytest
from pyspark.sql import types as T


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, columns with clashing names."""
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "eps", "Zeta", "été", "straße", "x1"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    long = "\n".join(text(12) for _ in range(3000))
    rows = [(1, None), (2, ""), (3, " \t\n \r\x0b"), (4, long), (5, "one two three"), (6, "one two three"), (6, "one two three"), (None, "one two three"), (None, None), (7, long + " tail"), (8, "a\x00b \x1c c"), (9, "İstanbul Σίσυφος ΑΣ 日本語 👍🏽"), (10, "ONE  two\tTHREE"), (11, "<|endoftext|> x <|startoftext|>")]
    rows += [(100 + i, text(rng.randrange(0, 60)) + ("\nshared line here" if i % 2 else "")) for i in range(40)]
    names = ("lang", "source", "token", "row", "key", "n", "carried", "text_hash", "label", "hits")
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), *[T.StructField(c, T.StringType()) for c in names]])
    return spark.createDataFrame([(i, t, *[None if (k + (i or 0)) % 3 == 0 else c for k, c in enumerate(names)]) for i, t in rows], schema)


@pytest.fixture(scope="session")
def empty_docs(edge_docs):
    return edge_docs.limit(0)
