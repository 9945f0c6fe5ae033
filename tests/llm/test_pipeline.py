import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

import __spark_entry__


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """A small corpus with planted copies, near copies, benchmark passages, junk and a repeated line."""
    rng = random.Random(12)
    path = str(tmp_path_factory.mktemp("sf"))
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(600)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    junk = lambda n: " ".join(w + "$$$" for w in text(n).split())
    docs, labels = [], []
    for i in range(300):
        bad = i % 4 == 3
        docs.append((i, junk(80) if bad else text(90)))
        labels.append((i, 0 if bad else 1, 0))
    items = [(k, text(30)) for k in range(5)]
    docs[0] = (0, docs[0][1] + "\nthis very line repeats")
    for i in range(4, 60, 4):
        docs[i] = (i, docs[i][1] + "\nthis very line repeats")
    docs[101] = (101, docs[100][1])
    docs[102] = (102, docs[100][1].replace(docs[100][1].split()[40], "changed", 1))
    docs[200] = (200, docs[200][1] + "\n" + items[2][1])
    docs[201] = (201, None)
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_do_their_work(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, sizes = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        sizes.append(docs.count())
        if k < 4:
            assert docs.columns == columns
        ids = {r["doc_id"] for r in docs.select("doc_id").distinct().collect()}
        if name == "quality":
            clean = {i for i in range(300) if i % 4 != 3 and i != 201}
            assert len(clean - ids) <= 2 and len({i for i in range(300) if i % 4 == 3} & ids) <= 2
        if name == "lines":
            again = docs.filter(F.col("text").contains("this very line repeats"))
            assert [r["doc_id"] for r in again.select("doc_id").collect()] == [0]
            assert docs.filter(F.length("text") != F.col("n_chars")).filter("text IS NOT NULL AND n_chars > 0").count() == 0
        if name == "near_duplicates":
            assert 100 in ids and not {101, 102} & ids
        if name == "benchmark":
            assert 200 not in ids and 196 in ids
    assert sizes[0] >= sizes[1] >= sizes[2] >= sizes[3] > 0 and sizes[4] >= sizes[3]


def test_run_gives_the_last_stages_rows(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0
    assert corpus_pipeline.ORACLE_SQL is None


def test_queries_are_registered():
    names = __spark_entry__.queries()
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 11)) and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_stages_on_odd_and_empty_tables(spark, sf, tmp_path, edge_docs):
    """Nulls in any column, repeated and null ids, very long texts, columns whose names clash, no rows, one class of labels only."""
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    odd = edge_docs.withColumns({"kept_id": F.lit("k"), "_row": F.lit("r"), "n_chars": F.length("text").cast("long")})
    for name, docs in (("odd", odd), ("none", odd.limit(0))):
        path = str(tmp_path / name)
        docs.write.parquet(f"{path}/documents.parquet")
        docs.select("doc_id", F.lit(0).alias("quality"), F.lit(0).alias("toxic")).write.parquet(f"{path}/labels.parquet")
        items.limit(0 if name == "none" else 5).write.parquet(f"{path}/benchmark.parquet")
        docs = spark.read.parquet(f"{path}/documents.parquet")
        for k, (stage_name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, path)
            assert k == 4 or out.columns == docs.columns
            before = docs.count()
            out.write.parquet(f"{path}/{stage_name}")
            docs = spark.read.parquet(f"{path}/{stage_name}")
            assert stage_name not in ("quality", "benchmark") or docs.count() == before
            if name == "none":
                assert docs.count() == 0
        if name == "odd":
            assert {r["doc_id"] for r in docs.select("doc_id").distinct().collect()} >= {1, 2, 3, 8, 9, 11}
