import pytest
from pyspark.sql import functions as F

from tessella import __main__ as cli
from tessella.functions.register import register
from tessella.operators import assist
from tessella.plans import evaluate as runs
from tessella.plans.queries import QUERIES
from tessella.plans.search import HybridIndex, SearchConfig

SF = "/root/testdata/sf0.001"


def test_sql_functions(spark):
    assert "extract_persons" in register(spark)
    row = spark.sql("SELECT nfkc('Ａ') AS a, stable_hash('x', 4) AS h, chunk_windows('abcdef', 4, 1) AS w, tokenize_ascii('A b-1') AS t").first()
    assert row["a"] == "A" and len(row["h"]) == 4 and row["w"] == ["abcd", "def"] and row["t"] == ["a", "b-1"]
    assert [tuple(r) for r in spark.sql("SELECT * FROM extract_persons('张三(San Zhang)')").collect()] == [("张三", "San Zhang")]


def test_answers_are_made_visible(spark):
    df = spark.createDataFrame([("a\n来源：x", "t", "r", "q"), ("", "t", "r", "q"), ("", "", " r ", "q")], "answer string, think string, raw string, query string")
    got = [r["v"] for r in df.select(assist.visible_answer("answer", "think", "raw", "query").alias("v")).collect()]
    assert got == ["a\n来源：x", "根据当前资料无法确认：q", "r"]
    placed = df.select(assist.before_sources("answer", F.lit("new")).alias("v")).first()["v"]
    assert placed == "a\n\nnew\n\n来源：x"
    assert df.select(assist.source_refs(F.array(F.lit(2), F.lit(2), F.lit(5))).alias("v")).first()["v"] == "[2][5]"


def test_verification_queries_are_distinct(spark):
    df = spark.createDataFrame([(1, "CS101 teacher", "Teacher CS101", ["x"])], "query_id long, query string, planned string, keywords array<string>")
    assert [r["query"] for r in assist.verification_queries(df).orderBy("n").collect()] == ["Teacher CS101", "CS101 teacher x", "Teacher", "teacher x"]


def test_embedding_needs_a_vector_for_each_text(spark):
    df = spark.createDataFrame([("a",), ("bb",)], "text string").coalesce(1)
    assert [r["embedding"] for r in assist.embedded(df, lambda ts: [[len(t)] for t in ts]).orderBy("text").collect()] == [[1.0], [2.0]]
    with pytest.raises(Exception, match="vectors for"):
        assist.embedded(df, lambda ts: []).collect()


def test_test_sets_run_end_to_end(spark):
    chunks = spark.createDataFrame([(i, i, 0, f"T{i}", f"answer {i} for CS10{i}", "c", f"u{i}", "p", "web", "", 0.5) for i in range(4)], "chunk_id long, doc_id long, chunk_index int, title string, text string, category string, url string, path string, source_type string, date string, quality double")
    items = spark.createDataFrame([("a", "CS101", "contains_all", [["answer 1"]]), ("b", "CS102", "contains_all", [["nothing"]])], "id string, query string, eval_type string, targets array<array<string>>")
    with pytest.raises(ValueError, match="zz"):
        runs.selected(items, ["a", "zz"])
    results = runs.run_items(HybridIndex(chunks, config=SearchConfig(top_k=2)), runs.selected(items), lambda q, context: context)
    got = {r["id"]: (r["correct"], r["error"]) for r in results.collect()}
    assert got == {"a": (True, ""), "b": (False, "")}
    assert runs.report(results)["overall"].first()["accuracy"] == 0.5


def test_command_line(spark, capsys, tmp_path):
    (tmp_path / "jsonl").mkdir()
    (tmp_path / "jsonl/facts.jsonl").write_text('{"id": 1}\n')
    assert cli.main(["tables", str(tmp_path)]) == 0 and capsys.readouterr().out.strip() == "facts\t1"
    assert cli.main(["search", f"{SF}/documents.parquet", "the nation", "--id", "doc_id", "--top", "2"]) == 0
    assert len(capsys.readouterr().out.strip().split("\n")) == 2


def test_scans_are_pruned_and_pushed_down(spark):
    plan = QUERIES["semi_multiget"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(toxic), EqualTo(toxic,1)" in plan and "text" not in plan
    plan = QUERIES["lcg_sample"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "text" not in plan


def test_no_plan_has_a_cartesian_product_of_tables(spark):
    for name in ("bm25f_topk", "rrf_fusion", "contained_terms", "neighbor_expand", "exact_dedup"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "CartesianProduct" not in plan
