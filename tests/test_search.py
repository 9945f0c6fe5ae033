"""Phrases, budgets, blocks of queries, indexes on disk and planned searches against brute force."""

import math
import re

import pytest

from tessella.operators import rank, routes
from tessella.plans.search import HybridIndex, KeywordIndex
from tessella.sources import stored

TOKEN, PART = re.compile(r"[a-zA-Z][a-zA-Z0-9_+#.-]*|\d+(?:\.\d+)?"), re.compile(r"[a-z0-9]+")


def test_phrases_are_adjacent_parts(spark):
    texts = ["see node.js now. node js", "js node", "a_b-c++ c c", "3.14 and 3 14 3", "", "!?", "b c b_c.d", "filler words here"]
    texts += [f"other text {i}" for i in range(12)]
    queries = {1: "node.js js", 2: "b_c c++ C", 3: "3.14", 4: "", 5: "absent.word"}
    docs = {i: PART.findall(" ".join(TOKEN.findall(t.lower()))) for i, t in enumerate(texts)}
    docs = {i: p for i, p in docs.items() if p}
    mean, want = sum(map(len, docs.values())) / len(docs), {}
    for q, query in queries.items():
        for token in set(TOKEN.findall(query.lower())):
            phrase = PART.findall(token)
            tf = {i: sum(p[k : k + len(phrase)] == phrase for k in range(len(p))) for i, p in docs.items()}
            df = sum(n > 0 for n in tf.values())
            idf = max(math.log((len(docs) - df + 0.5) / (df + 0.5)), 1e-6)
            for i, n in tf.items():
                if n:
                    want[q, i] = want.get((q, i), 0) + idf * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(docs[i]) / mean))
    table = spark.createDataFrame([*enumerate(texts), (99, None)], "chunk_id long, text string")
    got = rank.fts_phrases(table, spark.createDataFrame(list(queries.items()), "query_id long, query string")).collect()
    assert len(got) == len(want) and {(r["query_id"], r["chunk_id"]): r["score"] for r in got} == pytest.approx(want)
    assert rank.fts_phrases(table, spark.createDataFrame([], "query_id long, query string")).count() == 0


def test_budget_ends_each_group(spark):
    sizes = {"a": [3, 0, 4, None, 3, 0, 1, 5], "b": [0, 0, None], "c": [11, 1], "d": [10, 0, 1, 0], None: [4, 0, 7, 0]}
    rows = [(g, i, n) for g, own in sizes.items() for i, n in enumerate(own)]
    want = set()
    for g, own in sizes.items():
        for i in range(len(own)):
            used = sum(n or 0 for n in own[: i + 1])
            if used <= 10:
                want.add((g, i, own[i], used))
    got = rank.within_budget(spark.createDataFrame(rows, "g string, i long, n long"), "n", 10, ["g"], ["i"]).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_queries_in_blocks_find_the_same(spark):
    chunks = spark.createDataFrame([(i, "", f"CS{100 + i % 7} text", "", "", i / 50) for i in range(40)], "chunk_id long, title string, text string, url string, date string, quality double")
    queries = routes.parsed(spark.createDataFrame([(i, f"about CS{100 + i}") for i in range(9)], "query_id long, query string"))
    found = lambda most: sorted(map(tuple, routes.exact_candidates(chunks, queries, 3, most=most).collect()))
    assert found(2) == found(100) and len(found(2)) == 21


def test_keyword_index_is_built_once(spark, tmp_path):
    path, docs = str(tmp_path / "index"), spark.createDataFrame([(i, f"w{i} all", "u") for i in range(6)], "chunk_id long, text string, url string")
    make = lambda **how: KeywordIndex(docs, weights={"text": 1.0}, b={"text": 0.75}, path=path, **how)
    ask = spark.createDataFrame([(1, "w4")], "query_id long, query string")
    first, second = make(), make()
    assert first.built and not second.built and [r["chunk_id"] for r in second.search(ask).collect()] == [4]
    assert make(rebuild=True).built and make(meta={"chunks": 900}).built
    short = make(limit=3)
    assert short.built and short.search(ask).count() == 0
    stored.remove(spark, f"{path}/committed")  # as if the build had ended early
    assert make(limit=3).built


def test_unfinished_vectors_are_refused(spark, tmp_path):
    path = str(tmp_path / "vectors")
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "chunk_id long, embedding array<double>")
    assert stored.add_vectors(rows.limit(2), path, last=False) == 2
    with pytest.raises(ValueError, match="not finished"):
        stored.open_vectors(spark, path)
    assert stored.add_vectors(rows, path) == 3 and stored.open_vectors(spark, path).count() == 5
    rows.limit(1).write.mode("append").parquet(f"{path}/vectors")
    with pytest.raises(ValueError, match="6 rows of 5"):
        stored.open_vectors(spark, path)


def test_planned_search_keeps_the_asked_querys_first_hits(spark):
    rows = [(i, i, 0, f"t{i}", f"{word} {word} filler{i}", "c", f"u{i}", f"p{i}", "web", "", 0.5) for i, word in enumerate(["apple"] * 4 + ["pear"] * 4 + ["plum"] * 4)]
    chunks = spark.createDataFrame(rows, "chunk_id long, doc_id long, chunk_index int, title string, text string, category string, url string, path string, source_type string, date string, quality double")
    queries = spark.createDataFrame([(1, "apple", "pear"), (2, "plum", " PLUM"), (3, "plum", None), (4, " ", None), (5, None, "pear")], "query_id long, query string, planned string")
    found = {}
    for r in HybridIndex(chunks).planned_search(queries, 6).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append(r["chunk_id"])
    assert set(found) == {1, 2, 3, 5} and found[2] == found[3] and len(found[1]) == len(set(found[1])) <= 6
    assert set(found[1][:2]) <= set(range(4)) and set(found[1]) & set(range(4, 8))
    assert set(found[2]) == set(range(8, 12)) and set(found[5]) == set(range(4, 8))


@pytest.mark.parametrize(
    "query,want",
    [
        ("想找机器人方向的导师", ["机器人"]), ("哪位教授研究computer vision和graphics？", ["computer vision和graphics"]), ("我要找做分布式存储的学院老师", ["分布式存储"]),
        ("robot arm", ["robot", "arm"]), ("vision visions", ["visions"]), ("visions Vision", ["visions"]), ("research area", []), ("导师方向", []), ("可以编程课题", ["可以编程"]), ("", []), (None, []),
    ],
)
def test_topics_of_questions(spark, query, want):
    from tessella.functions import extract

    df = spark.createDataFrame([(query,)], "q string")
    assert df.select(extract.topics("q", places=("学院",), known=("可以编程",)).alias("t")).first()["t"] == want
