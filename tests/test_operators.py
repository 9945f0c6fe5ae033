import pytest
from pyspark.sql import functions as F

from tessella.operators import assist, clean, dedup, evaluate, graph, hits, hop, rank, routes, structured


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def ranked(spark, data):
    return spark.createDataFrame(data, "query_id long, channel string, chunk_id long, rank int, score double")


def test_rrf_skips_channels_without_weight_and_breaks_ties(spark):
    df = ranked(spark, [(1, "lexical", 10, 1, 5.0), (1, "lexical", 11, 2, 9.0), (1, "dense", 11, 1, 0.2), (1, "structured", 12, 1, 3.0)])
    got = {r["chunk_id"]: (round(r["score"], 9), r["best"]) for r in rank.rrf(df, {"lexical": 1.0, "dense": 1.0, "structured": 0.0}).collect()}
    assert got == {10: (round(1 / 61, 9), 5.0), 11: (round(1 / 62 + 1 / 61, 9), 9.0)}


def test_neighbours_respect_gaps_hits_and_limit(spark):
    chunks = spark.createDataFrame([(i, 1, p) for i, p in enumerate([0, 1, 2, 4])] + [(9, 2, 0)], "chunk_id long, doc_id long, chunk_index int")
    hits = spark.createDataFrame([(7, 1, 2.0), (7, 9, 1.0), (7, 2, 3.0)], "query_id long, chunk_id long, score double")
    assert rows(rank.neighbours(hits, chunks), "chunk_id", "score") == [(0, 1.95)]
    assert rows(rank.neighbours(hits, chunks, window=2), "chunk_id") == [(0,), (3,)]
    assert len(rank.neighbours(hits, chunks, window=2, limit=1).collect()) == 1


def test_bm25f_keeps_global_statistics_under_a_filter(spark):
    docs = spark.createDataFrame([(1, "apple pie", "t", "a", "u1"), (2, "apple tart", "t", "b", "u2"), (3, "plum", "apple", "b", "u3"), (4, "apple pie", "t", "a", "u1")], "chunk_id long, text string, title string, category string, url string")
    queries = spark.createDataFrame([(1, "apple pie")], "query_id long, query string")
    free = dict(rows(rank.bm25f(docs, queries), "chunk_id", "score"))
    only = dict(rows(rank.bm25f(docs, queries, categories=["b"]), "chunk_id", "score"))
    assert set(free) == {1, 2, 3, 4} and only == {k: free[k] for k in (2, 3)}
    unique = rank.deduplicated(rank.bm25f(docs, queries), docs, 10)
    assert {r["chunk_id"] for r in unique.collect()} == {1, 2, 3}


def test_dense_search_handles_zero_and_equal_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [2.0, 0.0]), (4, [0.0, 1.0])], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(1, [3.0, 0.0])], "query_id long, embedding array<float>")
    got = rank.dense_topk(v, q, 3).orderBy("rank").collect()
    assert [(r["chunk_id"], round(r["score"], 6)) for r in got] == [(1, 1.0), (3, 1.0), (2, 0.0)]
    assert rank.dense_topk(v, q.limit(0), 3).count() == 0


def test_promotion_and_pins(spark):
    ranked_hits = spark.createDataFrame([(1, c, i + 1) for i, c in enumerate([5, 6, 7, 8])], "query_id long, chunk_id long, rank int")
    precise = spark.createDataFrame([(1, 8, 320.0, 1.0), (1, 9, 400.0, 1.0), (1, 6, 100.0, 1.0)], "query_id long, chunk_id long, score double, raw double")
    assert [c for _, c in rows(rank.promote(ranked_hits, precise, 4), "rank", "chunk_id")] == [9, 8, 5, 6]
    order = spark.createDataFrame([(1, [3, 3, 9, 1])], "query_id long, indices array<int>")
    assert [c for _, c in rows(rank.apply_ranking(ranked_hits, order, 3), "rank", "chunk_id")] == [7, 5, 6]


def test_greedy_diversity(spark):
    data = [(1, i, 0, 10.0 - i, f"title {i % 2 if i < 4 else i}", f"http://h/{i // 3}?x={i}", "p", f"text {i if i != 5 else 4}") for i in range(8)]
    hits = spark.createDataFrame(data, "query_id long, chunk_id long, chunk_index int, score double, title string, url string, path string, text string")
    wide = [c for _, c in rows(dedup.greedy_diverse(hits, 6), "rank", "chunk_id")]
    assert wide == [0, 1, 4, 6, 7]  # 2, 3: title and source taken; 5: the text of 4
    assert [c for _, c in rows(dedup.greedy_diverse(hits, 3), "rank", "chunk_id")] == [0, 3, 6]  # 1 was not taken, so its title is free


def test_cleaning_lines(spark):
    text = "# Head\n\n---\n导航\nkeep me\nkeep me\nkeep me\n![i](u)\n[a](b) [c](d) [e](f)\nURL: https://x.y/z\nreal line 2024-01-02\x00\r\nshare分享到here"
    df = spark.createDataFrame([("k", text), ("e", ""), ("n", None)], "doc_id string, text string")
    got = {r["doc_id"]: r for r in clean.clean(df).collect()}
    assert got["k"]["cleaned"].split("\n") == ["# Head", "keep me", "keep me", "real line 2024-01-02", "share"]
    assert got["e"]["cleaned"] == got["n"]["cleaned"] == "" and got["k"]["kept_lines"] == 5
    black = spark.createDataFrame([("keep me", 30)], "line string, n_docs long")
    assert "keep me" not in {r["doc_id"]: r["cleaned"] for r in clean.clean(df, black).collect()}["k"]
    second = {r["doc_id"]: r["cleaned"] for r in clean.clean_2(df).collect()}
    assert second["k"].split("\n")[:3] == ["# Head", "keep me", "keep me"]


def test_line_blacklist_counts_documents(spark):
    docs = [(i, "menu bar\nmenu bar\n" + f"own {i}\n" + "x" * 70) for i in range(25)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(clean.line_blacklist(df, static=False), "line", "n_docs") == [("menu bar", 25)]
    assert clean.line_blacklist(df).filter("line = '首页'").count() == 1


def test_first_wins_is_independent_of_partitions(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 3, None)], "k string, o int, v string").repartition(3)
    assert [(r["k"], r["v"]) for r in dedup.first_wins(df, ["k"], ["o"]).orderBy("k").collect()] == [("a", "y"), ("b", None)]


def test_bfs_is_bounded_and_handles_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e")], "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "node string")
    assert rows(graph.bfs(edges, seeds, 3), "node", "depth") == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]


@pytest.mark.parametrize("text,want", [("张三(San Zhang)", [("张三", "San Zhang")]), ("张三、李四(San Zhang, Si Li)", [("张三", "San Zhang"), ("李四", "Si Li")]), ("Ada Lovelace; Alan Turing", [("", "Ada Lovelace"), ("", "Alan Turing")]), ("", []), (None, [])])
def test_persons(text, want):
    assert hop.persons_of(text) == want


def test_hop_finds_profiles(spark):
    records = spark.createDataFrame([(1, "张三(San Zhang)"), (2, "Ada Lovelace")], "query_id long, names string")
    pages = spark.createDataFrame([(10, "主页", "张三 教授", "", 1.0), (11, "home", "I am AdaLovelace ada lovelace", "", 2.0), (12, "x", "张四", "", 3.0)], "chunk_id long, title string, text string, url string, score double")
    assert rows(hop.hop(records, pages), "query_id", "chunk_id") == [(1, 10), (2, 11)]


def test_reply_parsers():
    assert assist.keywords_of('noise {"keywords": ["CS101", "cs101", "请问"]} tail') == ["CS101"]
    assert assist.keywords_of('{"keywords": ["a", "b') == ["a"]
    assert assist.keywords_of("x" * 501) == []
    assert assist.ranking_of('{"ranked_indices": [2, "3", {"id": 1}, 9, 2]}', 3) == [2, 3, 1]
    assert assist.ranking_of("no json", 3) == []
    assert assist.decision_of("prose thinking process " + "x" * 600)["error"] == "invalid_json"
    assert assist.decision_of('{"action": "SEARCH", "keywords": "a, b"}')["keywords"] == ["a", "b"]


def test_context_budget():
    hits = [{"title": f"t{i}", "type": "web", "path": "p", "text": "x" * 2000} for i in range(10)]
    packed = assist.context_of(hits, 3000)
    assert len(packed) <= 3000 and packed.startswith("[1] title=t0") and packed.count("[") >= 3
    assert assist.context_of(hits[:1], None).endswith("x" * 2000)


def test_failed_model_calls_degrade_rows(spark):
    def model(prompts):
        if any("bad" in p for p in prompts):
            raise ValueError("no")
        return [p.upper() for p in prompts]

    df = spark.createDataFrame([("a",), ("bad",)], "prompt string").coalesce(1)
    got = {r["prompt"]: (r["reply"], r["error"]) for r in assist.replies(df, model, batch=1).collect()}
    assert got == {"a": ("A", None), "bad": (None, "ValueError: no")}


def test_intents_and_features(spark):
    queries = routes.parsed(spark.createDataFrame([(1, "who teaches CS101 in 2024"), (2, "office of a professor")], "query_id long, query string"))
    got = {r["query_id"]: r for r in queries.collect()}
    assert got[1]["codes"] == ["CS101"] and got[1]["years"] == ["2024"] and got[2]["intents"] == ["faculty"]
    chunks = spark.createDataFrame([(1, "CS101", "about cs101 2024", "", "2024-01", "c", "web", "", 0.5), (2, "other", "x", "", "", "c", "web", "", 0.9)], "chunk_id long, title string, text string, url string, date string, category string, source_type string, path string, quality double")
    assert rows(routes.exact_candidates(chunks, queries), "query_id", "chunk_id") == [(1, 1)]
    hits = spark.createDataFrame([(1, 1, 1.0), (1, 2, 1.0)], "query_id long, chunk_id long, score double")
    plain = dict(rows(routes.rule_rerank(hits, chunks, queries), "chunk_id", "score"))
    more = dict(rows(routes.rule_rerank(hits, chunks, queries, [routes.Feature(5.0, "title", "equals", "other")]), "chunk_id", "score"))
    assert plain[1] > plain[2] and more[2] == plain[2] + 5 and more[1] == plain[1]


def test_structured_rows(spark):
    df = spark.createDataFrame([(1, "CS101", ["A", " B "], "0.9", 5, None), (2, "", None, "0.1", 6, "x"), (3, "CS1", None, "bad", 7, "y")], "id long, course_code string, teachers array<string>, confidence string, source_document_id long, evidence string")
    got = df.withColumns({"ok": structured.valid_row(df, "courses"), "md": structured.row_markdown(df, "courses"), "title": structured.row_title(df, "courses"), "json": structured.sorted_json(df), "key": structured.row_key(df, "courses")}).orderBy("id").collect()
    assert [r["ok"] for r in got] == [True, False, True]
    assert got[0]["md"] == "# CS101\n\n来源表: courses\n- 课程代码: CS101\n- 任课教师: A、B\n- confidence: 0.9" and got[1]["title"] == "courses"
    assert got[0]["json"].startswith('{"confidence":"0.9","course_code"') and got[0]["key"].startswith("courses|CS101")
    docs = spark.createDataFrame([(5, "http://d", "2020-01")], "id long, url string, source_published_at string")
    assert sorted((r["id"], r["doc_url"]) for r in structured.with_documents(df, docs).fillna("").collect()) == [(1, "http://d"), (2, ""), (3, "")]


def test_flattening_json(spark):
    texts = spark.createDataFrame([('[{"a":1},2]',), ('{"g":[{"b":2}],"h":{"c":3},"i":5}',)], "value string")
    got = sorted((r["group"] or "", r["record"]) for r in structured.flattened(texts).collect())
    assert got == [("", '{"a":1}'), ("g", '{"b":2}'), ("h", '{"c":3}')]
    pair = spark.createDataFrame([('{"CS101":["A"]}',)], "value string")
    assert structured.flattened(pair, pair=("code", "teachers")).first()["record"].startswith('{"code":"CS101"')


def test_scores_and_checks(spark):
    items = spark.createDataFrame([("a", "contains_all", [["x", "y"], ["z"]]), ("b", "regex", [["^q.r$"]]), ("b", "exact_any", [["no"]])], "id string, eval_type string, targets array<array<string>>")
    answers = spark.createDataFrame([("a", "Y and Ｚ"), ("c", "?")], "id string, sys_answer string")
    assert rows(evaluate.scored(items, answers), "id", "sys_answer_correct") == [("a", True)]
    assert rows(evaluate.unknown_answers(items, answers), "id") == [("c",)]
    assert rows(evaluate.problems(items, ["eval_type"]), "id", "problem") == [("b", "repeated id")]
    facts = spark.createDataFrame([(1, ["One", "two"], "http://s")], "id long, expected array<string>, source_url string")
    hits = spark.createDataFrame([(1, "one TWO", "http://s/x")], "query_id long, text string, url string")
    assert rows(evaluate.verify_facts(facts, hits), "ok", "matched", "source_hit") == [(True, 2, True)]
    found = evaluate.longest_match(spark.createDataFrame([(1, 1, "Room 1A-2 and Room 3B-44")], "query_id long, rank int, text string"), [r"\bRoom\s+[A-Za-z0-9-]+"])
    assert rows(found, "value") == [("Room 3B-44",)]


def test_group_order_is_by_count(spark):
    df = spark.createDataFrame([("a", 1.0), ("", 2.0), ("a", 2.0)], "g string, q double")
    assert [(r["g"], r["n"], r["avg_quality"]) for r in evaluate.group_report(df, "g", "q").collect()] == [("a", 2, 1.5), ("(none)", 1, 2.0)]
    assert [r["g"] for r in evaluate.top_values(df, "g", 1).collect()] == ["a"]


def test_lcg_sample_is_stable(spark):
    df = spark.range(100).withColumn("g", F.col("id") % 3)
    assert rows(rank.lcg_sample(df, 2, "g"), "id") == rows(rank.lcg_sample(df.repartition(7), 2, "g"), "id")


@pytest.mark.parametrize(
    "reply,think,answer",
    [
        ("<think>a</think>\nb", "a", "b"), ("Here's a thinking process: x", "x", ""), ("  Here is a thinking process: x</think>y</think>z", "x", "y</think>z"), ("Thinking process: x", "x", ""),
        ("思考过程 x", "", "思考过程 x"), ("Thinking Process: x", "", "Thinking Process: x"), ("<think> Thinking process: x", "x", ""), ("plain\n", "", "plain"), ("", "", ""),
    ],
)
def test_thinking_is_told_like_in_the_stream(spark, reply, think, answer):
    from tessella.streaming.replies import Splitter

    row = spark.createDataFrame([(reply,)], "reply string").select(*assist.split_thinking("reply")).first()
    assert tuple(row) == (think, answer)
    for n in (1, 2, 5, 100):
        s = Splitter()
        out = [p for i in range(0, len(reply), n) for p in s.feed(reply[i : i + n])] + list(s.finish())
        assert "".join(t for k, t in out if k == "answer").strip() == answer and "".join(t for k, t in out if k == "think").strip().endswith(think)


def test_persons_of_several_shapes():
    assert hop.persons_of("教师 张三 (San Zhang)；李四") == [("张三", "San Zhang"), ("李四", "")]
    assert hop.persons_of("张三(San Zhang), 张三, San Zhang") == [("张三", "San Zhang")]
    assert hop.persons_of("张三、李四、王五(San Zhang, Si Li)") == [("张三", "San Zhang"), ("李四", "Si Li"), ("王五", "")]
    assert hop.persons_of("J. Ada Lovelace / Data University; Alan Turing") == [("", "Ada Lovelace"), ("", "Alan Turing")]


def test_context_shares_and_ends():
    hit = lambda n, **more: {"type": "web", "path": "p", "text": "x" * n, **more}
    assert assist.context_of([hit(5000)], 100) == "[1] type=web | path=p\n" + "x" * 117 + "..."
    blocks = assist.context_of([hit(5000)] * 9, 7200).split("\n\n")
    assert [len(b.partition("\n")[2]) for b in blocks[:5]] == [1200] * 5 and len(blocks) == 6
    assert assist.context_of([hit(3, title="ab")], 500, {"xx": "y"}) == "[1] title=ab | type=web | path=p\nyx"


def test_years_are_taken_together(spark):
    queries = routes.parsed(spark.createDataFrame([(1, "zz 2023 2024")], "query_id long, query string"))
    text = [(1, "made in 2024", "", "c"), (2, "made in 2019", "", "c"), (3, "undated", "", "courses"), (4, "undated", "2023-01", "c")]
    chunks = spark.createDataFrame([(i, "", t, "", d, c, "web", "", 0.0) for i, t, d, c in text], "chunk_id long, title string, text string, url string, date string, category string, source_type string, path string, quality double")
    hits = chunks.select(F.lit(1).cast("long").alias("query_id"), "chunk_id", F.lit(0.0).alias("score"))
    got = dict(rows(routes.rule_rerank(hits, chunks, queries, priority={}), "chunk_id", "score"))
    assert {k: round(v - 1, 6) for k, v in got.items()} == {1: 16 + 4 * 0.35, 2: -36.0, 3: -20.5, 4: 24.0}


def test_hit_classes(spark):
    who = [("张三", None), (None, "Ada Lovelace")]
    many = [
        (1, "cs101", "任课教师: x", "", "web", ["CS101"], who, (True, True, False, False)),
        (2, "x", "任课教师 CS101A", "", "web", ["CS101"], who, (False, False, False, False)),
        (3, "x", "see\n# CS101", "", "courses", ["CS101"], who, (False, False, False, False)),
        (4, "x", "#CS101课程", "", "courses", ["CS101"], who, (False, False, False, False)),
        (5, "x", "#cs101 b", "", "courses", ["AB1", "CS101"], who, (True, False, False, False)),
        (6, "张三丰", "张三教授", "u/FACULTY", "web", [], who, (False, False, True, True)),
        (7, "张三丰", "王张三", "u/faculty/courses", "web", None, who, (False, False, False, False)),
        (8, "x", "a" * 1400 + "contact me", "", "web", [], who, (False, False, False, False)),
        (9, "x", "a" * 9000 + "adalovelace", "", "faculty", ["C.*"], who, (False, False, True, True)),
        (10, None, None, None, None, None, None, (False, False, False, False)),
        (11, "x", "Associate Professor, a@some.example", "", "web", [], [("", "--")], (False, False, True, False)),
    ]
    shape = "id long, title string, text string, url string, category string, codes array<string>, persons array<struct<cjk: string, latin: string>>"
    df = spark.createDataFrame([m[:-1] for m in many], shape)
    got = hits.hit_classes(df, mail_domain="Some.example").collect()
    assert {r["id"]: (r["primary_record"], r["loose_record"], r["profile"], r["names_person"]) for r in got} == {m[0]: m[-1] for m in many}
    assert hits.hit_classes(df.limit(0).select("id", "codes", "persons")).count() == 0


def test_document_frequencies_by_row_and_by_postings(spark):
    docs = spark.createDataFrame([(1, "ab cd ab", "cd"), (2, None, "cd ef"), (3, "", None), (4, "ab cd ab", "cd")], "chunk_id long, text string, title string")
    by_row = rank.row_document_frequency(docs, ["text", "title"])
    assert rows(by_row, "token", "df") == rows(rank.document_frequency(rank.postings(docs, ["text", "title"])), "token", "df") == [("ab", 2), ("cd", 3), ("ef", 1)]
    assert rank.row_document_frequency(docs.limit(0), ["text"]).count() == 0
