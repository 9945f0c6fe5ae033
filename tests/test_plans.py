import json

import pytest
from pyspark.sql import functions as F

from tessella.functions.fixed import Domain
from tessella.operators.routes import Route
from tessella.plans import build
from tessella.plans.search import HybridIndex, KeywordIndex, SearchConfig, rollout
from tessella.sources import files, stored
from tessella.streaming import events
from tessella.streaming.replies import Splitter, split_stream, sse_data


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("texts")
    body = lambda i: f"# Page {i}\nhttps://a.org/p{i} 2024-03-0{i % 9 + 1}\n" + "\n".join(f"line {j} of page {i} tells of topic{i} and more words to fill it" for j in range(8))
    for i in range(6):
        (folder / f"p{i}.md").write_text(body(i))
    (folder / "copy.md").write_text(body(0))
    (folder / "short.md").write_text("tiny")
    (folder / "bad.md").write_text("Ã" * 300)
    (folder / "x.js.md").write_text(body(9))
    texts = files.crawled_texts(spark, [(str(folder), "web", 0.76)])
    return build.build_corpus(build.candidates(texts, "self", Domain(host_suffixes=("a.org",))))


def test_build_filters_chunks_and_deduplicates(corpus):
    docs = corpus.documents.collect()
    assert len(docs) == 6 and {r["host"] for r in docs} == {"a.org"} and all(r["date"].startswith("2024-03") for r in docs)
    assert sorted((r["reason"], r["n"]) for r in corpus.skipped.collect()) == [("garbled", 1), ("no_chunks", 1), ("short", 1)]
    chunks = corpus.chunks.collect()
    assert len({r["content_hash"] for r in chunks}) == len(chunks) >= 6 and all(len(r["chunk_uid"]) == 32 for r in chunks)
    tables = build.reports(corpus)
    assert tables["documents"].first()["n"] == 6 and tables["sample"].count() == 3


def test_ids_follow_the_order(corpus):
    got = build.numbered(corpus.chunks.select("path", "chunk_index").repartition(5), ["path", "chunk_index"]).orderBy("id").collect()
    assert [r["id"] for r in got] == list(range(1, len(got) + 1)) and got == sorted(got, key=lambda r: (r["path"], r["chunk_index"]))


def test_structured_rows_join_the_corpus(spark, corpus):
    rows = spark.createDataFrame([(1, "CS101", "Algorithms and data structures", "0.9"), (2, "CS102", "x", "0.1")], "id long, course_code string, course_name string, confidence string")
    got = build.add_structured(corpus, rows, "courses").collect()
    assert [r["record_id"] for r in got] == ["1"] and json.loads(got[0]["raw_json"])["course_code"] == "CS101" and round(got[0]["quality"], 3) == 0.828


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [(i, i // 3, i % 3, f"Title {i}", f"course CS{100 + i} about subject{i} and common words", "course" if i % 2 else "news", f"http://h/{i}", f"p/{i}", "web", "2024-01", 0.5 + i / 100) for i in range(30)]
    return spark.createDataFrame(rows, "chunk_id long, doc_id long, chunk_index int, title string, text string, category string, url string, path string, source_type string, date string, quality double")


def test_keyword_index(spark, chunks):
    index = KeywordIndex(chunks)
    queries = spark.createDataFrame([(1, "subject7 common"), (2, "nothing here")], "query_id long, query string")
    got = index.search(queries, 3).orderBy("query_id", "rank").collect()
    assert got[0]["chunk_id"] == 7 and got[0]["snippet"].startswith("course CS107") and {r["query_id"] for r in got} == {1}
    assert index.search(queries, 3, categories=["news"]).filter("chunk_id % 2 = 1").count() == 0


def test_hybrid_search(spark, chunks):
    vectors = chunks.select("chunk_id", F.array(F.col("chunk_id").cast("double"), F.lit(1.0)).alias("embedding"))
    index = HybridIndex(chunks, vectors, SearchConfig(top_k=5, neighbour_limit=0, routes=(Route("course", categories=("course",)),)))
    queries = spark.createDataFrame([(1, "which course is CS105")], "query_id long, query string")
    hits = index.search(queries, spark.createDataFrame([(1, [5.0, 1.0])], "query_id long, embedding array<double>")).orderBy("rank").collect()
    assert hits[0]["chunk_id"] == 5 and len(hits) == 5 and len({r["url"] for r in hits}) == 5
    turned = index.search(queries, rerank=lambda prompts: ['{"ranking": [2, 1]}' for _ in prompts]).orderBy("rank").collect()
    plain = index.search(queries).orderBy("rank").collect()
    assert [r["chunk_id"] for r in turned[:2]] == [plain[1]["chunk_id"], plain[0]["chunk_id"]]
    assert index.contexts(index.search(queries)).first()["context"].startswith("[1] title=")


def test_rollout_stops(spark, chunks):
    index = HybridIndex(chunks, config=SearchConfig(top_k=3))
    replies = iter(['{"action": "search", "query": "subject9", "keywords": []}', '{"action": "answer", "note": "done"}'])
    assert rollout(index, "CS104", lambda _: next(replies))["note"] == "done"
    assert rollout(index, "CS104", lambda _: '{"action": "search", "query": "CS104"}')["note"] == "repeated query"
    assert rollout(index, "CS104", lambda _: 1 / 0)["note"].startswith("ZeroDivisionError")


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "jsonl").mkdir()
    (tmp_path / "jsonl/chunks.jsonl").write_text('{"id": 1, "text": "abc", "document_id": 7}\n\n{"id": 2, "text": "abcdef", "document_id": 8}\n[1]\n')
    lines = files.json_objects(spark, str(tmp_path / "jsonl/chunks.jsonl")).collect()
    assert [r["line_no"] for r in lines] == [1, 3]
    (tmp_path / "jsonl/documents.jsonl").write_text('{"id": 7, "url": "u"}\n')
    (tmp_path / "jsonl/chunks.jsonl").write_text('{"id": 1, "text": "abc", "document_id": 7}\n{"id": 2, "text": "abcdef", "document_id": 8}\n')
    data = files.Dataset(spark, str(tmp_path))
    assert data.tables() == ["chunks", "documents"] and data.count("chunks") == 2
    got = data.chunks(least=2, with_document=True).orderBy("id").collect()
    assert got[0]["document"]["url"] == "u" and got[1]["document"] is None
    assert files.jsonl(spark, str(tmp_path / "none.jsonl"), "id long", missing_ok=True).count() == 0
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n{oops\n')
    with pytest.raises(Exception, match="bad.jsonl:2"):
        files.json_objects(spark, str(tmp_path / "bad.jsonl")).collect()
    out = str(tmp_path / "out")
    assert stored.add_missing(spark.range(3), out, "id") == 3 and stored.add_missing(spark.range(5), out, "id") == 2
    stored.write_csv(spark.createDataFrame([(1, 'a "q"\nb')], "id long, t string"), str(tmp_path / "csv"), bom=True)
    back = files.csv(spark, str(tmp_path / "csv")).first()
    assert back["id"] == "1" and back["t"] == 'a "q"\nb'
    assert stored.is_stale({"n": 1, "chunks": 9}, {"n": 1}) is False and stored.is_stale({"n": 1}, {"n": 2}) is True
    assert [r["url"] for r in files.url_list(spark, None, "b, a,b").collect()] == ["b", "a"]
    second = stored.chunk_view(spark.createDataFrame([(1, "t", None, 0.5)], "id long, source_tier string, source_url string, quality double"))
    assert second.first().asDict() == {"chunk_id": 1, "source_type": "t", "url": "", "quality": 0.5}


def test_html_pages(spark):
    df = spark.createDataFrame([("<title>T</title><h1>Longer head</h1><script>x</script><p>Hi &amp; bye</p>", b"\xd6\xd0")], "html string, raw binary")
    got = df.select(files.page_parts("html").alias("p"), files.decoded("raw").alias("d")).first()
    assert got["p"]["title"] == "Longer head" and got["p"]["text"] == "T\nLonger head\nHi & bye" and got["d"] == "中"
    rows = files.css_rows([{"base": "li", "fields": [{"name": "link", "tag": "a", "attribute": "href"}, {"name": "label", "tag": "a"}]}])
    html = spark.createDataFrame([("<ul><li><a href='/1'>one</a></li><li><a href='/2'>two</a></li></ul>",)], "html string")
    assert html.select(rows("html").alias("r")).first()["r"] == [{"link": "/1", "label": "one"}, {"link": "/2", "label": "two"}]


@pytest.mark.parametrize("text,want", [("<think>a b</think>c", ("a b", "c")), ("plain text", ("", "plain text")), ("Thinking Process: x</think>y", ("Thinking Process: x", "y")), ("<think>open", ("open", ""))])
def test_splitter_does_not_depend_on_the_cuts(text, want):
    for n in (1, 2, 3, 7, 100):
        s = Splitter()
        out = [p for i in range(0, len(text), n) for p in s.feed(text[i : i + n])] + list(s.finish())
        assert tuple("".join(t for k, t in out if k == kind) for kind in ("think", "answer")) == want


def test_streams(spark, tmp_path):
    deltas = spark.createDataFrame([(1, i, c, i == 17) for i, c in enumerate("<think>a</think>bc")] + [(2, 0, "hi", True)], "request_id long, seq long, delta string, last boolean")
    deltas.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(deltas.schema).parquet(str(tmp_path / "in"))
    query = split_stream(stream).writeStream.format("memory").queryName("parts").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    got = {}
    for r in spark.table("parts").collect():
        got[r["request_id"], r["kind"]] = got.get((r["request_id"], r["kind"]), "") + r["text"]
    assert got == {(1, "think"): "a", (1, "answer"): "bc", (2, "answer"): "hi"}
    lines = spark.createDataFrame([("data: {}",), (": note",), ("data: [DONE]",)], "value string")
    assert [r["data"] for r in sse_data(lines).collect()] == ["{}"]


def test_event_windows_agree_on_streams(spark, tmp_path):
    rows = spark.sql("SELECT id AS event_id, timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id * 7) AS ts, id % 3 AS user_id, 'a' AS event_type, 1.0D AS value FROM range(100)")
    rows.coalesce(1).write.parquet(str(tmp_path / "ev"))
    stream = events.read_events(spark, str(tmp_path / "ev"), rows.schema)
    query = events.tumbling(stream).writeStream.format("memory").queryName("win").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    key = lambda df: sorted((r["start"], r["n"]) for r in df.collect())
    assert key(spark.table("win")) == key(events.tumbling(rows))
    assert sum(r["n"] for r in events.sessions(rows).collect()) == 100
