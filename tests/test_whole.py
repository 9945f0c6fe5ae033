"""Registered queries against brute force, where their SQL makes a cut or there is none."""

import random
import re
from collections import Counter

import pytest

import __spark_entry__
from tessella.operators import dedup, rank

TOKEN = re.compile(r"[a-zA-Z][a-zA-Z0-9_+#.-]*|\d+(?:\.\d+)?")


@pytest.fixture
def run(spark, tmp_path):
    """Rows of a query over tables given as (rows, schema)."""

    def of(query, **tables):
        for name, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return __spark_entry__.queries()[query](spark, str(tmp_path)).collect()

    return of


def test_search_texts_hold_every_token(run):
    docs = [(1, "word " * 60 + "Last 4.5", "en", "src1"), (2, "short one", "de", "src2"), (3, "", "fr", "src3"), (4, "x" * 500 + " tail", "en", "src4")]
    got = {r["doc_id"]: r["search_text"] for r in run("search_texts", documents=(docs, "doc_id long, text string, lang string, source string"))}
    assert got == {i: " ".join(TOKEN.findall("\n".join(v for v in (source, lang, text) if v).lower())) for i, text, lang, source in docs}


def test_neighbor_expand_reaches_every_conversation(run):
    turns = {conv: range(conv % 4 + 1) for conv in range(12)}
    rows = [(conv, turn, "user", "hi") for conv, places in turns.items() for turn in places]
    got = run("neighbor_expand", conversations=(rows, "conv_id long, turn int, role string, text string"))
    want = {(conv % 5, conv * 1000 + turn) for conv, places in turns.items() if 1 in places for turn in (0, 2) if turn in places}
    assert len(got) == len(want) and {(r["query_id"], r["chunk_id"]) for r in got} == want and {r["score"] for r in got} == {0.95}


@pytest.mark.parametrize("query", ["tok_ascii_tf", "doc_freq"])
def test_rare_tokens_are_counted(run, query):
    docs = [(i, "common word" + " twice twice" * (i < 6) + f" only{i}", f"src{i % 2}") for i in range(12)]
    fields = {i: [text, source] if query == "doc_freq" else [text] for i, text, source in docs}
    tokens = [(i, t) for i, texts in fields.items() for text in texts for t in TOKEN.findall(text.lower())]
    docs_of = Counter(t for _, t in set(tokens))
    want = docs_of if query == "doc_freq" else {t: (n, docs_of[t]) for t, n in Counter(t for _, t in tokens).items()}
    rows = run(query, documents=(docs, "doc_id long, text string, source string"))
    assert len(rows) == len(want) and {r["token"]: r["df"] if query == "doc_freq" else (r["tf"], r["docs"]) for r in rows} == want


def test_greedy_dedup_goes_on_behind_many_copies(run):
    copies = [(i, "the nation of the", "en", "src0") for i in range(80)]
    others = [(100 + i, "the nation of the " + f"filler{i} " * (3 + i), "en", f"src{1 + i // 3}") for i in range(30)]
    rows = run("greedy_dedup", documents=(copies + others, "doc_id long, text string, lang string, source string"))
    first = [r["chunk_id"] for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])) if r["query_id"] == 1]
    assert first == [0, 100]  # the rest share a title


def test_rounds_of_a_pool_choose_what_one_group_does(spark):
    rng = random.Random(3)
    data = [(q, i, i % 2, float(rng.randrange(40)), f"{rng.choice(['', 'a program', 'b', None])}{rng.choice(['', i])}", rng.choice([f"http://h/{i // 4}", "", None]), f"p{i % 9}", rng.choice([f"text {i % 11}", None])) for q in (1, 2, 3) for i in range(60)]
    hits = spark.createDataFrame(data, "query_id long, chunk_id long, chunk_index int, score double, title string, url string, path string, text string")
    for k in (3, 8):
        want = sorted((r["query_id"], r["rank"], r["chunk_id"]) for r in dedup.greedy_diverse(hits, k).collect())
        assert want and sorted((r["query_id"], r["rank"], r["chunk_id"]) for r in dedup.greedy_diverse(hits, k, pool=2).collect()) == want


@pytest.mark.parametrize("query", ["rrf_fusion", "bm25f_topk"])
def test_searches_cut_each_text_once(run, monkeypatch, query):
    cut, of = [], rank.tokens
    monkeypatch.setattr(rank, "tokens", lambda c, wide=False: cut.append(c) or of(c, wide))
    docs = [(1, "the nation of the", "en", "src1"), (2, None, "de", "src2"), (3, "der und die die", "fr", "src3"), (4, "", "en", "src4")]
    rows = run(query, documents=(docs, "doc_id long, text string, lang string, source string"))
    assert cut.count("text") == 1 and {(r["query_id"], r["chunk_id"], r["rank"]) for r in rows} == {(1, 1, 1), (5, 3, 1)}


def test_solid_characters_behind_any_white_space(spark):
    texts = [None, "", " \t", "a b" * 10, " " * 90 + "tail of the text", "x" * 30, "é 　日 " * 9, "ab" + " " * 50 + "cdefghijkl"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "text string").select(dedup.solid("text", 8)).collect()]
    assert got == [t if t is None else re.sub(r"\s+", "", t)[:8] for t in texts]
