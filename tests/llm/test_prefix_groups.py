"""Prefix groups of the n-gram join: one shuffle of the postings, pairs of small groups without bitmaps."""

import random
from collections import Counter
from itertools import combinations

from tessella.llm import ngram_join


def test_groups_are_told_apart_over_batches(spark):
    rng = random.Random(8)
    groups = {t: rng.sample(range(500), n) for t, n in enumerate([1, 2, 16, 17, 3, 40, 1, 5, 16, 100, 2] * 4)}
    postings = spark.createDataFrame([(t, i) for t, of in groups.items() for i in of], "token long, nid long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = ngram_join._members(postings).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    pairs = Counter((r["a"], r["b"]) for r in rows if r["b"] is not None)
    assert pairs == Counter(p for of in groups.values() if len(of) <= 16 for p in combinations(sorted(of), 2))
    members = sorted((r["token"], r["a"], r["size"]) for r in rows if r["b"] is None)
    assert members == sorted((t, i, len(of)) for t, of in groups.items() if len(of) > 16 for i in of)


def test_postings_are_shuffled_once_and_small_groups_without_bitmaps(spark, monkeypatch):
    rng, plans, sent = random.Random(9), [], []
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(120))
    docs = [text() for _ in range(60)]
    # three copies each, one word changed: groups of four at most
    docs += [" ".join(w if i != 7 * k else "other" for i, w in enumerate(t.split())) for t in docs for k in (1, 2, 3)]

    def written(df, name, of=ngram_join.written):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return of(df, name)

    def searched(members, *more, of=ngram_join._searched):
        sent.append(members.count())
        return of(members, *more)

    monkeypatch.setattr(ngram_join, "written", written)
    monkeypatch.setattr(ngram_join, "_searched", searched)
    got = ngram_join.similar_classes(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), words=4, percent=85).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: i if i < 60 else (i - 60) // 3 for i in range(240)}
    assert [p.count("Exchange hashpartitioning(token") for name, p in plans if name == "members"] == [1]
    assert sent and not any(sent)
