"""Repeated ids, and scripts without spaces."""

from tessella.llm.decontaminate import contamination
from tessella.llm.ngram_join import one_of_each


def test_near_duplicates_keep_each_text_of_a_repeated_id(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    rows = [(3, text(3)), (5, text(3)), (5, text(5)), (6, None), (6, text(6)), (7, text(7)), (7, text(7)), (None, text(7))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = one_of_each(docs).collect()
    want = [(3, text(3)), (5, text(5)), (6, None), (6, text(6)), (7, text(7)), (None, text(7))]
    assert sorted(map(repr, map(tuple, kept))) == sorted(map(repr, want))


def test_items_in_a_script_without_spaces_are_found(spark):
    item = "机器学习课程的先修要求是线性代数与概率论"
    docs = spark.createDataFrame([(1, f"本页说明{item}以及其他内容"), (2, "本页只谈图书馆的开放时间和借阅规则"), (3, None)], "doc_id long, text string")
    got = contamination(docs, spark.createDataFrame([(9, item)], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["item_id"], r["item_tokens"], r["coverage"]) for r in got] == [(1, 9, len(item), 1.0)]
