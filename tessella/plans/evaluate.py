"""Running a test set end to end: search, context, model, score, with each item's latency."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import answer_form
from ..operators import evaluate
from .search import HybridIndex


def selected(items: DataFrame, ids: Sequence[str] = (), offset: int = 0, limit: int | None = None) -> DataFrame:
    """Items of the given ids (all if none), a slice of them in order of id; an id that no item has is an error."""
    wanted = list(dict.fromkeys(ids))
    if wanted:
        known = {r["id"] for r in items.filter(F.col("id").isin(wanted)).select("id").collect()}
        if lost := [x for x in wanted if x not in known]:
            raise ValueError(f"unknown ids: {', '.join(lost)}")
        items = items.filter(F.col("id").isin(wanted))
    out = items.orderBy("id").offset(offset)
    return out if limit is None else out.limit(limit)


def run_items(index: HybridIndex, items: DataFrame, answer: Callable[[str, str], str]) -> DataFrame:
    """``id, sys_answer, correct, seconds, error``: a test set (some hundred questions) asked one by one, as a user would; ``answer`` maps question and context to an answer."""
    spark, rows = items.sparkSession, []
    for r in items.select("id", "query").collect():  # a test set is written by hand, so it fits the driver
        began, text, error = time.perf_counter(), "", ""
        try:
            hits = index.search(spark.createDataFrame([(0, r["query"])], "query_id long, query string"))
            found = index.contexts(hits).first()
            text = answer(r["query"], found["context"] if found else "")
        except Exception as problem:  # one item's failure is its own result
            error = f"{type(problem).__name__}: {problem}"
        rows.append((r["id"], text, time.perf_counter() - began, error))
    answers = spark.createDataFrame(rows, "id string, sys_answer string, seconds double, error string")
    joined = items.withColumn("id", F.col("id").cast("string")).join(answers, "id").withColumn("form", answer_form("sys_answer"))
    return joined.select("id", "sys_answer", evaluate.score("sys_answer", "form", "eval_type", "targets").alias("correct"), "seconds", "error")


def report(results: DataFrame, by: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Accuracy (overall and by each column) and latency."""
    return {"overall": evaluate.accuracy(results, "correct"), "latency": evaluate.latency(results, "seconds")} | {c: evaluate.accuracy(results, "correct", [c]) for c in by}
