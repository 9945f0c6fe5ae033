"""Quality rules as a short-circuit cascade (operator 6), in DataFrame and SQL functions only.

Each rule is a condition that rejects a document. On a sample of the table every rule's cost and
selectivity are estimated in one job: its selectivity is the share of the rows that it rejects,
its cost the mean work it says it does on a row (``Rule.work``: 1 for arithmetic on counts, and
the characters it goes over for patterns). The rules are then evaluated in the order of
rejections per cost inside one CASE, so that a document meets no rule after the one that rejects
it. The order changes costs only: the verdict is the same in any order. Nothing is timed, so a
table always gives the same order.

There is one scan and no shuffle, besides the scan that takes the sample. Repeated three-word
windows are found inside a row: each window is a number of hash bits above its place, so
repetitions are neighbours after one sort of numbers, and only those are compared as words. A
text in which two windows share the hash bits and not the words, or of more words than a place
has bits, has its windows sorted as text.

Defined cases: null text has no words, so it fails the base rule; a text of any length is
measured whole; repeated rows are judged alike; an empty table gives an empty result and
the rules keep their given order; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, share_for, unit_hash

#: The bits of a window's number that are its place, all set.
_PLACES = (1 << 22) - 1
#: White space between words: space and U+0009 to U+000D.
_WS = r"[\\x20\\x09-\\x0D]"


@dataclass(frozen=True)
class Rule:
    """``rejects``: SQL over ``text, words, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words``; ``work``: SQL for what that costs."""

    name: str
    rejects: str
    work: str = "1"


#: Thresholds leave ordinary prose alone: see the rule's name for what it is after.
RULES = (
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 15 * n_words"),
    Rule("dup_lines", "n_lines >= 4 AND 2 * n_dup_lines > n_lines"),
    Rule("shouting", "2 * regexp_count(text, '\\\\p{Lu}') > regexp_count(text, '\\\\p{L}')", "1 + 2 * length(text)"),
    Rule("few_letters", "2 * regexp_count(text, '\\\\p{L}') < word_chars", "1 + length(text)"),
    Rule("ellipses", f"10 * size(filter(split(text, '\\n'), x -> rtrim(x) LIKE '%...' OR rtrim(x) LIKE '%…')) > 5 * n_lines AND n_lines >= 4", "1 + 3 * length(text)"),
    Rule("bullets", "10 * size(filter(split(text, '\\n'), x -> ltrim(x) rlike '^[-*•]')) > 9 * n_lines AND n_lines >= 8", "1 + 2 * length(text)"),
)


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id, text, words`` and the base counts of each row."""
    trimmed = F.expr(rf"regexp_replace(coalesce(text, ''), '^{_WS}+|{_WS}+$', '')")
    words = docs.withColumn("trimmed", trimmed).withColumn("words", F.expr(rf"if(trimmed = '', cast(array() as array<string>), split(trimmed, '{_WS}+'))"))
    lines = F.expr(rf"filter(split(coalesce(text, ''), '\\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')")
    first = words.select("doc_id", F.expr("coalesce(text, '')").alias("text"), "words", F.size("words").cast("long").alias("n_words"), lines.alias("lines"))
    window = f"xxhash64(words[i], words[i + 1], words[i + 2]) & ~{_PLACES}L | i"
    second = first.withColumn("places", F.expr(f"if(size(words) BETWEEN 3 AND {_PLACES}, sort_array(transform(sequence(0, size(words) - 3), i -> {window})), array())"))
    # those that have the hash bits of a neighbour
    alike = f"filter(places, (x, i) -> i > 0 AND x | {_PLACES}L = get(places, i - 1) | {_PLACES}L OR x | {_PLACES}L = coalesce(get(places, i + 1), -1 - x) | {_PLACES}L)"
    third = second.withColumn("met", F.expr(f"transform({alike}, x -> struct(x | {_PLACES}L AS bits, cast(x & {_PLACES}L AS int) AS i))"))
    same = "words[met[k].i] = words[met[k - 1].i] AND words[met[k].i + 1] = words[met[k - 1].i + 1] AND words[met[k].i + 2] = words[met[k - 1].i + 2]"
    fourth = third.withColumn("told", F.expr(f"size(words) <= {_PLACES} AND (size(met) = 0 OR forall(sequence(1, greatest(size(met) - 1, 1)), k -> met[k].bits <> met[k - 1].bits OR {same}))"))
    as_text = "array_sort(transform(sequence(0, size(words) - 3), i -> struct(concat_ws(' ', words[i], words[i + 1], words[i + 2]) AS w, i)))"
    fifth = fourth.withColumn("placed", F.expr(f"if(told, null, {as_text})"))
    sixth = fifth.withColumn("starts", F.expr("if(told, transform(met, x -> x.i), transform(filter(placed, (x, k) -> k > 0 AND x.w = get(placed, k - 1).w OR x.w = get(placed, k + 1).w), x -> x.i))"))
    return sixth.select(
        "doc_id",
        "text",
        "words",
        "n_words",
        F.expr(rf"cast(length(text) - regexp_count(text, '{_WS}') as long)").alias("word_chars"),
        F.expr("cast(regexp_count(text, '[#*$%&|<>]') as long)").alias("n_symbols"),
        F.expr("cast(size(lines) as long)").alias("n_lines"),
        F.expr("cast(size(lines) - size(array_distinct(lines)) as long)").alias("n_dup_lines"),
        F.expr("cast(coalesce(size(array_distinct(concat(starts, transform(starts, i -> i + 1), transform(starts, i -> i + 2)))), 0) as long)").alias("n_repeat_words"),
    )


def _failed(min_words: int, most_repeated: int):
    return F.expr(f"n_words < {min_words} OR 100 * n_repeat_words > {most_repeated} * n_words")


def order_rules(docs: DataFrame, rules: Sequence[Rule], sample_rows: int, min_words: int = 50, most_repeated: int = 50) -> list[Rule]:
    """``rules`` by rejections per cost on about ``sample_rows`` rows, taken by a hash from all of the table, of those that pass the base rule."""
    share = share_for(sample_rows, docs.count())
    # no filter on counts: it would be pushed below the columns it is made of, and they be evaluated within each other
    sample = measured(docs.filter(unit_hash("doc_id", "text") < share)).withColumn("passed", ~_failed(min_words, most_repeated))
    sums = [x for r in rules for x in (F.count_if(F.col("passed") & F.expr(r.rejects)), F.coalesce(F.sum(F.when(F.col("passed"), F.expr(r.work).cast("double"))), F.lit(0.0)))]
    got = sample.agg(*[x.alias(f"x{i}") for i, x in enumerate(sums)]).first()
    order = sorted(range(len(rules)), key=lambda k: (-got[2 * k] / max(got[2 * k + 1], 1.0), k))
    return [rules[k] for k in order]


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = RULES, min_words: int = 50, most_repeated: int = 50, sample_rows: int = 500) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept`` for each row."""
    docs = pick(docs, id_col, text_col)
    ordered = order_rules(docs, rules, sample_rows, min_words, most_repeated)
    base = measured(docs).withColumn("base_failed", _failed(min_words, most_repeated))
    verdict = F.when(F.col("base_failed"), F.lit(False))
    for rule in ordered:
        verdict = verdict.when(F.expr(rule.rejects), F.lit(False))
    return base.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", verdict.otherwise(F.lit(True)).alias("kept"))
