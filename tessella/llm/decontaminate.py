"""Benchmark decontamination by greedy string tiling (operator 2).

A document is suspected where it shares a run of ``min_match`` tokens (a seed) with a test
item. For each suspected pair the longest common runs that no tile covers yet are marked as
tiles, longest first, found by running Karp-Rabin hashes, until none of ``min_match`` tokens is
left. Tiles may lie in any order, so passages whose sentences were moved are caught too. The
document is contaminated if tiles cover ``coverage`` or more of the item's tokens.

Seeds of the benchmark are joined inside the scan of the documents: they are broadcast in
blocks of at most about ``block_chars`` characters of items, one scan a block, so any number of
items can be tested; where there are several blocks, each one's findings are written before the
next is broadcast, so that one block at a time is held. Documents are not shuffled, but for
the last step of ``decontaminate`` with several blocks and very many contaminated texts. A pair whose seeds could not reach the
coverage, were all of them tiles, is dropped before tiling; that bound is exact.

Defined cases: null and empty texts match nothing; items of fewer than ``min_match`` tokens
identify nothing and are ignored, but those of ``min_item`` tokens or more match where all of
their tokens follow each other; texts and items of any length are compared whole; repeated
rows are reported each, equal items each under their own id; empty tables give an empty result;
other columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import bounded_batches, fresh, ids, in_batches, pick, written

#: Letters of scripts without spaces, each a token: CJK ideographs and kana.
_SINGLE = "\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_TOKEN = re.compile(rf"[^\W_{_SINGLE}]+|(?![\W_])[{_SINGLE}]")
#: Digests of contaminated texts that may be broadcast.
_MOST_DIGESTS = 500_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall((text or "").lower())


def _rolling(codes: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes, modulo 2**64, of all runs of ``n`` codes; each follows from the prefix hashes in one step."""
    if len(codes) < n:
        return np.zeros(0, np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(codes) * _powers(_BASE, len(codes)), dtype=np.uint64)])
    return (sums[n:] - sums[:-n]) * _powers(_INVERSE, len(codes) - n + 1)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mixed(codes: np.ndarray) -> np.ndarray:
    x = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x * np.uint64(0xD6E8FEB86659FD93)


def tiles(item: np.ndarray, doc: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: ``(place in item, place in doc, length)`` of non-overlapping common runs, longest first.

    Codes below 0 match nothing. Equal lengths: the first in the item, then in the document.
    """
    free_item, free_doc = item >= 0, doc >= 0
    found: list[tuple[int, int, int]] = []
    size = max(min_match, min(len(item), len(doc)) // 2)
    while size >= min_match:
        longest: list[tuple[int, int, int]] = []
        open_item, open_doc = _open(free_item, size), _open(free_doc, size)
        if len(open_item) and len(open_doc):
            h_item, h_doc = _rolling(item, size)[open_item], _rolling(doc, size)[open_doc]
            at = defaultdict(list)
            for p, h in zip(open_item.tolist(), h_item.tolist(), strict=True):
                at[h].append(p)
            hit = np.isin(h_doc, h_item)
            for d, h in zip(open_doc[hit].tolist(), h_doc[hit].tolist(), strict=True):
                for p in at[h]:
                    if p and d and free_item[p - 1] and free_doc[d - 1] and item[p - 1] == doc[d - 1]:
                        continue  # inside a run that began earlier
                    n = 0
                    while p + n < len(item) and d + n < len(doc) and free_item[p + n] and free_doc[d + n] and item[p + n] == doc[d + n]:
                        n += 1
                    if n >= size:
                        longest.append((n, p, d))
        if longest and (top := max(longest)[0]) >= 2 * size:
            size = top  # a run so much longer is to be marked before any other
            continue
        for n, p, d in sorted(longest, key=lambda x: (-x[0], x[1], x[2])):
            if free_item[p : p + n].all() and free_doc[d : d + n].all():
                found.append((p, d, n))
                free_item[p : p + n] = False
                free_doc[d : d + n] = False
        if longest and any(_still(free_item, free_doc, p, d, n, size) for n, p, d in longest):
            continue  # what is left of a run that a tile cut into
        size = size // 2 if size > 2 * min_match else size - 1
    return found


def _open(free: np.ndarray, n: int) -> np.ndarray:
    """Starts of runs of ``n`` free places."""
    if len(free) < n:
        return np.zeros(0, np.int64)
    taken = np.concatenate([[0], np.cumsum(~free)])
    return np.flatnonzero(taken[n:] == taken[:-n])


def _still(free_item: np.ndarray, free_doc: np.ndarray, p: int, d: int, n: int, size: int) -> bool:
    both = free_item[p : p + n] & free_doc[d : d + n]
    return len(_open(both, size)) > 0


class Seeds:
    """The items of a block: their codes, and by seed length and seed hash the items and places that have it."""

    def __init__(self, items: list[tuple], min_match: int, min_item: int | None = None):
        self.code: dict[str, int] = {}
        self.keys, self.codes, of = [], [], defaultdict(lambda: defaultdict(list))
        for key, text in items:
            words = tokens(text)
            if len(words) < max(1, min(min_match, min_item or min_match)):
                continue
            row = np.array([self.code.setdefault(w, len(self.code)) for w in words], np.int64)
            seed = min(min_match, len(row))
            for place, h in enumerate(_rolling(row, seed).tolist()):
                of[seed][h].append((len(self.keys), place))
            self.keys.append(key)
            self.codes.append(row)
        self.of = {n: dict(x) for n, x in of.items()}
        self.hashes = {n: np.sort(np.fromiter(x, np.uint64, len(x))) for n, x in of.items()}

    def matches(self, text: str | None, min_match: int, coverage: float) -> Iterator[tuple]:
        """``(item key, item tokens, matched tokens)`` for each item that the text covers enough."""
        words = tokens(text)
        doc = np.fromiter(map(self.code.get, words, repeat(-1)), np.int64, len(words))
        reach: dict[int, set[int]] = defaultdict(set)
        for seed, hashes in self.hashes.items():
            runs = _open(doc >= 0, seed)
            if not len(runs):
                continue
            h = _rolling(doc, seed)[runs]
            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            for x in np.unique(h[hashes[at] == h]).tolist():
                for k, place in self.of[seed][x]:
                    reach[k].update(range(place, place + seed))
        for k in sorted(reach):
            size = len(self.codes[k])
            if len(reach[k]) >= coverage * size:
                matched = sum(n for _, _, n in tiles(self.codes[k], doc, min(min_match, size)))
                if matched >= coverage * size:
                    yield self.keys[k], size, matched


def _seed_blocks(docs: DataFrame, benchmark: DataFrame, item_col: str, item_text_col: str, min_match: int, min_item: int | None, block_chars: int) -> tuple[int, Iterator]:
    """How many blocks the benchmark has, and their seeds, each broadcast when it is asked for and freed before the next."""
    items = benchmark.select(benchmark[item_col].alias("item_id"), benchmark[item_text_col].cast("string").alias("item")).filter(F.col("item").isNotNull())
    chars = items.agg(F.sum(F.length("item") + 16)).first()[0] or 0
    count = max(1, -(-chars // block_chars))

    def blocks() -> Iterator:
        for k in range(count):
            block = items.filter(F.pmod(F.xxhash64("item_id", "item"), F.lit(count)) == k).orderBy("item_id", "item").toArrow()
            seeds = docs.sparkSession.sparkContext.broadcast(Seeds(list(zip(block.column(0).to_pylist(), block.column(1).to_pylist(), strict=True)), min_match, min_item))
            yield seeds
            if count > 1:
                seeds.destroy()

    return count, blocks()


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_match: int = 5, coverage: float = 0.5, block_chars: int = 4_000_000, min_item: int | None = None) -> DataFrame:
    """``doc_id, item_id, item_tokens, matched_tokens, coverage``: a row for each document and item it contains."""
    docs = pick(docs, id_col, text_col)
    schema = T.StructType([docs.schema["doc_id"], T.StructField("item_id", benchmark.schema[item_col].dataType), T.StructField("item_tokens", T.LongType()), T.StructField("matched_tokens", T.LongType()), T.StructField("coverage", T.DoubleType())])
    arrow = to_arrow_schema(schema)
    count, blocks = _seed_blocks(docs, benchmark, item_col, item_text_col, min_match, min_item, block_chars)
    out: DataFrame | None = None
    for seeds in blocks:

        def scan(batches: Iterator[pa.RecordBatch], seeds=seeds) -> Iterator[pa.RecordBatch]:
            def rows() -> Iterator[tuple]:
                for batch in batches:
                    for doc_id, text in zip(ids(batch), batch.column(1), strict=True):
                        for item, size, matched in seeds.value.matches(text.as_py(), min_match, coverage):
                            yield doc_id, item, size, matched, matched / size

            yield from in_batches(rows(), arrow)

        found = docs.mapInArrow(scan, schema)
        found = found if count == 1 else written(found, "contamination")
        out = found if out is None else out.union(found)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_match: int = 5, coverage: float = 0.5, block_chars: int = 4_000_000, min_item: int | None = None) -> DataFrame:
    """``docs``, with all its columns, without the contaminated rows.

    With several blocks, digests of contaminated texts are what is written; equal texts have one verdict.
    """
    place = bounded_batches(docs).columns.index(text_col)
    count, blocks = _seed_blocks(docs, benchmark, item_col, item_text_col, min_match, min_item, block_chars)
    digest = F.sha2(docs[text_col].cast("string"), 256)
    found: DataFrame | None = None
    for seeds in blocks:

        def tainted(column: pa.Array, seeds=seeds) -> list[bool]:
            return [next(seeds.value.matches(t.as_py(), min_match, coverage), None) is not None for t in column]

        if count == 1:
            return docs.mapInArrow(lambda batches: (b.filter(pa.array([not x for x in tainted(b.column(place))], pa.bool_())) for b in batches), docs.schema)

        def scan(batches: Iterator[pa.RecordBatch], tainted=tainted) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.select([0]).filter(pa.array(tainted(batch.column(1)), pa.bool_()))

        texts = docs.select(digest.alias("digest"), docs[text_col].cast("string").alias("text")).filter(F.col("text").isNotNull())
        some = written(texts.mapInArrow(scan, "digest string").distinct(), "contaminated")
        found = some if found is None else found.union(some)
    known = fresh(docs.columns, "digest")
    found = found.select(F.col("digest").alias(known))
    few = found.count() <= _MOST_DIGESTS
    return docs.join(F.broadcast(found) if few else found, digest == F.col(known), "left_anti")
