"""Line dedup with two Bloom filters (operator 3).

One pass sets bits for line keys seen in one document and for those seen in two; the filters of
all tasks are merged bit by bit, segment by segment, on the executors. Only keys that the
second filter suspects are shuffled, as sums already made in each task, and counted exactly.
Bloom filters have no false negatives and the count is exact, so their size changes costs and
never results: when a corpus overfills them, more keys are counted.

The filters have ten bits or more for each line of the table, counted before, but no more than
``most_log2_bits`` name (32 MB each), so what is broadcast and what tasks hold is bounded; beyond
that size more keys are suspected. The tasks that build them are bounded too (``filter_tasks``).
The repeated keys are broadcast when they are few (checked). Otherwise the most frequent of them
are, and the rest, which no line of many documents is among, is joined by key. A key of more
than 64 bytes travels as a digest.

Defined cases: a null or empty text is one empty line (its key has no code points, so it
stays); lines and texts of any length are whole; a row is a document, so repeated rows and
repeated or null ids count each; an empty table gives an empty result; other columns are
ignored. With ``keep="first"`` the first occurrence (least id, then line) stays.
"""

from __future__ import annotations

import hashlib
from collections import ChainMap
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import bounded_batches, ids, in_batches, scratch_path, written
from .frequent import heaviest

#: Bits of a filter that travel together.
_SEGMENT = 1 << 19
_PROBES = 4
#: Repeated keys, and their bytes, that may be broadcast.
MOST_KEYS, MOST_KEY_BYTES = 500_000, 64_000_000
_HELD = 200_000


def keys_of(text: str | None) -> tuple[list[bytes], list[bytes]]:
    """Lines, as UTF-8, and their keys: ``[ \\t-\\r]`` stripped at both ends (what bytes.strip strips), A-Z lower-cased."""
    lines = (text or "").encode().split(b"\n")
    return lines, [x.strip().lower() for x in lines]


def _short(key: bytes) -> bytes:
    """A key, or a digest in its place that begins like no key does."""
    return key if len(key) <= 64 else b"\xff" + hashlib.blake2b(key, digest_size=32).digest()


class Bits:
    """A Bloom filter's bits; ``add`` and ``test`` take arrays of 64-bit hashes."""

    def __init__(self, log2_bits: int, data: np.ndarray | None = None):
        self.mask = np.uint64((1 << log2_bits) - 1)
        self.data = np.zeros(1 << log2_bits >> 3, np.uint8) if data is None else data

    def _at(self, hashes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        step = (hashes >> np.uint64(32)) | np.uint64(1)
        for i in range(_PROBES):
            bit = (hashes + np.uint64(i) * step) & self.mask
            yield (bit >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (bit & np.uint64(7)).astype(np.uint8))

    def add(self, hashes: np.ndarray) -> None:
        for byte, bit in self._at(hashes):
            np.bitwise_or.at(self.data, byte, bit)

    def test(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for byte, bit in self._at(hashes):
            out &= (self.data[byte] & bit) != 0
        return out


def repeat_filter(docs: DataFrame, log2_bits: int, filter_tasks: int) -> np.ndarray:
    """The bits of keys that two documents at least may have."""
    segment = min(_SEGMENT, 1 << log2_bits) >> 3
    schema = "segment int, once binary, twice binary"
    arrow = pa.schema([("segment", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = Bits(log2_bits), Bits(log2_bits)

        def put(found: list[int]) -> None:
            hashes, n = np.unique(np.array(found, np.uint64), return_counts=True)
            twice.add(hashes[(n > 1) | once.test(hashes)])
            once.add(hashes)

        found: list[int] = []
        for batch in batches:
            for text in batch.column(0):
                found += [xxhash.xxh64_intdigest(k) for k in {*keys_of(text.as_py())[1]} if k]
                if len(found) > _HELD:
                    put(found)
                    found = []
        if found:
            put(found)
        parts = ((i, once.data[i * segment : (i + 1) * segment], twice.data[i * segment : (i + 1) * segment]) for i in range(len(once.data) // segment))
        yield from in_batches(((i, a.tobytes(), b.tobytes()) for i, a, b in parts if a.any()), arrow, 16)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for i, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
                if i in held:
                    once, twice = held[i]
                    twice |= b | (once & a)
                    once |= a
                else:
                    held[i] = a.copy(), b.copy()
        yield from in_batches(((i, b"", b.tobytes()) for i, (_, b) in held.items()), arrow, 16)

    tasks = docs.rdd.getNumPartitions()
    texts = docs.select("text").coalesce(filter_tasks) if tasks > filter_tasks else docs.select("text")
    count = (1 << log2_bits >> 3) // segment
    merged = texts.mapInArrow(build, schema).repartition(min(count, 32), "segment").mapInArrow(merge, schema).select("segment", "twice").toArrow()
    bits = np.zeros(1 << log2_bits >> 3, np.uint8)
    for i, b in zip(merged.column(0).to_pylist(), merged.column(1).to_pylist(), strict=True):
        bits[i * segment : (i + 1) * segment] = np.frombuffer(b, np.uint8)
    return bits


def _bits_for(docs: DataFrame, least: int, most: int) -> int:
    """log2 of the bits of a filter for all lines of ``docs``."""
    n = docs.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    return min(most, max(least, (10 * n).bit_length()))


def repeated_keys(docs: DataFrame, min_docs: int, min_chars: int, log2_bits: int, filter_tasks: int) -> DataFrame:
    """``key`` (as ``_short`` gives it), ``n_docs, first_id, first_line`` of the keys in at least ``min_docs`` rows of ``docs``; written once."""
    known = docs.sparkSession.sparkContext.broadcast(repeat_filter(docs, log2_bits, filter_tasks))
    schema = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("first", T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("line", T.IntegerType())]))])
    arrow = to_arrow_schema(schema)

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = Bits(log2_bits, known.value)
        held: dict[bytes, list] = {}

        def out() -> Iterator[pa.RecordBatch]:
            yield from in_batches(((k, n, {"doc_id": d, "line": i}) for k, (n, d, i) in held.items()), arrow)
            held.clear()

        def count(found: list) -> Iterator[pa.RecordBatch]:
            hit = twice.test(np.array([xxhash.xxh64_intdigest(k) for k, _, _ in found], np.uint64))
            for (k, doc_id, line), yes in zip(found, hit.tolist(), strict=True):
                if not yes:
                    continue
                k = _short(k)
                old = held.get(k)
                if old is None:
                    held[k] = [1, doc_id, line]
                else:
                    old[0] += 1
                    if doc_id is not None and (old[1] is None or (doc_id, line) < (old[1], old[2])):
                        old[1:] = doc_id, line
            if len(held) > _HELD:
                yield from out()

        found: list = []
        for batch in batches:
            for doc_id, text in zip(ids(batch), batch.column(1), strict=True):
                first: dict[bytes, int] = {}
                for i, k in enumerate(keys_of(text.as_py())[1]):
                    if k and k not in first:
                        first[k] = i
                found += [(k, doc_id, i) for k, i in first.items() if min_chars < 2 or len(k.decode()) >= min_chars]
                if len(found) > _HELD:
                    yield from count(found)
                    found = []
        if found:
            yield from count(found)
        yield from out()

    keys = docs.mapInArrow(suspects, schema).groupBy("key").agg(F.sum("n").alias("n_docs"), F.min(F.when(F.col("first.doc_id").isNotNull(), F.col("first"))).alias("first"))
    keys = keys.filter(F.col("n_docs") >= min_docs).select("key", "n_docs", F.col("first.doc_id").alias("first_id"), F.col("first.line").alias("first_line"))
    keys = written(keys, "repeated-lines")
    known.destroy()
    return keys


def line_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_docs: int = 10,
    min_chars: int = 1,
    keep: str = "none",
    log2_bits: int | None = None,
    filter_tasks: int = 2048,
    most_keys: int = MOST_KEYS,
    most_key_bytes: int = MOST_KEY_BYTES,
    carry: Sequence[str] = (),
    most_log2_bits: int = 28,
) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_sha256, kept_text`` for each row; the columns ``carry`` stay with it, in a struct ``carried``.

    A line goes if its key has at least ``min_chars`` code points and is in at least ``min_docs`` documents;
    ``keep="first"`` spares its first occurrence (rows with a null id only follow others).
    """
    carried = F.struct(*[docs[c] for c in carry]) if carry else F.lit(0)
    whole = bounded_batches(docs).select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"), carried.alias("carried"))
    docs = whole.select("doc_id", "text")
    first = {"none": False, "first": True}[keep]
    keys = repeated_keys(docs, min_docs, min_chars, log2_bits or _bits_for(docs, 20, most_log2_bits), filter_tasks)
    n, size = keys.agg(F.count("*"), F.coalesce(F.sum(F.length("key") + 48), F.lit(0))).first()
    long = [T.StructField(c, T.LongType()) for c in ("n_lines", "n_dropped")]
    schema = T.StructType([docs.schema["doc_id"], *long, T.StructField("kept_sha256", T.StringType()), T.StructField("kept_text", T.StringType())])
    arrow = to_arrow_schema(schema)
    with_carried = T.StructType([*schema, whole.schema["carried"]])

    given = lambda done: done if carry else done.drop("carried")

    def kept(doc_id, lines: list[bytes], drop: list[bool]) -> tuple:
        stay = b"\n".join([x for x, d in zip(lines, drop, strict=True) if not d])
        return doc_id, len(lines), sum(drop), hashlib.sha256(stay).hexdigest(), stay.decode()

    def rewritten(batches: Iterator[pa.RecordBatch], repeats) -> Iterator[pa.RecordBatch]:
        """``repeats(row)``: the repeated keys that concern a row of the batch."""
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                done = next(in_batches((mark(d, t.as_py(), repeats(part, i)) for i, (d, t) in enumerate(zip(ids(part), part.column(1), strict=True))), arrow, 512))
                yield pa.RecordBatch.from_arrays([*done.columns, part.column(2)], names=[*arrow.names, "carried"])

    def mark(doc_id, text: str | None, repeats: dict) -> tuple:
        lines, keys = keys_of(text)
        if first:
            seen = set()
            drop = []
            for i, k in enumerate(keys):
                k = _short(k)
                at = repeats.get(k)
                # a first occurrence that several rows with one id share stays in each of them
                drop.append(at is not None and (at != (doc_id, i) or k in seen))
                seen.add(k)
        else:
            drop = [_short(k) in repeats for k in keys]
        return kept(doc_id, lines, drop)

    few = n <= most_keys and size <= most_key_bytes
    # what is broadcast: all, or as many of the most frequent as the bounds allow (a key has 65 bytes at most)
    got = (keys if few else heaviest(keys, "n_docs", min(most_keys, most_key_bytes // 113))).select("key", "first_id", "first_line").toArrow()
    known = docs.sparkSession.sparkContext.broadcast({k: (d, i) for k, d, i in zip(*(c.to_pylist() for c in got.columns), strict=True)})
    if few:
        return given(whole.mapInArrow(lambda batches: rewritten(batches, lambda part, i: known.value), with_carried))

    # Too many to broadcast: join lines with the other repeated keys, and each document with its own few.
    path = scratch_path(docs.sparkSession, "lines-numbered")
    whole.withColumn("row", F.monotonically_increasing_id()).write.parquet(path)
    numbered = docs.sparkSession.read.parquet(path)
    pair = "row long, key binary"

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("row", pa.int64()), ("key", pa.binary())])
        for batch in batches:
            yield from in_batches(((r, k) for r, t in zip(ids(batch, "row"), batch.column(1), strict=True) for k in map(_short, {*keys_of(t.as_py())[1]}) if k and k not in known.value), out)

    hits = numbered.select("row", "text").mapInArrow(explode, pair).join(keys, "key").groupBy("row").agg(F.collect_list(F.struct("key", "first_id", "first_line")).alias("hits"))
    joined = numbered.join(hits, "row", "left").select("doc_id", "text", "carried", "hits")

    own = lambda part, i: ChainMap({h["key"]: (h["first_id"], h["first_line"]) for h in part.column(3)[i].as_py() or ()}, known.value)
    return given(joined.mapInArrow(lambda batches: rewritten(batches, own), with_carried))
