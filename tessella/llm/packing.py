"""Packing token sequences by vector bin packing (operator 7).

A sequence has three limits at once: tokens, segments (pieces of documents, each with its own
attention block) and loss-bearing tokens. Bins are filled one after the other: of the waiting
examples that fit in every dimension, the one with the largest dot product of its demand and
the bin's remaining capacity goes in (each dimension in units of its limit). When none fits
whole, or one segment is left, the longest example is cut so that the bin becomes full.

Packing happens inside each input partition, in one streaming pass without a shuffle: the
waiting pool is bounded in examples and tokens, and what is left at the end of a partition is
cut into sequences whose lengths are powers of two, which need no padding. Partitions are
independent and deterministic, so a lost executor's tasks yield the same sequences again.

Defined cases: a null or empty text is a document of its end token alone; documents of any
length are cut over as many sequences as they need; repeated rows and repeated or null ids are
documents of their own; an empty table gives no sequences; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import bounded_batches, ids, in_batches
from .pretokens import PreTokenizer

#: Pre-tokens whose ids a task remembers; the memory is emptied when it is full.
_REMEMBERED = 400_000


class TokenIds(dict):
    """Pre-token to its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, cut: PreTokenizer):
        super().__init__()
        self.cut = cut

    def __missing__(self, token: str) -> bytes:
        if len(self) >= _REMEMBERED:
            self.clear()
        out = self[token] = np.asarray(self.cut.ids(token), "<u4").tobytes()
        return out

    def of(self, text: str | None) -> bytes:
        return b"".join([self[t] for t in self.cut.tokens(text)]) if text else b""


class Packer:
    """Greedy vector bin packing of one stream of examples. ``add`` and ``finish`` yield filled sequences.

    A sequence is a list of pieces ``(key, start, length, example)``; ``start`` counts from the example's first token.
    An example's first ``free`` tokens bear no loss (a prompt), all others do.
    """

    def __init__(self, max_tokens: int, max_segments: int, max_loss: int, pool: int = 1024, pool_tokens: int = 4_000_000):
        self.caps = np.array([max_tokens, max_segments, max_loss], float)
        self.pool, self.pool_tokens = pool, pool_tokens
        self.keys: list = [None] * (pool + 1)
        self.start = np.zeros(pool + 1, np.int64)
        self.left = np.zeros(pool + 1, np.int64)  # tokens not yet placed; 0: a free place
        self.free = np.zeros(pool + 1, np.int64)  # of those, the leading ones without loss
        self.spare = list(range(pool, -1, -1))
        self.held = 0

    def add(self, key, length: int, free: int = 0) -> Iterator[list]:
        k = self.spare.pop()
        self.keys[k], self.start[k], self.left[k], self.free[k] = key, 0, length, min(free, length)
        self.held += length
        while not self.spare or self.held > self.pool_tokens:
            yield self._fill(int(self.caps[0]))

    def finish(self) -> Iterator[list]:
        while self.held:
            most = int(self.caps[0])
            yield self._fill(most if self.held >= most else 1 << (self.held.bit_length() - 1))

    def _take(self, k: int, n: int) -> tuple:
        piece = (self.keys[k], int(self.start[k]), n)
        self.start[k] += n
        self.left[k] -= n
        self.free[k] = max(0, self.free[k] - n)
        self.held -= n
        if not self.left[k]:
            self.keys[k] = None
            self.spare.append(k)
        return piece

    def _fill(self, tokens: int) -> list:
        pieces, room = [], np.array([tokens, self.caps[1], self.caps[2]])
        while room[0] > 0 and room[1] > 0 and self.held:
            left, loss = self.left, self.left - self.free
            fits = (left > 0) & (left <= room[0]) & (loss <= room[2])
            if room[1] > 1 and fits.any():
                weight = room / self.caps / self.caps
                score = np.where(fits, left * weight[0] + weight[1] + loss * weight[2], -1.0)
                k = int(score.argmax())
                n = int(left[k])
            else:
                k = int(left.argmax())
                n = int(min(left[k], room[0], self.free[k] + room[2]))
                if n <= 0:
                    break
            lost = max(0, n - int(self.free[k]))
            pieces.append(self._take(k, n))
            room -= (n, 1, lost)
        return pieces


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    prompt_col: str | None = None,
    end_id: int | None = 2,
    max_tokens: int = 4096,
    max_segments: int = 512,
    max_loss_tokens: int | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, loss_tokens, sequence_id, offset`` (and ``ids``).

    ``prompt_col`` names a text whose tokens come first and bear no loss; without it every token bears loss.
    """
    chosen = bounded_batches(docs).select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"), *([docs[prompt_col].cast("string").alias("prompt")] if prompt_col else []))
    long = [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "loss_tokens", "sequence_id", "offset")]
    schema = T.StructType([T.StructField("doc_id", chosen.schema["doc_id"].dataType), *long, *([T.StructField("ids", T.BinaryType())] if with_ids else [])])
    arrow = to_arrow_schema(schema)
    end = b"" if end_id is None else np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = TokenIds(PreTokenizer(tokenizer_path))
        packer = Packer(max_tokens, max_segments, max_loss_tokens or max_tokens)
        number = iter(range(TaskContext.get().partitionId() << 33, 1 << 62))

        def out(sequence: list) -> Iterator[tuple]:
            sequence_id, offset = next(number), 0
            for (doc_id, data, free), start, n in sequence:
                part = data[4 * start : 4 * (start + n)]
                yield doc_id, start, n, zlib.crc32(part), len(data) // 4, n - min(n, max(0, free - start)), sequence_id, offset, *([part] if with_ids else [])
                offset += n

        def rows() -> Iterator[tuple]:
            for batch in batches:
                text, prompt = batch.column(1), batch.column(2) if prompt_col else None
                for i, doc_id in enumerate(ids(batch)):
                    before = known.of(prompt[i].as_py()) if prompt_col else b""
                    data = before + known.of(text[i].as_py()) + end
                    if data:
                        for sequence in packer.add((doc_id, data, len(before) // 4), len(data) // 4, len(before) // 4):
                            yield from out(sequence)
            for sequence in packer.finish():
                yield from out(sequence)

        yield from in_batches(rows(), arrow)

    return chosen.mapInArrow(run, schema)
