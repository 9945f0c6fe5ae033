"""Language identification by cross-parsing entropy (operator 1).

For each language a suffix automaton of labelled text gives, at every position of a document,
how far the text goes on as somewhere in the labelled text. Cutting a document into such
longest matches takes few phrases in its own language and many in others; the language with the
fewest phrases, each weighed by the bits that name its place in that language's text, wins.

The automata are built once on the driver from a bounded sample (``docs_per_lang`` documents,
``train_symbols`` symbols a language) and broadcast as dense transition tables of at most
``table_bytes`` a language. Parsing is numpy code that moves all documents of a batch
through all automata in step. Long texts are parsed in blocks of ``block`` symbols at once, all of
them; a block that does not begin with a phrase is parsed again from the state in which its
predecessor ends, until both parses meet, so the phrases are those of the whole text.

Letters are one symbol each as long as an automaton has room for them (``_WIDTH``); of larger
scripts the most frequent letters are, and the others are two or three symbols. Every letter of
the labelled text is known; what isn't in it is one letter that no language has.

Defined cases: null, empty or letterless text is ``und`` with score 0; without any labelled text
everything is ``und``; ties go to the first language in order; repeated rows are predicted
alike; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import ids, in_batches, pick, share_for, spread, unit_hash

#: Symbols of an automaton: separator, letters, unknown letter. Of the letters' symbols so many begin two, and so many three, where there are more letters.
_WIDTH, _TWO, _THREE = 128, 40, 10
#: Characters of documents that are parsed together.
_BATCH_CHARS = 3_000_000
#: Symbols of a block whose states are kept, for another parse of the block to meet.
_EARLY = 96


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """For every code point: whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


@lru_cache(maxsize=1)
def lower_table() -> np.ndarray:
    """For every code point: its lower-case letter (where that is a single one), 0 for what isn't a letter."""
    out = np.zeros(0x110000, np.uint32)
    for c in np.flatnonzero(letter_table()).tolist():
        low = chr(c).lower()
        out[c] = ord(low) if len(low) == 1 else c
    return out


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the minimal automaton of all substrings of ``symbols``; state 0 is the start."""
    steps: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        new = len(steps)
        steps.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in steps[p]:
            steps[p][c] = new
            p = link[p]
        if p >= 0:
            q = steps[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(steps)
                steps.append(dict(steps[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and steps[p].get(c) == q:
                    steps[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return steps


@dataclass
class Model:
    """``steps[state + symbol]``: (next state << 2) + phrases that end, states being offsets into ``steps``; ``roots`` and ``bits`` by language."""

    langs: list[str]
    code_of: dict[int, int]
    width: int
    steps: np.ndarray
    roots: np.ndarray
    bits: np.ndarray

    def codes(self) -> np.ndarray:
        """Symbols of each code point, the first in the lowest byte: 0 between words, the last for letters that no language has."""
        low = lower_table()
        known = np.zeros(0x110000, np.uint32)
        known[list(self.code_of)] = list(self.code_of.values())
        return np.where(known[low] > 0, known[low], np.where(low > 0, self.width - 1, 0)).astype(np.uint32)


def letter_codes(letters: list[int]) -> dict[int, int]:
    """Symbols (in the bytes of a number) of letters, the most frequent first."""
    most = _WIDTH - 2
    if len(letters) <= most:
        return {c: i + 1 for i, c in enumerate(letters)}
    one = most - _TWO - _THREE
    out = {}
    for i, c in enumerate(letters):
        k = i - one
        if k < 0:
            out[c] = i + 1
        elif k < _TWO * most:
            out[c] = one + 1 + k // most | (1 + k % most) << 8
        else:
            k -= _TWO * most
            out[c] = one + 1 + _TWO + k // most**2 | (1 + k // most % most) << 8 | (1 + k % most) << 16
    return out


def symbols_of(codes: np.ndarray) -> np.ndarray:
    """The symbols of a text from its letters' codes: separators that follow each other are one."""
    s = codes[np.r_[True, (codes[1:] != 0) | (codes[:-1] != 0)]] if len(codes) else codes
    if not len(s) or s.max() < 256:
        return s.astype(np.uint8)
    parts = np.stack([s & 255, s >> 8 & 255, s >> 16], axis=1).astype(np.uint8)
    used = parts > 0
    used[:, 0] = True
    return parts[used]


def fit(samples: dict[str, list[str]], train_symbols: int = 30_000, table_bytes: int = 16_000_000, total_bytes: int = 256_000_000) -> Model:
    """A model of labelled texts by language; its tables have at most ``table_bytes`` a language and ``total_bytes`` together."""
    langs = sorted(k for k, v in samples.items() if any(letter_table()[points(t)].any() for t in v))
    low = {k: [lower_table()[points(t)] for t in samples[k]] for k in langs}
    seen: Counter[int] = Counter()
    for k in langs:
        for a in low[k]:
            seen.update(a[a > 0].tolist())
    code_of = letter_codes([c for c, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))])
    width = min(len(code_of), _WIDTH - 2) + 2
    room = min(table_bytes, total_bytes // max(1, len(langs)))
    kind = np.int32 if len(langs) * room < 1 << 30 else np.int64  # a state and two bits more
    most = min(train_symbols, room // (np.dtype(kind).itemsize * 2 * width))
    known = np.zeros(0x110000, np.uint32)
    known[list(code_of)] = list(code_of.values())
    parts, roots, bits, base = [], [], [], 0
    for k in langs:
        train: list[int] = []
        for a in low[k]:
            if len(train) >= most:
                break
            train += symbols_of(known[a]).tolist() + [0]
        train = train[:most]
        steps = suffix_automaton(train)
        dense = np.full((len(steps), width), -1, np.int64)
        for i, row in enumerate(steps):
            for c, j in row.items():
                dense[i, c] = j
        start = dense[0]
        again = np.where(start >= 0, ((base + start * width) << 2) + 1, (base << 2) + 2)
        out = np.where(dense >= 0, (base + dense * width) << 2, again[None, :])
        out[0] = np.where(start >= 0, (base + start * width) << 2, (base << 2) + 1)
        parts.append(out.astype(kind).ravel())
        roots.append(base)
        bits.append(math.log2(len(train) + 2))
        base += out.size
    return Model(langs, code_of, width, np.concatenate(parts) if parts else np.zeros(0, kind), np.array(roots, kind), np.array(bits))


def phrases(model: Model, symbols: list[np.ndarray], block: int) -> np.ndarray:
    """(document, language): phrases of the greedy parse of each symbol array."""
    lanes = [(d, i, min(block, len(s) - i)) for d, s in enumerate(symbols) for i in range(0, len(s), block)]
    lanes.sort(key=lambda x: -x[2])
    n, langs = len(lanes), len(model.langs)
    out = np.zeros((len(symbols), langs), np.int64)
    if not n or not langs:
        return out
    size = np.array([m for *_, m in lanes])
    longest = int(size[0])
    grid = np.zeros((n, longest), np.uint8)
    for k, (d, i, m) in enumerate(lanes):
        grid[k, :m] = symbols[d][i : i + m]
    grid = np.ascontiguousarray(grid.T)
    active = n - np.searchsorted(size[::-1], np.arange(longest), side="right")
    state = np.repeat(model.roots[None, :], n, axis=0)
    count = np.zeros((n, langs), np.int32)
    lane_of = {(d, i): k for k, (d, i, _) in enumerate(lanes)}
    before = np.array([lane_of.get((d, i - block), -1) for d, i, _ in lanes])
    early: list[tuple[np.ndarray, np.ndarray]] = []
    for t in range(longest):
        k = int(active[t])
        got = model.steps[state[:k] + grid[t, :k, None]]
        count[:k] += got & 3
        state[:k] = got >> 2
        if t < _EARLY and (before >= 0).any():
            early.append((state[:k].copy(), count[:k].copy()))
    _join(model, grid, size, before, early, state, count)
    last = np.array([(d, i + block) not in lane_of for d, i, _ in lanes])
    count += (state != model.roots[None, :]) & last[:, None]
    np.add.at(out, np.array([d for d, _, _ in lanes]), count)
    return out


def _join(model: Model, grid: np.ndarray, size: np.ndarray, before: np.ndarray, early: list, state: np.ndarray, count: np.ndarray) -> None:
    """Make each block's phrases those of a parse that comes from the block before it; ``state`` and ``count`` are of parses from the start, and are changed."""
    end, whole = state.copy(), count.copy()
    begun = np.repeat(model.roots[None, :], len(size), axis=0)
    later = np.flatnonzero(before >= 0)
    while len(later):
        lane, lang = np.nonzero(state[before[later]] != begun[later])
        lane = later[lane]
        if not len(lane):
            return
        s = state[before[lane], lang]
        begun[lane, lang] = s
        c = np.zeros(len(lane), np.int32)
        t = 0
        while len(lane):
            got = model.steps[s + grid[t, lane]]
            c += got & 3
            s = got >> 2
            done = size[lane] == t + 1
            state[lane[done], lang[done]], count[lane[done], lang[done]] = s[done], c[done]
            if t < len(early):
                met = ~done & (s == early[t][0][lane, lang])
                a, b = lane[met], lang[met]
                state[a, b], count[a, b] = end[a, b], whole[a, b] - early[t][1][a, b] + c[met]
                done |= met
            lane, lang, s, c = lane[~done], lang[~done], s[~done], c[~done]
            t += 1


def predict(model: Model, codes: np.ndarray, batch: list[str | None], block: int) -> Iterator[tuple[str, float]]:
    symbols: list[np.ndarray] = []
    lettered = []
    for text in batch:
        at = points(text or "")
        s = codes[at]
        lettered.append(bool(letter_table()[at].any()))
        symbols.append(symbols_of(s))
    cost = phrases(model, symbols, block) * model.bits[None, :] if model.langs else np.zeros((len(batch), 0))
    for i, ok in enumerate(lettered):
        if not ok or not model.langs:
            yield "und", 0.0
            continue
        order = np.argsort(cost[i], kind="stable")
        best = float(cost[i, order[0]])
        second = float(cost[i, order[1]]) if len(order) > 1 else math.inf
        yield model.langs[int(order[0])], 1.0 - best / second if second else 0.0


def labelled_sample(docs: DataFrame, usable, id_col: str, text_col: str, lang_col: str, docs_per_lang: int, doc_chars: int) -> dict[str, list[str]]:
    """At most ``docs_per_lang`` texts of each language, of at most ``doc_chars`` characters from all parts of a text, chosen by a hash; texts of 200 characters or more come first.

    Counts of the languages give a share of the hashes for each, so that some times as many rows as are wanted leave the scan.
    """
    rows = docs.filter(usable & docs[lang_col].isNotNull() & docs[text_col].isNotNull())
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    shares = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, share_for(4 * docs_per_lang, n))])
    near = rows.withColumn("u", unit_hash("id", "text")).filter(F.col("u") < shares[F.col("lang")])
    one = near.groupBy("lang", "u").agg(F.min(F.struct((F.length("text") < 200).alias("short"), spread("text", F.col("id"), doc_chars).alias("text"))).alias("t"))
    got: dict[str, list[tuple]] = {}
    for r in one.select("lang", "u", "t.short", "t.text").collect():
        got.setdefault(r["lang"], []).append((r["short"], r["u"], r["text"]))
    return {k: [t for *_, t in sorted(got[k])[:docs_per_lang]] for k in sorted(got)}


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", block: int = 1024) -> DataFrame:
    """``doc_id, lang_pred, score`` for each row; score is one less the best cost over the second best."""
    docs = pick(docs, id_col, text_col)
    known = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([docs.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = known.value.codes()

        def rows():
            held: list[tuple] = []
            chars = 0
            for batch in batches:
                for doc_id, text in zip(ids(batch), batch.column(1), strict=True):
                    held.append((doc_id, text.as_py()))
                    chars += len(held[-1][1] or "")
                    if chars > _BATCH_CHARS:
                        yield from ((d, *p) for (d, _), p in zip(held, predict(known.value, codes, [t for _, t in held], block), strict=True))
                        held, chars = [], 0
            yield from ((d, *p) for (d, _), p in zip(held, predict(known.value, codes, [t for _, t in held], block), strict=True))

        yield from in_batches(rows(), arrow)

    return docs.mapInArrow(run, schema)
