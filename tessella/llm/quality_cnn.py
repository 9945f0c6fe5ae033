"""Quality classifier: a byte-level convolutional network in numpy (operator 5).

Bytes are embedded, learned filters run over them two bytes apart, and each overlapping chunk
of the document is max-pooled to one number a filter. The chunks' pooled vectors are averaged
and a logistic unit makes them one probability, so the whole document counts, whatever its
length. Training (Adam on balanced classes, fixed seed) is on the driver over a bounded sample
of labelled rows; scoring is one scan without a shuffle, with the small weights broadcast.

Defined cases: null and empty texts are scored as padding alone; texts of any length are scored
whole, chunk by chunk; repeated rows are scored alike; with no labels, or one class, the
score is that class's share (0.5 without any); several labels of an id count as the lowest; an
empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import bounded_batches, ids, in_batches, pick, share_for, spread, unit_hash

#: Shape of the network: bytes a filter sees, bytes between filter places, places in a chunk, between chunk starts and in the parts that chunks share.
WIDTH, STRIDE, CHUNK, HOP, PART = 8, 2, 256, 224, 32
#: Parts whose filters are evaluated at once, few enough for a core's cache.
_PARTS = 128


@dataclass
class Network:
    """Weights; ``prior`` is returned for every text where training had no two classes."""

    embed: np.ndarray = field(default_factory=lambda: np.zeros((256, 8), np.float32))
    filters: np.ndarray = field(default_factory=lambda: np.zeros((WIDTH * 8, 48), np.float32))
    shift: np.ndarray = field(default_factory=lambda: np.zeros(48, np.float32))
    out: np.ndarray = field(default_factory=lambda: np.zeros(48, np.float32))
    fill: np.ndarray = field(default_factory=lambda: np.zeros(3, np.float32))
    bias: float = 0.0
    prior: float | None = None


def _pairs(embed: np.ndarray) -> np.ndarray:
    """The embeddings of both bytes of each 16-bit little-endian number."""
    both = np.arange(1 << 16)
    return np.concatenate([embed[both & 255], embed[both >> 8]], axis=1)


def _windows(pairs: np.ndarray, data: np.ndarray) -> np.ndarray:
    """(..., bytes) to (..., places, WIDTH * embedding): what a filter sees at each place."""
    seen = pairs[data.view("<u2")]
    *outer, n, size = seen.shape
    k = WIDTH // STRIDE
    step = seen.strides[-1]
    return np.ascontiguousarray(np.lib.stride_tricks.as_strided(seen, (*outer, n - k + 1, k * size), (*seen.strides[:-1], step), writeable=False))


def _fill(filled: np.ndarray) -> np.ndarray:
    """How much of a chunk is text, for the last unit: little text may show few patterns and be fine."""
    return np.stack([filled, np.sqrt(filled), filled**4], axis=-1).astype(np.float32)


def train(texts: list[bytes], labels: list[int], epochs: int = 16, batch: int = 32, chunks: int = 3, rate: float = 3e-3, seed: int = 7) -> Network:
    """Fit a network to documents; each epoch sees ``chunks`` chunks of each, at places chosen anew."""
    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        return Network(prior=float(y.mean()) if len(y) else 0.5)
    rng = np.random.default_rng(seed)
    size = (CHUNK - 1) * STRIDE + WIDTH
    p = {"embed": rng.normal(0, 0.5, (256, 8)), "filters": rng.normal(0, 0.18, (WIDTH * 8, 48)), "shift": np.zeros(48), "out": rng.normal(0, 0.2, 48), "fill": np.zeros(3), "bias": np.zeros(1)}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    first, second, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            x = np.zeros((len(rows), chunks, size), np.uint8)
            filled = np.zeros((len(rows), chunks))
            for i, r in enumerate(rows):
                for c in range(chunks):
                    s = int(rng.integers(0, max(1, len(texts[r]) - size + 1)))
                    got = np.frombuffer(texts[r][s : s + size], np.uint8)
                    x[i, c, : len(got)] = got
                filled[i, c] = len(got) / size
            seen = _windows(_pairs(p["embed"]), x)
            share = _fill(filled).mean(axis=1)
            places = seen @ p["filters"] + p["shift"]
            best = places.argmax(axis=2)
            pooled = np.maximum(np.take_along_axis(places, best[:, :, None, :], 2)[:, :, 0, :], 0)
            mean = pooled.mean(axis=1)
            prob = 1 / (1 + np.exp(-(mean @ p["out"] + share @ p["fill"] + p["bias"][0])))
            wrong = (prob - y[rows]) * weight[rows] / len(rows)
            g = {"out": mean.T @ wrong, "fill": share.T @ wrong, "bias": np.array([wrong.sum()], np.float32)}
            back = (wrong[:, None] * p["out"][None, :] / chunks)[:, None, :] * (pooled > 0)
            top = np.take_along_axis(seen[:, :, :, :], best[:, :, :, None], 2)  # what each filter's best place saw
            g["filters"] = np.einsum("bcfe,bcf->ef", top, back)
            g["shift"] = back.sum(axis=(0, 1))
            spread = back[..., None] * p["filters"].T[None, None]
            touched = x[np.arange(len(rows))[:, None, None, None], np.arange(chunks)[None, :, None, None], (best * STRIDE)[..., None] + np.arange(WIDTH)]
            g["embed"] = np.zeros_like(p["embed"])
            np.add.at(g["embed"], touched.ravel(), spread.reshape(-1, 8))
            step += 1
            for k in p:
                first[k] = 0.9 * first[k] + 0.1 * g[k]
                second[k] = 0.99 * second[k] + 0.01 * g[k] ** 2
                p[k] = (p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return Network(p["embed"], p["filters"], p["shift"], p["out"], p["fill"], float(p["bias"][0]))


def scores(net: Network, texts: list[bytes]) -> np.ndarray:
    """Probabilities of label 1, each over the whole text."""
    if net.prior is not None:
        return np.full(len(texts), net.prior)
    size = (CHUNK - 1) * STRIDE + WIDTH
    counts = [max(1, -(-len(t) // (PART * STRIDE))) for t in texts]  # parts of each text; an empty part follows it
    starts = np.concatenate([[0], np.cumsum([n + 1 for n in counts])]).tolist()
    data = np.zeros(starts[-1] * PART * STRIDE + WIDTH, np.uint8)
    for t, s in zip(texts, starts, strict=False):
        data[s * PART * STRIDE : s * PART * STRIDE + len(t)] = np.frombuffer(t, np.uint8)
    pairs, parts = _pairs(net.embed), np.empty((starts[-1], len(net.shift)), np.float32)
    for i in range(0, len(parts), _PARTS):
        n = min(_PARTS, len(parts) - i)
        seen = _windows(pairs, data[i * PART * STRIDE : (i + n) * PART * STRIDE + WIDTH - STRIDE])
        (seen @ net.filters).reshape(n, PART, -1).max(axis=1, out=parts[i : i + n])
    edges, owner, filled = [], [], []
    for d, (s, n) in enumerate(zip(starts, counts, strict=False)):
        for c in range(0, max(1, n - (CHUNK - HOP) // PART), HOP // PART):
            edges += [s + c, s + min(n, c + CHUNK // PART)]
            owner.append(d)
            filled.append(min(1.0, (len(texts[d]) - c * PART * STRIDE) / size))
    pooled = np.maximum.reduceat(parts, np.array(edges), axis=0)[::2]
    short = np.array(filled) < 1
    padding = _windows(pairs, np.zeros(WIDTH, np.uint8)) @ net.filters
    pooled[short] = np.maximum(pooled[short], padding)  # the rest of the chunk, as in training
    pooled = np.maximum(pooled + net.shift, 0)
    logit = pooled.astype(float) @ net.out.astype(float) + _fill(np.array(filled)).astype(float) @ net.fill.astype(float) + net.bias
    mean = np.bincount(owner, logit, len(texts)) / np.bincount(owner, minlength=len(texts))
    return 1 / (1 + np.exp(-np.clip(mean, -60, 60)))


def labelled_sample(docs: DataFrame, labels: DataFrame, usable, id_col: str, text_col: str, label_col: str, per_class: int, doc_chars: int) -> tuple[list[bytes], list[int]]:
    """At most ``per_class`` documents of either label, chosen by a hash of the id, at most ``doc_chars`` characters of each, from all parts of it.

    Counts of the labels give a share of the hashes for each, so that about as many rows as are wanted leave the scan;
    none of the label's other rows is sorted or brought together.
    """
    rows = labels.filter(usable & labels[label_col].isNotNull() & labels[id_col].isNotNull()).select(F.col(id_col).alias("k_id"), F.col(label_col).cast("int").alias("label"))
    rows = rows.withColumn("u", unit_hash(F.col("k_id").cast("string")))
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    shares = {k: share_for(per_class, n) for k, n in counts.items()}
    while True:
        share = F.lit(0.0)
        for k, x in shares.items():
            share = F.when(F.col("label") == k, F.lit(x)).otherwise(share)
        one = rows.filter(F.col("u") < max(shares.values(), default=0.0)).groupBy("k_id", "u").agg(F.min("label").alias("label"))
        near: dict[int, list] = {k: [] for k in counts}
        for r in one.filter(F.col("u") < share).collect():
            near[r["label"]].append((r["u"], str(r["k_id"]), r["k_id"]))
        few = [k for k, found in near.items() if len(found) < per_class and shares[k] < 1]
        if not few:
            break
        for k in few:  # ids that are there more than once, or under a lower label
            shares[k] = min(1.0, 4 * shares[k])
    chosen = [(k_id, k) for k, found in near.items() for _, _, k_id in sorted(found, key=lambda x: x[:2])[:per_class]]
    kept = docs.sparkSession.createDataFrame(chosen, T.StructType([T.StructField("k_id", labels.schema[id_col].dataType), T.StructField("label", T.IntegerType())]))
    # at most 2 * per_class rows, so the broadcast is bounded
    got = pick(docs, id_col, text_col).join(F.broadcast(kept), F.col("doc_id") == F.col("k_id")).filter(F.col("text").isNotNull())
    found = got.select("doc_id", "label", spread("text", F.col("doc_id").cast("string"), doc_chars).alias("text")).orderBy("doc_id", "text").limit(4 * per_class).collect()
    return [r["text"].encode() for r in found], [r["label"] for r in found]


def fit(docs: DataFrame, labels: DataFrame, usable, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = 1000, doc_chars: int = 6000, **how) -> Network:
    """Train on a bounded sample of ``labels`` joined to ``docs``; ``usable`` is a condition on rows of ``labels``."""
    return train(*labelled_sample(docs, labels, usable, id_col, text_col, label_col, per_class, doc_chars), **how)


def classify(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``doc_id, score, predicted`` for each row."""
    docs = pick(docs, id_col, text_col)
    known = docs.sparkSession.sparkContext.broadcast(net)
    schema = T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    arrow = to_arrow_schema(schema)
    return docs.mapInArrow(lambda batches: in_batches(((d, s, int(s >= threshold)) for (d,), s in scored(batches, known.value, ["doc_id"])), arrow), schema)


def scored(batches: Iterator[pa.RecordBatch], net: Network, keep: list[str], most: int = 1_000_000) -> Iterator[tuple[tuple, float]]:
    """(columns ``keep`` of a row, its score), texts being scored about ``most`` bytes at a time."""
    held: list[tuple] = []
    texts: list[bytes] = []
    size = 0
    for batch in batches:
        columns = [ids(batch, c) for c in keep]
        text = batch.column(batch.schema.get_field_index("text"))
        for i, row in enumerate(zip(*columns, strict=True)):
            held.append(row)
            texts.append((text[i].as_py() or "").encode())
            size += len(texts[-1]) + WIDTH
            if size > most:
                yield from zip(held, scores(net, texts).tolist(), strict=True)
                held, texts, size = [], [], 0
    if held:
        yield from zip(held, scores(net, texts).tolist(), strict=True)


def keep_good(docs: DataFrame, net: Network, text_col: str = "text", threshold: float = 0.3, most: int = 1_000_000) -> DataFrame:
    """``docs``, with all its columns, without the rows that score below ``threshold``; texts are scored about ``most`` bytes at a time."""
    known = bounded_batches(docs).sparkSession.sparkContext.broadcast(net)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pa.RecordBatch.from_arrays([pa.array(range(len(batch))), batch.column(place)], names=["row", "text"])
            good = [s >= threshold for _, s in scored(iter([text]), known.value, ["row"], most)]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
