"""N-gram Jaccard join with signature trees (operator 4): classes of documents linked by similar sets of word shingles.

The search is exact. Documents with equal sets are one node. Any two sets of the asked
similarity share some of the first shingles of each, in an order common to all sets (prefix
filter: with as many shingles beyond the threshold's slack as are to be shared); the order puts
shingles that are frequent in the corpus last, so that a passage many documents share brings
none of them together. Within a prefix
shingle, a signature tree finds the candidate pairs: its nodes hold OR-combined bitmaps and
size ranges, and dual traversal drops every node pair whose largest possible overlap is too
small. Candidates are then checked on their whole sets. A group whose tree would be one leaf sends
no bitmaps: its pairs are written out, counted over all groups and kept if they meet in as many
prefix shingles as similar sets must and the bitmaps, sent once a pair, allow it.

Large groups of near copies would make every pair of them a candidate. So the trees are searched
in rounds: at first each document brings only its most similar candidate of each prefix group,
and in large groups only those of its own block of ``cell`` members and of the first block, so
candidates grow with the input and not with a group's square. What is linked is one component,
and the trees drop node pairs inside one. When such a round finds no link, or after
``best_rounds``, the last round takes every candidate that is left, between all pairs of blocks, so no link is lost:
a pair skipped is already connected. Groups in which the first search found no candidate are
done with.

Texts are read once for sizes and bitmaps, once for prefixes, and once for each check, where
only the sets of candidate documents (told by a Bloom filter of bounded size) are shuffled.

Defined cases: null, empty and wordless texts have no shingles and stand alone; a text of
fewer words than a shingle is one shingle; texts of any length count whole; repeated rows and
equal sets are one class; a component's id is the least non-null doc_id in it (null only if all
are null); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import drop_written, free_shuffles, fresh, ids, in_batches, pick, written
from .components import components
from .frequent import heaviest
from .line_dedup import Bits
from .shingles import SIG_BITS, bitmap, set_key, shingle_sets
from .signature_tree import BestPartners, SignatureTree, alike, close_pairs, largest_overlap

#: Shingle occurrences that a task counts together; a shingle is frequent there if it is in two of the documents, and in one of so many.
_COUNTED, _OFTEN = 1_000_000, 300
#: Frequent shingles that are broadcast (16 bytes each). More or fewer change costs only.
_MOST_FREQUENT = 200_000
#: A prefix has one more shingle, and similar sets one more in common there, for so many shingles of a set.
_SHARE = 64
#: Members of a prefix group whose tree is one leaf; its pairs are counted instead.
_LEAF = 16
#: Keys of sets that a task remembers in order not to repeat a copy's prefix.
_SEEN = 200_000
#: log2 of the bits that tell candidate sets in a scan, at least and at most; between them, ten bits or more a set.
_LEAST_BITS, _MOST_BITS = 20, 28
#: Tasks that make such bits.
_MARK_TASKS = 1024


def _common(n):
    """How many shingles the prefixes of similar sets have in common at least, the smaller number of the two counting."""
    return 1 + n // _SHARE


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id, n, text_hash, key, sig`` of each document (key null: no shingles), and rows ``token, df`` of frequent shingles; written once."""
    fields = (("n", T.LongType()), ("text_hash", T.LongType()), ("key", T.BinaryType()), ("sig", T.BinaryType()), ("token", T.LongType()), ("df", T.LongType()))
    names = T.StructType([docs.schema["doc_id"], *[T.StructField(*f) for f in fields]])
    arrow = to_arrow_schema(names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def often() -> Iterator[tuple]:
            if held:
                tokens = np.sort(np.concatenate(held))
                starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
                counts = np.diff(np.append(starts, len(tokens)))
                many = counts >= max(2, len(held) // _OFTEN)
                yield from ((None,) * 5 + x for x in zip(tokens[starts[many]].view(np.int64).tolist(), counts[many].tolist(), strict=True))
            held.clear()

        def rows() -> Iterator[tuple]:
            size = 0
            for batch in batches:
                for doc_id, h, s in zip(ids(batch), ids(batch, "text_hash"), shingle_sets(batch.column(1), words), strict=True):
                    if not len(s):
                        yield doc_id, 0, None, None, None, None, None
                        continue
                    yield doc_id, len(s), h, set_key(s), bitmap(s), None, None
                    held.append(s)
                    size += len(s)
                    if size > _COUNTED:
                        yield from often()
                        size = 0
            yield from often()

        yield from in_batches(rows(), arrow, 1024)

    return written(docs.withColumn("text_hash", F.xxhash64("text")).mapInArrow(scan, names), "sets")


def _prefixes(docs: DataFrame, words: int, percent: int, frequent) -> DataFrame:
    """``key, tokens``: the prefix of each distinct set (more than once only from different tasks)."""
    arrow = pa.schema([("key", pa.binary()), ("tokens", pa.list_(pa.int64()))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        token, weight = frequent.value

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for s in shingle_sets(batch.column(0), words):
                    if not len(s) or (key := set_key(s)) in seen:
                        continue
                    if len(seen) < _SEEN:
                        seen.add(key)
                    n = len(s) - -(-percent * len(s) // 100) + int(_common(len(s)))
                    if len(token):
                        at = np.minimum(np.searchsorted(token, s), len(token) - 1)
                        df = np.where(token[at] == s, weight[at], 0)
                        s = s[np.argsort(df, kind="stable")]
                    yield key, s[:n].view(np.int64)

        yield from in_batches(rows(), arrow, 1024)

    return docs.select("text").mapInArrow(scan, "key binary, tokens array<long>")


def _marks(hashes: DataFrame, log2_bits: int) -> np.ndarray:
    """A Bloom filter of a column of 64-bit hashes: where it fills up, it lets more through."""
    arrow, segment = pa.schema([("at", pa.int32()), ("bits", pa.binary())]), 1 << 16

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = Bits(log2_bits)
        for batch in batches:
            bits.add(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
        parts = ((i, bits.data[i : i + segment]) for i in range(0, len(bits.data), segment))
        yield from in_batches(((i, b.tobytes()) for i, b in parts if b.any()), arrow, 16)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                b = np.frombuffer(b, np.uint8)
                held[at] = b | held[at] if at in held else b
        yield from in_batches(((at, b.tobytes()) for at, b in held.items()), arrow, 16)

    whole = hashes.coalesce(_MARK_TASKS).mapInArrow(mark, "at int, bits binary").repartition(16, "at").mapInArrow(merge, "at int, bits binary").toArrow()
    data = np.zeros(1 << log2_bits >> 3, np.uint8)
    for at, b in zip(whole.column(0).to_pylist(), whole.column(1).to_pylist(), strict=True):
        data[at : at + len(b)] = np.frombuffer(b, np.uint8)
    return data


def _similar(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (``a, b``: node ids; the fewer different ones first) whose sets have the similarity; written once.

    Texts are told by the hash of a node's own text before any is cut into words, so a check costs what its candidates cost.
    """
    spark = docs.sparkSession
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("nid")).distinct().join(nodes.select("nid", "key", "text_hash"), "nid")
    wanted = written(wanted, "wanted")
    log2_bits = min(_MOST_BITS, max(_LEAST_BITS, (10 * wanted.count()).bit_length()))
    known = spark.sparkContext.broadcast(_marks(wanted.select("text_hash"), log2_bits))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = Bits(log2_bits, known.value), set()

        def rows() -> Iterator[tuple]:
            for batch in batches:
                hashes = batch.column(0).to_numpy(zero_copy_only=False)
                hit = np.flatnonzero(bits.test(hashes.view(np.uint64)))
                hit = hit[[h not in seen for h in hashes[hit].tolist()]] if len(hit) else hit
                hit = hit[np.unique(hashes[hit], return_index=True)[1]]
                if len(seen) < _SEEN:
                    seen.update(hashes[hit].tolist())
                for s in shingle_sets(batch.column(1).take(pa.array(hit)), words):
                    if len(s):
                        yield set_key(s), s.tobytes()

        yield from in_batches(rows(), pa.schema([("key", pa.binary()), ("s", pa.binary())]), 512)

    found = docs.select(F.xxhash64("text").alias("text_hash"), "text").filter("text IS NOT NULL").mapInArrow(scan, "key binary, s binary")
    # a key has one node: grouped as they were joined
    sets = written(wanted.select("nid", "key").join(found, "key").groupBy("key", "nid").agg(F.first("s").alias("s")).select("nid", "s"), "candidates")
    free_shuffles(spark)
    right = pairs.join(sets.select(F.col("nid").alias("b"), F.col("s").alias("y")), "b")
    left = sets.select(F.col("nid").alias("a"), F.col("s").alias("x"))  # the same shuffle of all sets

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            ok = []
            for i in range(len(batch)):
                s, t = np.frombuffer(x[i].as_buffer(), np.uint64), np.frombuffer(y[i].as_buffer(), np.uint64)
                both = np.sort(np.concatenate([s, t]))
                same = int((both[1:] == both[:-1]).sum())
                ok.append((100 + percent) * same >= percent * (len(s) + len(t)))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    links = written(right.join(left, "a").select("a", "b", "x", "y").mapInArrow(check, "a long, b long"), "links")
    known.destroy()
    drop_written(sets)
    drop_written(wanted)
    free_shuffles(spark)
    return links


def _members(postings: DataFrame) -> DataFrame:
    """Of ``token, nid``: ``token, a, size`` for the members of groups larger than a leaf, ``a, b`` for each pair of the others; written once."""
    arrow = pa.schema([("token", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("size", pa.int64())])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3

        def out(token: np.ndarray, nid: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
            large = np.flatnonzero(size > _LEAF)
            none = pa.nulls(len(large), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(token[large]), pa.array(nid[large]), none, pa.array(size[large])], schema=arrow)
            small = np.flatnonzero(size <= _LEAF)
            token, nid = token[small], nid[small]
            for step in range(1, _LEAF):
                near = np.flatnonzero(token[step:] == token[:-step])
                if not len(near):
                    break
                a, b, none = nid[near], nid[near + step], pa.nulls(len(near), pa.int64())
                yield pa.RecordBatch.from_arrays([none, pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), none], schema=arrow)

        for batch in batches:
            if not len(batch):
                continue
            now = [np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns, strict=True)]
            # rows of a group follow each other; the last group may go on in the next batch
            end = int(np.flatnonzero(now[0] != now[0][-1])[-1]) + 1 if now[0][0] != now[0][-1] else 0
            if not end and now[2][0] > _LEAF:
                end = len(now[0])
            held = [c[end:] for c in now]
            yield from out(*[c[:end] for c in now])
        yield from out(*held)

    # one shuffle, by shingle, for the groups' counts and for their members
    sized = postings.withColumn("size", F.count("*").over(Window.partitionBy("token"))).filter("size > 1")
    return written(sized.select("token", "nid", "size").mapInArrow(part, "token long, a long, b long, size long"), "members")


def _counted(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """``a, b, met, need, like`` of the distinct ``pairs`` that the leaf's test leaves: how often they meet, how often they must; written once."""
    own = lambda c, *more: nodes.select(F.col("nid").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in more])
    both = pairs.groupBy("a", "b").agg(F.count("*").alias("met")).join(own("a", "n"), "a").join(own("b", "n"), "b")
    fit = both.filter((100 * F.col("n_a") >= percent * F.col("n_b")) & (100 * F.col("n_b") >= percent * F.col("n_a")))
    fit = written(fit, "fit")  # bitmaps are sent for these alone

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not (k := len(batch)):
                continue
            met, n_a, n_b = (batch.column(c).to_numpy() for c in ("met", "n_a", "n_b"))
            sig = np.frombuffer(b"".join(batch.column("sig_a").to_pylist() + batch.column("sig_b").to_pylist()), np.uint8).reshape(2 * k, SIG_BITS // 8).view(np.uint64)
            n, at = np.concatenate([n_a, n_b]), np.arange(k)
            overlap = largest_overlap(sig, n - np.bitwise_count(sig).sum(axis=1), n, at, at + k)
            ok = pa.array((100 + percent) * overlap >= percent * (n_a + n_b))
            need, like = pa.array(_common(np.minimum(n_a, n_b)), pa.int64()), pa.array(met / (n_a + n_b))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("a", "b", "met")], need, like], ["a", "b", "met", "need", "like"]).filter(ok)

    signed = fit.join(own("a", "sig"), "a").join(own("b", "sig"), "b").select("a", "b", "met", "n_a", "n_b", "sig_a", "sig_b")
    counted = written(signed.mapInArrow(test, "a long, b long, met long, need long, like double"), "counted")
    drop_written(fit)
    return counted


def _apart(pairs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Those of ``pairs`` that aren't in one component yet."""
    if labels is None:
        return pairs
    for c in ("a", "b"):
        pairs = pairs.join(labels.select(F.col("node").alias(c), F.col("label").alias(f"label_{c}")), c, "left")
    return pairs.filter(F.coalesce("label_a", "a") != F.coalesce("label_b", "b")).drop("label_a", "label_b")


def _best(counted: DataFrame) -> DataFrame:
    """``a, b``: of each node the pair that meets most often for its sizes, if it meets often enough in these groups alone."""
    enough = counted.filter("met >= need")
    both = enough.select("a", "b", "like").union(enough.select("b", "a", "like"))
    best = both.groupBy("a").agg(F.max_by("b", F.struct("like", -F.col("b"))).alias("b"))
    return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _searched(members: DataFrame, nodes: DataFrame, percent: int, cell: int, best: bool, mixed: bool) -> DataFrame:
    """``token, a, b, need``: candidate pairs that the signature trees of prefix groups with two labels or more leave; written once.

    ``members``: ``token, nid, label, size``; ``mixed``: some labels may be equal. ``best``: of each document its most similar candidate alone (see above), if
    their bitmaps share more than chance; a cell whose candidates are all left out has a row without a pair (a = -1).
    """
    groups = members.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("token")
    own = (members.join(groups, "token", "left_semi") if mixed else members).withColumn("k", F.ceil(F.col("size") / cell).cast("int")).withColumn("block", F.pmod(F.xxhash64("nid"), F.col("k")).cast("int"))
    blocks = F.when(F.col("block") == 0, F.sequence(F.lit(0), F.col("k") - 1)).otherwise(F.array(F.lit(0), "block")) if best else F.sequence(F.lit(0), F.col("k") - 1)
    cells = own.select("token", "nid", "label", "block", F.explode(blocks).alias("other")).select("token", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "nid", "label")
    cells = cells.join(nodes.select("nid", "n", "sig"), "nid").select("token", "i", "j", "block", "nid", "label", "n", "sig")
    arrow = pa.schema([("token", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("need", pa.int64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: pa.Table, sizes: np.ndarray, sig: np.ndarray, found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
            """Candidates of complete cells, from pieces of their pairs; no more than a piece is held."""
            nid, token = rows.column("nid").to_numpy(), rows.column("token").to_numpy()
            need = _common(sizes)

            def pairs(a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
                if len(a):
                    columns = (token[a], np.minimum(nid[a], nid[b]), np.maximum(nid[a], nid[b]), np.minimum(need[a], need[b]))
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=arrow)

            if not best:
                for a, b, _ in found:
                    yield from pairs(a, b)
                return
            partners, met = BestPartners(sizes), np.zeros(len(rows), bool)
            for a, b, overlap in found:
                met[a] = True
                keep = alike(sig, a, b)
                partners.add(a[keep], b[keep], overlap[keep])
            cells = np.unique(token[met])
            if len(cells):
                none = np.full(len(cells), -1)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (cells, none, none, none)], schema=arrow)
                yield from pairs(*partners.pairs())

        def arrays(rows: pa.Table) -> tuple[np.ndarray, ...]:
            sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint8).reshape(-1, SIG_BITS // 8)
            # a cell of two blocks is for the pairs across them, one of a block with itself for all
            block, crossed = rows.column("block").to_numpy(), rows.column("i").to_numpy() != rows.column("j").to_numpy()
            return rows.column("n").to_numpy(), sig, rows.column("label").to_numpy(), np.where(crossed, block, -1 - np.arange(len(rows)))

        def whole(rows: pa.Table, edges: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Pairs of complete cells: small ones, trees of one leaf, all together, each other by its tree."""
            sizes = np.diff(edges)
            small = (sizes > 1) & (sizes <= _LEAF)
            if small.any():
                cells = np.repeat(np.arange(len(sizes)), sizes)
                at = np.flatnonzero(small[cells])
                part = rows.take(pa.array(at))
                n, sig, label, side = arrays(part)
                yield from out(part, n, sig, iter([close_pairs(n, sig, label, cells[at], percent, side)]))
            for k in np.flatnonzero(sizes > _LEAF):
                part = rows.slice(int(edges[k]), int(sizes[k]))
                n, sig, label, side = arrays(part)
                yield from out(part, n, sig, SignatureTree(n, sig, label, side).pairs(percent))

        rest: pa.Table | None = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            if rest is not None:
                now = pa.concat_tables([rest, now]).combine_chunks()
            key = np.stack([now.column(c).to_numpy() for c in ("token", "i", "j")])
            edges = np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1])
            yield from whole(now, edges)
            rest = now.slice(int(edges[-1]))
        if rest is not None:
            yield from whole(rest, np.array([0, len(rest)]))

    # no count is given, so that the number of partitions follows the session's setting
    dealt = cells.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")
    found = written(dealt.mapInArrow(search, "token long, a long, b long, need long"), "tree-pairs")
    free_shuffles(nodes.sparkSession)
    return found


def similar_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, cell: int = 1024, best_rounds: int = 2) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row: classes of ``100 * intersection >= percent * union``, transitively."""
    docs = pick(docs, id_col, text_col)
    spark = docs.sparkSession
    table = _sets(docs, words)
    sets = table.filter("n IS NOT NULL").select("doc_id", "n", "text_hash", "key", "sig")
    hot = heaviest(table.filter("token IS NOT NULL").groupBy("token").agg(F.sum("df").alias("df")), "df", _MOST_FREQUENT).toArrow()
    token, weight = hot.column("token").to_numpy().astype(np.int64).view(np.uint64), hot.column("df").to_numpy().astype(np.int64)
    order = np.argsort(token)
    frequent = spark.sparkContext.broadcast((token[order], weight[order]))

    own = [F.first(c).alias(c) for c in ("n", "text_hash", "sig")]
    nodes = sets.filter("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("least"), *own)
    nodes = written(nodes.withColumn("nid", F.monotonically_increasing_id()), "nodes")

    prefixes = _prefixes(docs, words, percent, frequent).dropDuplicates(["key"]).join(nodes.select("key", "nid"), "key")
    prefixes = written(prefixes.select("nid", "tokens"), "prefixes")
    frequent.destroy()
    free_shuffles(spark)
    parted = _members(prefixes.select(F.explode("tokens").alias("token"), "nid"))
    drop_written(prefixes)
    free_shuffles(spark)
    members = parted.filter("b IS NULL").select("token", F.col("a").alias("nid"), "size")
    counted = _counted(parted.filter("b IS NOT NULL").select("a", "b"), nodes, percent)
    free_shuffles(spark)

    links = labels = None
    for best in (*[True] * best_rounds, False):
        if labels is None:
            labelled = members.withColumn("label", F.col("nid"))
        elif best and not new.limit(1).count():
            continue
        else:
            labelled = members.join(labels.withColumnRenamed("node", "nid"), "nid", "left").select("token", "nid", "size", F.coalesce("label", "nid").alias("label"))
        found = _searched(labelled, nodes, percent, cell, best, labels is not None)
        if labels is None:
            # only groups with a candidate, or too large to have been searched whole, can have one later
            live = found.select("token").union(members.filter(F.col("size") > cell).select("token")).distinct()
            members = written(members.join(live, "token", "left_semi"), "live-members")
            drop_written(parted)
        if best:
            pairs = found.filter("a >= 0").select("a", "b").union(_best(_apart(counted, labels))).distinct()
        else:
            # a pair that may be similar comes from the group of every shingle that its prefixes share
            met = found.select("a", "b", "need", F.lit(1).cast("long").alias("met")).union(_apart(counted, labels).select("a", "b", "need", "met"))
            pairs = met.groupBy("a", "b", "need").agg(F.sum("met").alias("met")).filter("met >= need").select("a", "b")
        new = _similar(docs, written(pairs, "pairs"), nodes, words, percent)
        drop_written(found)
        links = new if links is None else links.union(new)
        if labels is None or new.limit(1).count():
            labels = components(links)

    named = nodes.join(labels.withColumnRenamed("node", "nid"), "nid", "left").select("key", "least", F.coalesce("label", "nid").alias("label"))
    ids_of = named.groupBy("label").agg(F.min("least").alias("component_id"))
    keyed = written(named.select("key", "label").join(ids_of, "label").select("key", "component_id"), "classes")
    joined = sets.select("doc_id", "n", "key").join(keyed, "key", "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """``docs``, with all its columns, without all but the least id of each class of similar documents.

    Rows that repeat an id are documents of their own: one row of each class stays, also where another row of its id does.
    Rows without an id stay.
    """
    columns, named = docs.columns, docs[id_col].isNotNull()
    if docs.filter(named).groupBy(id_col).agg(F.count("*").alias("n")).filter("n > 1").limit(1).count():
        # written, so that a row's number doesn't change
        row = fresh(columns, "_row")
        rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
        classes = similar_classes(rows, row, text_col, words, percent).select(F.col("doc_id").alias("row"), "component_id")
        order = F.struct(rows[id_col].alias("id"), F.xxhash64(rows[text_col]).alias("text"), rows[row].alias("row"))
        kept = rows.filter(rows[id_col].isNotNull()).select(order.alias("order")).join(classes, F.col("order.row") == F.col("row")).groupBy("component_id").agg(F.min("order")["row"].alias(row))
        return rows.join(kept.select(row), row, "left_semi").select(*columns).union(rows.filter(rows[id_col].isNull()).select(*columns))
    kept_id = fresh(columns, "kept_id")
    classes = similar_classes(docs, id_col, text_col, words, percent)
    kept = classes.filter("doc_id = component_id").select(F.col("doc_id").alias(kept_id)).distinct()
    stay = docs.filter(named).join(kept, docs[id_col] == F.col(kept_id), "left_semi")
    return stay.union(docs.filter(docs[id_col].isNull()))
