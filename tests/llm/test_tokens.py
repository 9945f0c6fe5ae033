import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessella.llm.packing import Packer, pack
from tessella.llm.pretokens import PreTokenizer
from tessella.llm.token_counts import token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_pretokens_give_the_librarys_ids():
    rng = random.Random(1)
    pools = ["abcXYZ '.,;!?sdtrevml019 \n\t\x0b\x0c\r\x1c\x1f\x00\x7f", "àéÑßİıǅªºµ²¼\xa0\x85×÷ſ ̀é", "ΣσςΑΣ 日本語​ 　กำﷺ﻿😀👍🏽ẞꯍ", " <|endoftext|>", "ÅKΩﬁ"]
    cut = PreTokenizer(PATH)
    for _ in range(4000):
        pool = rng.choice([*pools, "".join(pools)])
        text = "".join(rng.choice(pool) for _ in range(rng.randrange(20))) + rng.choice(["", "", "<|endoftext|>", "x<|startoftext|>y"])
        assert [i for t in cut.tokens(text) for i in cut.ids(t)] == ids_of(text), text


@pytest.mark.parametrize("head", [0, 5, 200_000])
def test_token_counts_match_the_library(edge_docs, head):
    got = sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts(edge_docs, PATH, limit=50, head_size=head).collect())
    want = sorted((d or -1, len((t or "").encode()), len(ids_of(t)), len(ids_of(t)) > 50) for d, t in edge_docs.select("doc_id", "text").collect())
    assert got == want


def test_token_counts_of_nothing(empty_docs):
    assert token_counts(empty_docs, PATH).count() == 0


def check_packing(rows, docs, size, segments):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
        assert r["ids_crc32"] == zlib.crc32(r["ids"]) and len(r["ids"]) == 4 * r["length"] > 0
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in pieces] == np.cumsum([0, *[r["length"] for r in pieces]])[:-1].tolist()
        assert sum(r["length"] for r in pieces) <= size and len(pieces) <= segments
    want = sorted((d or -1, *[*ids_of(t), 2]) for d, t in docs)
    got = []
    for d, pieces in by_doc.items():
        whole = b""
        for r in sorted(pieces, key=lambda r: (r["doc_tokens"], r["start"])):
            whole += r["ids"]
        got.append((d, len(whole) // 4, pieces))
    assert sum(n for _, n, _ in got) == sum(len(w) - 1 for w in want)
    for d, t in docs:
        if d is not None and sum(1 for x, _ in docs if x == d) == 1:
            data = b"".join(r["ids"] for r in sorted(by_doc[d], key=lambda r: r["start"]))
            assert np.frombuffer(data, "<u4").tolist() == [*ids_of(t), 2]


@pytest.mark.parametrize("size,segments", [(64, 8), (4096, 512)])
def test_packing_keeps_every_id_once(edge_docs, size, segments):
    docs = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    rows = pack(edge_docs.coalesce(2), PATH, max_tokens=size, max_segments=segments, with_ids=True).collect()
    check_packing(rows, docs, size, segments)
    lengths = defaultdict(int)
    for r in rows:
        lengths[r["sequence_id"]] += r["length"]
    waste = sum(size - n for n in lengths.values() if n & (n - 1))
    assert waste <= 0.02 * sum(lengths.values())


def test_packing_of_nothing(empty_docs):
    assert pack(empty_docs, PATH).count() == 0


def test_packer_respects_all_three_limits():
    rng = random.Random(3)
    packer = Packer(100, 5, 40, pool=16)
    examples = {k: (rng.randrange(1, 150), rng.randrange(0, 150)) for k in range(300)}
    sequences = [s for k, (n, free) in examples.items() for s in packer.add(k, n, free)] + list(packer.finish())
    seen = defaultdict(int)
    for s in sequences:
        loss = sum(n - min(n, max(0, min(examples[k][1], examples[k][0]) - start)) for k, start, n in s)
        assert sum(n for *_, n in s) <= 100 and 0 < len(s) <= 5 and loss <= 40
        for k, _, n in s:
            seen[k] += n
    assert seen == {k: n for k, (n, _) in examples.items()}


def test_prompts_bear_no_loss(spark):
    df = spark.createDataFrame([(1, "the answer", "a question here"), (2, "b", None)], "doc_id long, text string, prompt string")
    rows = pack(df.coalesce(1), PATH, prompt_col="prompt").collect()
    assert sum(r["loss_tokens"] for r in rows) == sum(len(ids_of(t)) + 1 for t in ("the answer", "b"))
