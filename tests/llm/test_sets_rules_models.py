import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.llm import language_id, quality_cnn
from tessella.llm.decontaminate import contamination, decontaminate, tiles
from tessella.llm.ngram_join import one_of_each, similar_classes
from tessella.llm.quality_rules import RULES, quality_rules
from tessella.llm.shingles import bitmap, shingle_sets
from tessella.llm.signature_tree import BestPartners, SignatureTree, close_pairs

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_classes(docs, k, percent):
    sets = [shingles(t, k) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((some(d), len(s), some(least.get(find(i)) if s else d)) for i, ((d, _), s) in enumerate(zip(docs, sets, strict=True)))


def some(x):
    return -1 if x is None else x


def near_docs(seed, n=150):
    rng = random.Random(seed)
    out, base = [], []
    for i in range(n):
        if base and rng.random() < 0.6:
            words = rng.choice(base)[:]
            for _ in range(rng.choice([0, 1, 1, 2, 4, 8])):
                words[rng.randrange(len(words))] = f"w{rng.randrange(30)}"
        else:
            words = [f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 8, 30, 60, 150]))]
        base.append(words)
        out.append((i, " ".join(words + (["common"] * 6 + [f"c{j}" for j in range(20)] if i % 3 == 0 else []))))
    return out


@pytest.mark.parametrize("cell", [3, 1024])
def test_similar_classes_are_exact(spark, cell):
    docs = near_docs(5)
    got = similar_classes(spark.createDataFrame(docs, "doc_id long, text string"), words=4, percent=85, cell=cell).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_classes(docs, 4, 85)


def test_similar_classes_of_edge_cases(edge_docs, empty_docs):
    docs = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    got = similar_classes(edge_docs, words=5, percent=80).collect()
    assert sorted((some(r["doc_id"]), r["n_shingles"], some(r["component_id"])) for r in got) == brute_classes(docs, 5, 80)
    assert similar_classes(empty_docs).count() == 0


def test_one_of_each_keeps_columns(edge_docs):
    kept = one_of_each(edge_docs)
    assert kept.columns == edge_docs.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids[5] == 1 and ids[6] == 0 and ids[4] + ids[7] == 1 and ids[None] == 2 and ids[1] == ids[2] == 1


def test_shingle_sets_agree_with_tuples(monkeypatch):
    from tessella.llm import shingles as module

    monkeypatch.setattr(module, "_BYTES", 200)
    rng = random.Random(2)
    texts = [None, "", " ", "a", "A b", "a b c d", *["".join(rng.choice("aAbBéß \n\t.") for _ in range(rng.randrange(60))) for _ in range(400)]]
    for k in (1, 2, 4):
        got = list(shingle_sets(pa.array(texts), k))
        want = [shingles(t, k) for t in texts]
        assert [len(g) for g in got] == [len(w) for w in want]
        for _ in range(2000):
            i, j = rng.randrange(len(texts)), rng.randrange(len(texts))
            assert len(np.intersect1d(got[i], got[j])) == len(want[i] & want[j])


def test_signature_tree_finds_all_similar_pairs():
    rng = np.random.default_rng(1)
    base = [np.unique(rng.integers(0, 1 << 63, rng.integers(3, 200), dtype=np.uint64)) for _ in range(20)]
    sets = [np.unique(np.concatenate([rng.choice(b, max(1, int(len(b) * rng.uniform(0.7, 1))), replace=False), rng.integers(0, 1 << 63, 3, dtype=np.uint64)])) for b in base for _ in range(4)]
    sizes, sig = np.array([len(s) for s in sets]), np.frombuffer(b"".join(map(bitmap, sets)), np.uint8).reshape(len(sets), -1)
    labels = np.arange(len(sets))
    same = lambda i, j: len(np.intersect1d(sets[i], sets[j]))
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if 100 * same(i, j) >= 60 * (sizes[i] + sizes[j] - same(i, j))}
    got = {(min(i, j), max(i, j)) for a, b, _ in SignatureTree(sizes, sig, labels).pairs(60) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
    assert want and want <= got
    a, b, _ = close_pairs(sizes, sig, labels, np.zeros(len(sets), int), 60)
    assert {(min(i, j), max(i, j)) for i, j in zip(a.tolist(), b.tolist(), strict=True)} == got
    assert not [1 for a, *_ in SignatureTree(sizes, sig, np.zeros(len(sets), int)).pairs(60) if len(a)]


def brute_tiles(a, b, least):
    free_a, free_b, out = [x >= 0 for x in a], [x >= 0 for x in b], []
    while True:
        best = []
        for p in range(len(a)):
            for d in range(len(b)):
                n = 0
                while p + n < len(a) and d + n < len(b) and free_a[p + n] and free_b[d + n] and a[p + n] == b[d + n]:
                    n += 1
                best.append((n, p, d))
        top = max((n for n, *_ in best), default=0)
        if top < least:
            return sorted(out)
        for n, p, d in best:
            if n == top and all(free_a[p : p + n]) and all(free_b[d : d + n]):
                out.append((p, d, n))
                free_a[p : p + n] = [False] * n
                free_b[d : d + n] = [False] * n


def test_tiles_cover_what_brute_force_covers():
    rng = random.Random(3)
    for _ in range(400):
        v = rng.choice([2, 3, 6])
        a = [rng.randrange(v) for _ in range(rng.randrange(18))]
        b = [rng.choice([-1, *range(v)]) for _ in range(rng.randrange(25))]
        if rng.random() < 0.6 and len(a) > 6:
            k = rng.randrange(len(a))
            b = b[:5] + a[k:] + b[5:9] + a[:k] + b[9:]
        least = rng.choice([2, 3, 5])
        assert sum(n for *_, n in tiles(np.array(a, np.int64), np.array(b, np.int64), least)) == sum(n for *_, n in brute_tiles(a, b, least))


def test_contamination_catches_reordered_passages(spark, edge_docs, empty_docs):
    rng = random.Random(6)
    words = lambda n: [f"v{rng.randrange(500)}" for _ in range(n)]
    items = [(i, " ".join(words(30))) for i in range(20)] + [(20, "too short"), (21, None), (22, "")]
    parts = items[3][1].split()
    docs = [(0, " ".join(words(200))), (1, " ".join(words(50)) + " " + items[1][1] + ". " + " ".join(words(50))), (2, " ".join(parts[15:] + words(40) + parts[:15]).upper()), (3, " ".join(parts[:10])), (4, None), (5, "too short")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("x"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (4_000_000, 200):
        got = {(r["doc_id"], r["item_id"]): r["coverage"] for r in contamination(df, bench, block_chars=block).collect()}
        assert got == {(1, 1): 1.0, (2, 3): 1.0}
        kept = decontaminate(df, bench, block_chars=block)
        assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 3, 4, 5]
    assert contamination(empty_docs, bench).count() == 0 and contamination(edge_docs, bench.limit(0)).count() == 0
    assert contamination(edge_docs, bench).count() == 0 and decontaminate(edge_docs, bench).count() == edge_docs.count()


def brute_rules(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    places = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(places)


def test_quality_rules_count_exactly(spark, edge_docs, empty_docs):
    rng = random.Random(8)
    more = [(1000 + i, " ".join(rng.choice(["a", "bb", "#", "c|d", "ee\n", "ÄÖ", "x"]) for _ in range(rng.randrange(90)))) for i in range(60)]
    docs = edge_docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    got = quality_rules(docs).collect()
    want = sorted((d or -1, *brute_rules(t)) for d, t in docs.collect())
    assert sorted((r["doc_id"] or -1, r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == want
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    backwards = quality_rules(docs, rules=RULES[::-1]).collect()
    assert sorted(map(str, backwards)) == sorted(map(str, got))
    assert quality_rules(empty_docs).count() == 0


LANGS = {"aa": "the of and to in is that it was for", "bb": "der die und das ist nicht ein mit von auch", "cc": "que los las una por para con del como pero"}


def lang_text(rng, lang, n):
    return " ".join(rng.choice(LANGS[lang].split()) for _ in range(n))


def test_language_id_on_held_out_texts(spark, edge_docs, empty_docs):
    rng = random.Random(9)
    model = language_id.fit({k: [lang_text(rng, k, 200) for _ in range(4)] for k in LANGS})
    truth = {i: rng.choice(list(LANGS)) for i in range(200)}
    df = spark.createDataFrame([(i, lang_text(rng, k, rng.choice([4, 20, 3000]))) for i, k in truth.items()], "doc_id long, text string").withColumn("lang", F.lit("cc"))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(df, model).collect()}
    assert sum(got[i][0] == k for i, k in truth.items()) >= 198 and all(0 <= s <= 1 for _, s in got.values())
    edge = language_id.identify(edge_docs, model).collect()
    assert len(edge) == edge_docs.count() and {r["lang_pred"] for r in edge if r["doc_id"] in (1, 2, 3)} == {"und"}
    assert language_id.identify(empty_docs, model).count() == 0
    none = language_id.fit({})
    assert {(r["lang_pred"], r["score"]) for r in language_id.identify(edge_docs, none).collect()} == {("und", 0.0)}


def test_phrases_are_the_greedy_parse():
    rng = random.Random(10)
    train = "".join(rng.choice("abc ") for _ in range(300))
    model = language_id.fit({"x": [train]})
    codes = model.codes()
    squeezed = re.sub(" +", " ", train)
    known = (squeezed if squeezed[0] != " " else squeezed) + " "
    for _ in range(100):
        text = re.sub(" +", " ", "".join(rng.choice("abc d") for _ in range(rng.randrange(1, 60))))
        at, want = 0, 0
        while at < len(text):
            n = 0
            while at + n < len(text) and text[at : at + n + 1] in known:
                n += 1
            at += max(1, n)
            want += 1
        got = language_id.phrases(model, [codes[language_id.points(text)]], 1 << 20)
        assert got[0, 0] == want, text


def test_classifier_learns_and_scores_whole_texts(spark, edge_docs, empty_docs):
    rng = random.Random(11)
    good = lambda n: lang_text(rng, "aa", n)
    bad = lambda n: " ".join(w + rng.choice(["$$$", "%%%", "###"]) for w in good(n).split())
    sample = [(good(rng.randrange(1, 300)), 1) for _ in range(200)] + [(bad(rng.randrange(3, 300)), 0) for _ in range(200)]
    net = quality_cnn.train([t.encode() for t, _ in sample], [y for _, y in sample], epochs=6)
    held = [(good(rng.randrange(3, 500)), 1) for _ in range(60)] + [(bad(rng.randrange(3, 500)), 0) for _ in range(60)]
    scores = quality_cnn.scores(net, [t.encode() for t, _ in held])
    assert np.mean((scores >= 0.5) == np.array([y for _, y in held])) >= 0.97
    alone = [quality_cnn.scores(net, [t.encode()])[0] for t, _ in held[:20]]
    assert np.allclose(alone, scores[:20], atol=1e-4)  # neighbours in a batch don't matter
    late = (good(3000) + " " + bad(3000)).encode()
    assert quality_cnn.scores(net, [late])[0] < quality_cnn.scores(net, [late[: len(late) // 3]])[0]  # the end counts
    got = quality_cnn.classify(edge_docs, net).collect()
    assert len(got) == edge_docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert quality_cnn.classify(empty_docs, net).count() == 0
    assert quality_cnn.keep_good(edge_docs, net).columns == edge_docs.columns


def test_classifier_without_two_classes(spark, edge_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    net = quality_cnn.fit(edge_docs, labels, F.lit(True))
    assert {r["score"] for r in quality_cnn.classify(edge_docs, net).collect()} == {0.5}


def test_classifier_samples_only_usable_labels(spark, edge_docs):
    labels = spark.createDataFrame([(100 + i, i % 2) for i in range(40)] + [(100, 0), (None, 1), (101, None)], "doc_id long, quality int")
    texts, ys = quality_cnn.labelled_sample(edge_docs, labels, F.col("doc_id") < 120, "doc_id", "text", "quality", 5, 100)
    assert len(texts) == 10 and sum(ys) == 5 and all(len(t.decode()) <= 100 for t in texts)


def test_similar_classes_with_the_querys_parameters(spark):
    docs = near_docs(7, 200) + [(1000 + i, " ".join(f"u{j}" for j in range(60)) + f" tail{i % 25}") for i in range(60)]
    for cell in (8, 1024):
        got = similar_classes(spark.createDataFrame(docs, "doc_id long, text string"), words=4, percent=85, best_rounds=1, cell=cell).collect()
        assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_classes(docs, 4, 85)


def test_best_partners_piece_by_piece():
    rng = np.random.default_rng(4)
    n = 40
    sizes = rng.integers(5, 30, n)
    a, b = np.triu_indices(n, 1)
    overlap = rng.integers(0, 5, len(a))
    like = {}
    for i, j, o in zip(a.tolist(), b.tolist(), overlap.tolist(), strict=True):
        for x, y in ((i, j), (j, i)):
            like.setdefault(x, []).append((-o / (sizes[i] + sizes[j] - o), y))
    want = {(min(x, min(ys)[1]), max(x, min(ys)[1])) for x, ys in like.items()}
    partners = BestPartners(sizes)
    order = rng.permutation(len(a))
    for k in range(0, len(a), 7):
        at = order[k : k + 7]
        partners.add(a[at], b[at], overlap[at])
    assert set(zip(*(x.tolist() for x in partners.pairs()), strict=True)) == want


def test_signature_tree_across_two_sides():
    rng = np.random.default_rng(2)
    base = np.unique(rng.integers(0, 1 << 63, 80, dtype=np.uint64))
    sets = [np.unique(np.concatenate([base, rng.integers(0, 1 << 63, 2, dtype=np.uint64)])) for _ in range(50)]
    sizes, sig = np.array([len(s) for s in sets]), np.frombuffer(b"".join(map(bitmap, sets)), np.uint8).reshape(len(sets), -1)
    side = rng.integers(0, 2, len(sets))
    got = {(min(i, j), max(i, j)) for a, b, _ in SignatureTree(sizes, sig, np.arange(50), side).pairs(80) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
    assert got == {(i, j) for i in range(50) for j in range(i + 1, 50) if side[i] != side[j]}
    a, b, _ = close_pairs(sizes, sig, np.arange(50), np.zeros(50, int), 80, side)
    assert {(min(i, j), max(i, j)) for i, j in zip(a.tolist(), b.tolist(), strict=True)} == got


def test_one_of_each_with_clashing_names(spark):
    rows = [(1, "one two three four five six", "a", "b", "x"), (2, "one two three four five six", "c", "d", "y"), (3, "other words stand in this row", "e", "f", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept_id string, _row string, id string")
    assert sorted(map(tuple, one_of_each(df).collect())) == [rows[0], rows[2]]
    again = df.union(df.filter("doc_id = 3"))
    assert sorted(map(tuple, one_of_each(again).collect())) == [rows[0], rows[2]]


def brute_phrases(known, text):
    at, n = 0, 0
    while at < len(text):
        k = 0
        while at + k < len(text) and text[at : at + k + 1] in known:
            k += 1
        at += max(1, k)
        n += 1
    return n


def test_phrases_and_choice_of_long_texts_are_the_greedy_parse():
    rng = random.Random(15)
    train = {k: " ".join(rng.choice(LANGS[k].split()) for _ in range(300)) for k in LANGS}
    model = language_id.fit({k: [t] for k, t in train.items()})
    codes = model.codes()
    texts = [lang_text(rng, rng.choice(list(LANGS)), n) for n in (1, 5, 300, 900, 1500)] + ["".join(rng.choice("abcdeqz ") for _ in range(4000))]
    texts = [re.sub(" +", " ", t) for t in texts]
    want = [[brute_phrases(train[k] + " ", t) for k in model.langs] for t in texts]
    for block in (1, 7, 64, 1024, 1 << 20):
        got = language_id.phrases(model, [language_id.symbols_of(codes[language_id.points(t)]) for t in texts], block)
        assert got.tolist() == want, block
    predicted = list(language_id.predict(model, codes, texts, 1024))
    for (lang, score), row in zip(predicted, want, strict=True):
        costs = [n * b for n, b in zip(row, model.bits, strict=True)]
        assert lang == model.langs[int(np.argmin(costs))] and abs(score - (1 - sorted(costs)[0] / sorted(costs)[1])) < 1e-9


def test_language_id_of_large_scripts():
    """More letters than an automaton has symbols: each is known, and texts are told apart."""
    rng = random.Random(16)
    many = {"xx": [chr(0x4E00 + i) for i in range(3000)], "yy": [chr(0x4E00 + i) for i in range(2500, 6000)], "zz": [chr(0xAC00 + i) for i in range(9000)]}
    text = lambda k, n: "".join(rng.choice(many[k]) for _ in range(n))
    model = language_id.fit({k: [text(k, 3000) for _ in range(3)] for k in many})
    codes = model.codes()
    letters = list(model.code_of)
    assert len({tuple(language_id.symbols_of(codes[[c]]).tolist()) for c in letters}) == len(letters) > 10_000
    assert model.width == 128 and max(language_id.symbols_of(codes[letters])) < 127
    truth = [rng.choice(list(many)) for _ in range(60)]
    got = [k for k, _ in language_id.predict(model, codes, [text(k, 200) for k in truth], 64)]
    assert got == truth


def test_language_id_tables_are_bounded():
    texts = {f"l{i}": [" ".join(random.Random(i).choice(["ab", "cd", "ef"]) for _ in range(3000))] for i in range(40)}
    model = language_id.fit(texts, total_bytes=2_000_000)
    assert model.steps.nbytes <= 2_000_000 and len(model.langs) == 40


def test_held_out_rows_teach_language_id_nothing(spark, tmp_path):
    import zlib

    from tessella.llm.queries import op1_language_id

    rng = random.Random(17)
    rows = [(i, lang_text(rng, k, 80), k) for i in range(160) for k in [rng.choice(list(LANGS))]]
    held = {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    other = [(i, t if i not in held else "zzz qqq " * 30, k if i not in held else "dd") for i, t, k in rows]
    got = []
    for name, data in (("a", rows), ("b", other)):
        spark.createDataFrame(data, "doc_id long, text string, lang string").write.parquet(str(tmp_path / name / "documents.parquet"))
        got.append({r["doc_id"]: (r["held_out"], r["lang_pred"], r["score"]) for r in op1_language_id(spark, str(tmp_path / name)).collect()})
    assert {i for i, r in got[0].items() if r[0]} == held and held
    assert all(got[0][i] == got[1][i] for i, *_ in rows if i not in held) and not any(r[1] == "dd" for r in got[1].values())


def test_spread_takes_pieces_of_all_parts(spark):
    from tessella.llm.common import spread

    text = "".join(chr(0x4E00 + i) for i in range(1000))
    short, long = spark.createDataFrame([("a", text[:60]), ("b", text)], "id string, text string").select(spread("text", F.col("id"), 80)).collect()
    assert short[0] == text[:60] and len(long[0]) <= 80
    pieces = long[0].split("\n")
    assert [text.index(p) // 250 for p in pieces] == [0, 1, 2, 3] and all(p in text for p in pieces)


def brute_score(net, text):
    """The network's probability, place by place and chunk by chunk."""
    step, part = quality_cnn.STRIDE, quality_cnn.PART
    n = max(1, -(-len(text) // (part * step)))
    data = np.frombuffer(text + bytes((n + 1) * part * step + quality_cnn.WIDTH - len(text)), np.uint8)
    see = lambda place: np.concatenate([net.embed[b] for b in data[place * step : place * step + quality_cnn.WIDTH]]) @ net.filters
    empty = np.concatenate([net.embed[0]] * quality_cnn.WIDTH) @ net.filters
    span = (quality_cnn.CHUNK - 1) * step + quality_cnn.WIDTH
    logits, start = [], 0
    while True:
        places = range(start, min(start + quality_cnn.CHUNK, n * part))
        best = np.max([see(p) for p in places], axis=0)
        filled = min(1.0, (len(text) - start * step) / span)
        if filled < 1:
            best = np.maximum(best, empty)
        pooled = np.maximum(best + net.shift, 0)
        logits.append(pooled @ net.out + np.array([filled, filled**0.5, filled**4]) @ net.fill + net.bias)
        start += quality_cnn.HOP
        if start + quality_cnn.CHUNK - quality_cnn.HOP >= n * part:
            return 1 / (1 + np.exp(-np.mean(logits)))


def test_scores_are_a_plain_convolution_over_every_chunk():
    rng = np.random.default_rng(3)
    net = quality_cnn.Network(*[rng.normal(0, 0.3, s).astype(np.float32) for s in ((256, 8), (64, 48), (48,), (48,), (3,))], bias=0.1)
    texts = [bytes(rng.integers(32, 127, n, dtype=np.uint8)) for n in (0, 1, 7, 64, 65, 447, 448, 449, 511, 512, 513, 900, 1024, 3000)]
    assert np.allclose(quality_cnn.scores(net, texts), [brute_score(net, t) for t in texts], atol=1e-4)


def test_keep_good_in_small_pieces(spark):
    rng = np.random.default_rng(3)
    net = quality_cnn.Network(*[rng.normal(0, 0.5, s).astype(np.float32) for s in ((256, 8), (64, 48), (48,), (48,), (3,))])
    rows = [(i, "x" * (i % 40) + chr(97 + i % 26) * (i % 300), i) for i in range(200)] + [(200, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row long")
    scores = quality_cnn.scores(net, [(t or "").encode() for _, t, _ in rows])
    ordered = np.sort(scores)
    middle = 90 + int(np.argmax(np.diff(ordered[90:110])))  # between two scores that differ
    cut = float(ordered[middle : middle + 2].mean())
    for most in (1, 5000, 1_000_000):
        kept = {r["doc_id"] for r in quality_cnn.keep_good(df, net, threshold=cut, most=most).collect()}
        assert kept == {i for (i, *_), s in zip(rows, scores, strict=True) if s >= cut}


def test_labelled_sample_with_repeated_ids_and_one_rare_class(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(3000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 100 > 0)) for i in range(3000) for _ in range(3)] + [(7, 0)], "doc_id long, quality int")
    texts, ys = quality_cnn.labelled_sample(docs, labels, F.lit(True), "doc_id", "text", "quality", 20, 100)
    assert len(texts) == len(set(texts)) == 40 and sum(ys) == 20
    assert all((int(t.split()[1]) % 100 > 0 and t != b"text 7") == bool(y) for t, y in zip(texts, ys, strict=True))


def test_rules_where_windows_share_hash_bits(spark, monkeypatch):
    """So few bits for hash and place that texts must be compared, or windows sorted, as words."""
    from tessella.llm import quality_rules as module

    rng = random.Random(18)
    docs = [(i, " ".join(rng.choice(["a", "b", "cc", "dd"]) for _ in range(rng.randrange(120)))) for i in range(60)] + [(60, " ".join(f"w{i}" for i in range(90)))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for places in ((1 << 61) - 1, 15, (1 << 22) - 1):
        monkeypatch.setattr(module, "_PLACES", places)
        got = {r["doc_id"]: r["n_repeat_words"] for r in module.measured(df).select("doc_id", "n_repeat_words").collect()}
        assert got == {i: brute_rules(t)[4] for i, t in docs}


def test_rule_order_follows_rejections_per_cost(spark):
    from tessella.llm.quality_rules import Rule, order_rules

    df = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(60)) + (" #" * 3 if i % 2 else "")) for i in range(80)], "doc_id long, text string")
    rules = [Rule("never", "false"), Rule("dear", "n_symbols > 0", "length(text)"), Rule("cheap", "n_symbols > 0"), Rule("always_dear", "true", "length(text)")]
    for _ in range(2):
        assert [r.name for r in order_rules(df, rules, 500)] == ["cheap", "always_dear", "dear", "never"]


def test_short_items_match_whole_where_asked(spark):
    docs = spark.createDataFrame([(1, "a too short item"), (2, "short too"), (3, "one two three four five six")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "too short"), (2, "one two three four five six"), (3, "two three")], "item_id long, text string")
    for block in (4_000_000, 30):
        got = contamination(docs, bench, block_chars=block, min_item=2).collect()
        assert {(r["doc_id"], r["item_id"], r["coverage"]) for r in got} == {(1, 1, 1.0), (3, 2, 1.0), (3, 3, 1.0)}
        assert [r["doc_id"] for r in decontaminate(docs.withColumn("digest", F.lit("x")), bench, block_chars=block, min_item=2).collect()] == [2]


def test_equal_items_are_dealt_over_blocks(spark):
    docs = spark.createDataFrame([(1, "one two three four five six")], "doc_id long, text string")
    bench = spark.createDataFrame([(i, "one two three four five six") for i in range(40)], "item_id long, text string")
    got = contamination(docs, bench, block_chars=200).collect()
    assert sorted(r["item_id"] for r in got) == list(range(40))
