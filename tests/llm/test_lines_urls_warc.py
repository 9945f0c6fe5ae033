import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessella.llm.line_dedup import Bits, line_dedup
from tessella.llm.url_filter import Trie, parts, url_verdicts
from tessella.llm.warc import read_archive, write_archive


def brute_lines(docs, least, keep):
    keys = lambda t: [re.sub(r"^[ \t-\r]+|[ \t-\r]+$", "", x).translate({c: c + 32 for c in range(65, 91)}) for x in (t or "").split("\n")]
    count = Counter(k for _, t in docs for k in set(keys(t)) if k)
    first = {}
    for d, t in docs:
        for i, k in enumerate(keys(t)):
            if k and count[k] >= least and d is not None and (k not in first or (d, i) < first[k]):
                first[k] = (d, i)
    out = []
    for d, t in docs:
        lines, gone, seen = (t or "").split("\n"), [], set()
        for i, k in enumerate(keys(t)):
            gone.append(k != "" and count[k] >= least and not (keep == "first" and first.get(k) == (d, i) and k not in seen))
            seen.add(k)
        stay = "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)
        out.append((d or -1, len(lines), sum(gone), hashlib.sha256(stay.encode()).hexdigest(), stay))
    return sorted(out)


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("most", [0, 1000])
def test_line_dedup_is_exact(edge_docs, keep, most):
    docs = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    got = line_dedup(edge_docs.repartition(5), min_docs=3, keep=keep, most_keys=most, log2_bits=10, filter_tasks=2).collect()
    assert sorted((r["doc_id"] or -1, r["n_lines"], r["n_dropped"], r["kept_sha256"], r["kept_text"]) for r in got) == brute_lines(docs, 3, keep)


def test_line_dedup_carries_columns(edge_docs, empty_docs):
    got = line_dedup(edge_docs, min_docs=2, carry=["row", "key"])
    assert sorted(str(r["carried"]["key"]) for r in got.collect()) == sorted(str(r["key"]) for r in edge_docs.collect())
    assert line_dedup(empty_docs).count() == 0


def test_bloom_bits_have_no_false_negatives():
    import numpy as np

    hashes = np.random.default_rng(0).integers(0, 1 << 63, 500, dtype=np.uint64)
    bits = Bits(12)
    bits.add(hashes)
    assert bits.test(hashes).all() and not Bits(12).test(hashes).any()


RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"), ("block", "a.b.com/x/y"), ("allow", "b.com/x/yz"), ("block", "b.com/x")]


def brute_verdict(url):
    rest = url.partition("://")[2] if url and "://" in url else ""
    rest = re.split(r"[?#]", rest)[0]
    host, path = re.match(r"([^/]*)(.*)", rest, re.S).groups()
    host = host.translate({c: c + 32 for c in range(65, 91)})
    fit = [(len(r), r, v) for v, r in RULES for h, p in [r.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return (host, path, *((max(fit)[1], max(fit)[2]) if fit else (None, "allow")))


def test_url_verdicts(spark):
    hosts = ["org", "EXAMPLE.org", "m.example.org", "xexample.org", "a.com", "a.b.com", "c.a.b.com", "b.com:80", "", "org."]
    urls = [f"http://{h}{p}" for h in hosts for p in ("", "/", "/es/", "/es", "/en/1", "/en/12/3", "/en/2", "/fr/x?q=/de/", "/de/#x", "/x/y", "/x/yzz", "/xx", "?/es/", "//es/")] + [None, "", "no scheme/es/", "://example.org/es/", "a://b://c"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("rule", F.lit(1))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_verdicts(df, RULES).collect()}
    assert got == {i: brute_verdict(u) for i, u in enumerate(urls)}
    assert url_verdicts(df.limit(0), RULES).count() == 0
    assert {r["verdict"] for r in url_verdicts(df, []).collect()} == {"allow"}
    with pytest.raises(ValueError):
        url_verdicts(df, [("deny", "org/")])
    with pytest.raises(ValueError):
        url_verdicts(df, RULES, most_rules=2)


def test_equal_rules_block_wins():
    assert Trie([("allow", "a.org/"), ("block", "a.org/")]).find(*parts("http://a.org/")) == ("a.org/", "block")


def test_warc_round_trip(spark, tmp_path):
    big = "ü" * 700
    rows = [(1, "http://a/", big), (2, "http://b/", big), (3, None, big), (3, None, big), (4, "http://c/\r\nX: y", "small"), (5, "u", "small"), (6, "u", None), (7, "u", ""), (None, "u", big), (None, "v", "only" * 400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit(0))
    write_archive(pages, str(tmp_path / "a"))
    assert spark.read.parquet(str(tmp_path / "a/payloads")).count() == 4
    got = read_archive(spark, str(tmp_path / "a")).collect()
    assert len(got) == len(rows)
    assert sorted((bytes(r["payload"]), r["digest"]) for r in got) == sorted(((h or "").encode(), hashlib.sha1((h or "").encode()).hexdigest()) for *_, h in rows)
    kinds = Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in got)
    assert kinds[("3", "response", None)] == 2 and kinds[("1", "revisit", "3")] == 1 and kinds[(None, "revisit", "3")] == 1 and kinds[(None, "response", None)] == 1
    for r in got:
        head, record = bytes(r["head"]), bytes(r["record"])
        fields, _, http = head.partition(b"\r\n\r\n")
        assert fields.startswith(b"WARC/1.0\r\nWARC-Type: ") and http.startswith(b"HTTP/1.1 200 OK\r\n")
        length = int(re.search(rb"Content-Length: (\d+)", fields)[1])
        assert len(record) == len(fields) + 4 + length + 4 and record.endswith(b"\r\n\r\n")


def test_warc_notices_damage(spark, tmp_path):
    path = str(tmp_path / "b")
    write_archive(spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string"), path)
    spark.read.parquet(f"{path}/payloads").select("key", F.lit(b"y").alias("payload")).write.parquet(f"{path}2/payloads")
    spark.read.parquet(f"{path}/heads").write.parquet(f"{path}2/heads")
    with pytest.raises(Exception, match="does not match"):
        read_archive(spark, f"{path}2").collect()


def test_warc_of_nothing(spark, tmp_path):
    write_archive(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "c"))
    assert read_archive(spark, str(tmp_path / "c")).count() == 0


def test_line_dedup_with_overfull_filters_and_joined_keys(spark):
    """Filters that suspect all, and too many repeated keys to broadcast: the most frequent are, the others joined; long keys too."""
    rng = random.Random(21)
    lines = [f"line number {i} " + "long " * (i % 20) for i in range(60)]
    docs = [(i, "\n".join(["in every document", *rng.sample(lines, rng.randrange(12))])) for i in range(150)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for keep in ("none", "first"):
        want = sorted((r["doc_id"], r["n_dropped"], r["kept_sha256"]) for r in line_dedup(df, min_docs=10, keep=keep).collect())
        for how in ({"log2_bits": 8}, {"most_keys": 2}, {"most_key_bytes": 300, "log2_bits": 8}):
            got = sorted((r["doc_id"], r["n_dropped"], r["kept_sha256"]) for r in line_dedup(df, min_docs=10, keep=keep, **how).collect())
            assert got == want, how
    often = Counter(k for _, t in docs for k in {x.strip() for x in t.split("\n")})
    none = {r["doc_id"]: r["n_dropped"] for r in line_dedup(df, min_docs=10).collect()}
    assert none == {i: sum(often[x.strip()] >= 10 for x in t.split("\n")) for i, t in docs}


def test_rule_hosts_are_in_any_case(spark):
    pages = spark.createDataFrame([(1, "https://www.EXAMPLE.org/a/b")], "page_id long, url string")
    assert url_verdicts(pages, [("block", "Example.org/a")]).first()["verdict"] == "block"
