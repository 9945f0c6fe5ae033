"""URL allow and block rules in a trie (operator 8).

The trie goes down the host's labels from the last to the first, then the segments of the
path; the longest rule that fits decides, whether it allows or blocks. It is built once on the
driver, where the rule list lives, and broadcast; the number of rules is checked first.

Defined cases: a null url or one without ``://`` has an empty host and path and gets the
default verdict; a url of any length is matched whole; repeated rows are judged alike; an
empty table gives an empty result; no rules at all: everything gets the default; two equal
rules with different verdicts: the block wins; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import ids, in_batches

#: Rules in one broadcast trie (some 100 bytes each).
MOST_RULES = 200_000
#: A-Z alone are lower-cased in hosts.
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def parts(url: str | None) -> tuple[str, str]:
    """(host, path): host after the first ``://`` up to ``/ ? #``, A-Z lower-cased; path up to ``? #``."""
    if url is None or (k := url.find("://")) < 0:
        return "", ""
    rest = url[k + 3 :]
    for mark in "?#":
        rest = rest.partition(mark)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


class Trie:
    """Node: ``labels`` (next host label), ``paths`` (root of the path trie below this host). Path node: ``next`` by whole segment, ``ends`` by a beginning of the next one."""

    def __init__(self, rules: Sequence[tuple[str, str]]):
        self.root: dict = {"labels": {}}
        for verdict, rule in rules:
            host, slash, path = rule.partition("/")
            node = self.root
            for label in reversed(host.translate(_LOWER).split(".")) if host else ():
                node = node["labels"].setdefault(label, {"labels": {}})
            segments = (slash + path).split("/")  # the first is empty; the last may be the beginning of one
            leaf = node.setdefault("paths", {"next": {}, "ends": {}, "longest": 0})
            for segment in segments[:-1]:
                leaf = leaf["next"].setdefault(segment, {"next": {}, "ends": {}, "longest": 0})
            leaf["longest"] = max(leaf["longest"], len(segments[-1]))
            old = leaf["ends"].get(segments[-1])
            if old is None or verdict == "block":
                leaf["ends"][segments[-1]] = (rule, verdict)

    @staticmethod
    def _path(leaf: dict, path: str) -> tuple[str, str] | None:
        found = None
        segments = path.split("/")
        for i, segment in enumerate(segments):
            ends = leaf["ends"]
            if ends:
                for n in range(min(len(segment), leaf["longest"]), -1, -1):
                    if segment[:n] in ends:
                        found = ends[segment[:n]]
                        break
            if i + 1 == len(segments) or (leaf := leaf["next"].get(segment)) is None:
                break
        return found

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """The longest rule that fits (most labels of host first, then the longest path) and its verdict."""
        node, found = self.root, None
        for label in reversed(host.split(".")):
            if (node := node["labels"].get(label)) is None:
                break
            if "paths" in node and (got := self._path(node["paths"], path)) is not None:
                if found is None or len(got[0]) > len(found[0]):
                    found = got
        return found


def url_verdicts(pages: DataFrame, rules: Sequence[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", default: str = "allow", most_rules: int = MOST_RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for each row; ``rules`` are ``(allow or block, host/path)``."""
    if bad := [r for r in rules if r[0] not in ("allow", "block") or r[1][:1] in ("", "/")]:
        raise ValueError(f"a rule allows or blocks a host, unlike {bad[0]!r}")
    spark = pages.sparkSession
    out = pages.select(pages[id_col].alias("page_id"), pages[url_col].cast("string").alias("url"))
    if len(rules) > most_rules:
        raise ValueError(f"{len(rules)} rules are more than the {most_rules} that may be broadcast; split them by host")
    string = [T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict")]
    schema = T.StructType([out.schema["page_id"], *string])
    arrow = to_arrow_schema(schema)
    trie = spark.sparkContext.broadcast(Trie(rules))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(batch: pa.RecordBatch):
            for page_id, url in zip(ids(batch, "page_id"), batch.column(1).to_pylist(), strict=True):
                host, path = parts(url)
                yield page_id, host, path, *(trie.value.find(host, path) or (None, default))

        for batch in batches:
            yield from in_batches(rows(batch), arrow)

    return out.mapInArrow(judge, schema)
