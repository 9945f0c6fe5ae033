"""Link graphs: edges of pages, breadth-first frontiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.extract import hrefs, host, joined_url, normal_url, should_follow
from ..sources.stored import scratch


def page_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``src, dst``: distinct links of each page, absolute and normalised, that may be followed."""
    links = pages.select(normal_url(url_col).alias("src"), F.explode(F.array_distinct(hrefs(html_col))).alias("link"))
    out = links.withColumn("dst", normal_url(joined_url("src", "link"))).filter(F.col("dst").isNotNull() & should_follow("dst"))
    return out.select("src", "dst").distinct()


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``src, dst, links``: how many links lead from host to host."""
    found = pages.select(host(url_col).alias("src"), F.explode(hrefs(html_col)).alias("link")).withColumn("dst", host("link"))
    return found.filter("dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("links"))


def bfs(edges: DataFrame, seeds: DataFrame, depth: int, most: int | None = None) -> DataFrame:
    """``node, depth``: what ``seeds`` (``node``) reach in at most ``depth`` steps along ``edges`` (``src, dst``), at the least depth.

    A level is the neighbours of the last one that no level has; levels are written to the shared folder, so the
    lineage stays short. ``most``: no further level once so many nodes are found.
    """
    found = scratch(seeds.select("node").distinct().withColumn("depth", F.lit(0)), "bfs")
    level = found
    for d in range(1, depth + 1):
        near = level.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        level = scratch(near.join(found, "node", "left_anti").withColumn("depth", F.lit(d)), "bfs")
        if not level.limit(1).count():
            break
        found = found.unionByName(level)
        if most is not None and found.count() >= most:
            break
    return found


def frontier_priority(depth_col: str = "depth", start: float = 1.0, decay: float = 0.08, least: float = 0.4):
    """The priority recorded for a page at a depth."""
    return F.greatest(F.lit(start) - F.lit(decay) * F.col(depth_col), F.lit(least))
