"""Tables in the shared folder, indexes and stores on disk."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which driver and executors share; a local folder only where it is unset and all tasks run in this process."""
    sc = spark.sparkContext
    place = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not place:
        if not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        place = tempfile.mkdtemp(prefix="tessella-")
        sc.setCheckpointDir(place)
    return place.rstrip("/")


def scratch(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: the lineage is cut, and no executor's loss matters. Deleted with the application."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tessella-{name}-{uuid.uuid4().hex}"
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def save_store(tables: Mapping[str, DataFrame], path: str, partition: Mapping[str, Sequence[str]] | None = None) -> None:
    """A store: each table replaced under ``path``, partitioned where asked."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        if partition and name in partition:
            writer = writer.partitionBy(*partition[name])
        writer.parquet(f"{path}/{name}")


def open_store(spark: SparkSession, path: str, names: Sequence[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def committed(spark: SparkSession, path: str) -> dict | None:
    """The metadata of the finished build at ``path``, None where none was finished."""
    if not exists(spark, f"{path}/committed/_SUCCESS"):
        return None
    return json.loads(spark.read.text(f"{path}/committed").first()[0])


def commit(spark: SparkSession, path: str, meta: Mapping) -> None:
    """Mark what stands at ``path`` as whole."""
    spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/committed")


def remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def build_once(tables: Mapping[str, DataFrame], path: str, meta: Mapping, rebuild: bool = False) -> bool:
    """Write ``tables`` and then their metadata, unless a finished build with such metadata is there and ``rebuild`` isn't asked; whether they were written.

    A build that ended early has no mark and is made again. ``tables`` must not read from ``path``.
    """
    spark = next(iter(tables.values())).sparkSession
    old = committed(spark, path)
    if old is not None and not rebuild and not is_stale(old, json.loads(json.dumps(meta))):
        return False
    remove(spark, f"{path}/committed")
    save_store(tables, path)
    commit(spark, path, meta)
    return True


def add_vectors(vectors: DataFrame, path: str, key: str = "chunk_id", last: bool = True) -> int:
    """Append the vectors that the index at ``path`` lacks; ``last``: they are all there now. The number of vectors appended."""
    spark = vectors.sparkSession
    remove(spark, f"{path}/committed")
    n = add_missing(vectors, f"{path}/vectors", key)
    if last:
        commit(spark, path, {"rows": spark.read.parquet(f"{path}/vectors").count()})
    return n


def open_vectors(spark: SparkSession, path: str) -> DataFrame:
    """The vectors of a finished index; an error where it is unfinished or holds other than its number of rows."""
    meta = committed(spark, path)
    if meta is None:
        raise ValueError(f"the vector index at {path} is not finished")
    vectors = spark.read.parquet(f"{path}/vectors")
    if (n := vectors.count()) != meta["rows"]:
        raise ValueError(f"the vector index at {path} has {n} rows of {meta['rows']}")
    return vectors


def chunk_view(chunks: DataFrame) -> DataFrame:
    """Chunks of either store under one set of names (the second store has source_tier, source_url and quality)."""
    old = {"source_tier": "source_type", "source_url": "url", "quality": "quality_score", "source_kind": "kind", "source_path": "path", "id": "chunk_id"}
    new = chunks.withColumnsRenamed({a: b for a, b in old.items() if a in chunks.columns and b not in chunks.columns})
    new = new.withColumnRenamed("quality_score", "quality") if "quality" not in new.columns and "quality_score" in new.columns else new
    return new.fillna("", [c for c, k in new.dtypes if k == "string"])


def is_second_store(chunks: DataFrame) -> bool:
    return {"source_tier", "source_url", "quality"} <= set(chunks.columns)


def add_missing(rows: DataFrame, path: str, key: str) -> int:
    """Append the rows whose key the table at ``path`` doesn't hold (a resumable build); the number of rows appended."""
    spark = rows.sparkSession
    new = rows.join(spark.read.parquet(path).select(key), key, "left_anti") if exists(spark, path) else rows
    new = scratch(new, "append")
    n = new.count()
    if n:
        new.write.mode("append").parquet(path)
    return n


def folder_signature(files: DataFrame) -> DataFrame:
    """``file_count, total_size, max_mtime`` of a file listing (``length, modificationTime``)."""
    return files.agg(F.count("*").alias("file_count"), F.coalesce(F.sum("length"), F.lit(0)).alias("total_size"), F.max("modificationTime").alias("max_mtime"))


def is_stale(stored: Mapping, current: Mapping) -> bool:
    """Whether any of the current values differs from the stored ones; keys that only the store has don't matter."""
    return any(stored.get(k) != v for k, v in current.items())


def summary(values: Mapping[str, Column], df: DataFrame) -> DataFrame:
    """``key, value``: aggregates of ``df`` as JSON values."""
    one = df.agg(F.to_json(F.struct(*[v.alias(k) for k, v in values.items()])).alias("j"))
    return one.select(F.explode(F.from_json("j", "map<string,string>")).alias("key", "value"))


def write_csv(df: DataFrame, path: str, bom: bool = False) -> None:
    """CSV with a header; ``bom``: the first column's name starts with the byte order mark that some programs want."""
    out = df.withColumnRenamed(df.columns[0], "﻿" + df.columns[0]) if bom else df
    out.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines with sorted keys."""
    df.select(*sorted(df.columns)).write.mode("overwrite").json(path)


def markdown_table(df: DataFrame, most: int = 200) -> str:
    """A small table (a report's) as markdown."""
    rows = df.limit(most).collect()
    line = lambda cells: "| " + " | ".join("" if c is None else str(c) for c in cells) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *[line(r) for r in rows]])


def union_columns(*tables: DataFrame) -> DataFrame:
    """Rows of all tables, columns in first-seen order, null where a table lacks one."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out
