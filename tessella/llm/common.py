"""What the operators of this subpackage share: the shared folder, scratch tables, column picking."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows handed to one Arrow batch that an operator returns.
OUT_ROWS = 4096


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a local one only where that is unset and all tasks run in this process."""
    sc = spark.sparkContext
    place = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        place = sc.getCheckpointDir()
    if not place:
        if not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        place = tempfile.mkdtemp(prefix="tessella-")
        sc.setCheckpointDir(place)
    return place.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/tessella-{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: later reads neither recompute it nor depend on one executor."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Remove a table made by ``written`` once nothing lazy depends on it."""
    spark = df.sparkSession
    for path in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        if "/tessella-" in path:
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def bounded_batches(df: DataFrame, most: int = 1000) -> DataFrame:
    """``df``; from now on the session hands Python at most ``most`` rows at once, so that long texts don't fill workers."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key)) <= most:
        df.sparkSession.conf.set(key, str(most))
    return df


def pick(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only id and text, under fixed names, whatever else the table holds."""
    bounded_batches(docs)
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))


def texts(batch: pa.RecordBatch, name: str = "text") -> Iterator[tuple[int, str | None]]:
    """(row number, text) of a batch, one string at a time."""
    column = batch.column(batch.schema.get_field_index(name))
    for i in range(len(column)):
        yield i, column[i].as_py()


def ids(batch: pa.RecordBatch, name: str = "doc_id") -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def in_batches(rows: Iterable[tuple], schema: pa.Schema, most: int = OUT_ROWS) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most ``most`` rows from an iterator of tuples."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def fresh(columns: Sequence[str], base: str) -> str:
    """A name that none of ``columns`` has in any case of its letters."""
    taken, name = {c.lower() for c in columns}, base
    while name in taken:
        name += "_"
    return name


def unit_hash(*columns) -> Column:
    """A number from 0 to 1 that a hash of the columns gives: rows below a share are a sample that does not depend on partitions."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(float(1 << 53))


def share_for(most: int, count: int) -> float:
    """The share of ``count`` rows that a hash takes so that ``most`` of them are there almost surely, and few more."""
    return min(1.0, (most + 6 * most**0.5 + 10) / max(1, count))


def spread(text, seed, chars: int, pieces: int = 4) -> Column:
    """At most ``chars`` characters of a text: whole if it is short, else pieces at a place that a hash of ``seed`` gives in each of its equal stretches."""
    text = F.col(text) if isinstance(text, str) else text
    each, stretch = chars // pieces - 1, F.floor(F.length(text) / pieces).cast("int")
    parts = [F.substring(text, stretch * k + 1 + F.pmod(F.xxhash64(seed, F.lit(k)), F.greatest(stretch - each, F.lit(1))).cast("int"), F.lit(each)) for k in range(pieces)]
    return F.when(F.length(text) <= chars, text).otherwise(F.concat_ws("\n", *parts))


def crc_mod(id_col: str, n: int):
    """crc32 of the id as text, modulo n (a fixed split of rows)."""
    return F.crc32(F.col(id_col).cast("string")) % F.lit(n)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete shuffle files that no plan needs any more: it does so when the driver collects its garbage, which may otherwise take long."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
