"""Windows over an event stream. These are an extension: watermarks and late data, for tables and streams alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, schema) -> DataFrame:
    """A stream of Parquet files."""
    return spark.readStream.schema(schema).parquet(folder)


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """``start, event_type, n, total`` of each window; on a stream, events more than ``late`` behind are left out."""
    windowed = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
    return windowed.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """``user_id, start, end, n``: runs of a user's events with no gap as long as ``gap``."""
    windowed = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w"))
    return windowed.agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def index_stream(docs: DataFrame, path: str, checkpoint: str, id_col: str = "doc_id", text_col: str = "text"):
    """A query that keeps a postings table up to date with arriving documents; a restart goes on where the checkpoint is."""
    from ..operators.rank import postings

    def add(batch: DataFrame, number: int) -> None:
        postings(batch, [text_col], id_col).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
