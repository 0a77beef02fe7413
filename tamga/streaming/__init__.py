"""Streams: shapes are stateless, so they work on any stream; deduplication and counts keep state under a watermark."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamga import functions as fn
from tamga.operators import extract_words


def shaped_stream(stream: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    return extract_words(stream, text, keep).withColumn("shape", fn.shape_str(F.col("word")))


def first_of_shape(shaped: DataFrame, ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """The first word of each shape within the watermark."""
    return shaped.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).dropDuplicatesWithinWatermark(["shape"])


def shape_counts(shaped: DataFrame, ts: str = "ts", window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """window_start, shape, n."""
    timed = shaped.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    return timed.groupBy(F.window(ts, window), "shape").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), "shape", "n")


def drain(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """All that a bounded stream has, written by the executors as Parquet to a folder that all share: one below
    spark.checkpoint.dir unless it is named."""
    spark = stream.sparkSession
    if folder is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"{shared or tempfile.mkdtemp(prefix='tamga-stream-')}/drained-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start(f"{folder}/rows")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
