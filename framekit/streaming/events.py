"""Streaming counterparts of the aggregations: a superset, with the same expressions over Structured Streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, path: str, like: str, files_per_trigger: int = 1) -> DataFrame:
    """New parquet files under ``path``, with the schema of ``like``."""
    return spark.readStream.schema(spark.read.parquet(like).schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed(df: DataFrame, time: str, size: str, slide: str | None = None, late: str | None = None, by: list[str] | None = None, **aggregates: Column) -> DataFrame:
    """Tumbling or sliding windows with a watermark; works on batches and streams alike."""
    rows = df.withColumn(time, F.col(time).cast("timestamp"))
    rows = rows.withWatermark(time, late) if late else rows
    window = F.window(time, size, slide) if slide else F.window(time, size)
    out = rows.groupBy(window.alias("w"), *(by or [])).agg(*[e.alias(n) for n, e in aggregates.items()])
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("start"), *(by or []), *aggregates)


def sessions(df: DataFrame, time: str, gap: str, by: list[str], late: str | None = None, **aggregates: Column) -> DataFrame:
    rows = df.withColumn(time, F.col(time).cast("timestamp"))
    rows = rows.withWatermark(time, late) if late else rows
    out = rows.groupBy(F.session_window(time, gap).alias("w"), *by).agg(*[e.alias(n) for n, e in aggregates.items()])
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), *by, *aggregates)


def drain(df: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """All that a stream has now, in a memory table: for tests and small states."""
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
