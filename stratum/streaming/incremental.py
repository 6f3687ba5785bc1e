"""Streams of snapshots: the incremental re-read, and windowed totals with late data bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def new_snapshots(spark: SparkSession, path: str, schema: str, max_files: int = 1000) -> DataFrame:
    """Snapshot files as they appear."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def once_each(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Drops repeats of an id that come within the watermark; state is bounded by it."""
    return stream.withWatermark("time", late).dropDuplicatesWithinWatermark(["id"])


def window_totals(stream: DataFrame, width: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Snapshots and bytes of each host and window of time."""
    w = F.window("time", width, slide) if slide else F.window("time", width)
    return stream.withWatermark("time", late).groupBy(w, "hostname").agg(F.count("*").alias("n"), F.sum("summary.total_bytes_processed").alias("size")) \
        .select(F.col("window.start").alias("start"), "hostname", "n", "size")


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of snapshots of one host without a pause of `gap`."""
    return stream.withWatermark("time", late).groupBy(F.session_window("time", gap).alias("w"), "hostname").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "hostname", "n")


def append_new(stream: DataFrame, table_path: str, checkpoint: str) -> StreamingQuery:
    """Appends new snapshots to a table, exactly once for each batch, and stops when all that is there has been read."""
    return stream.writeStream.format("parquet").option("path", table_path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
