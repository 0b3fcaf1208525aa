"""Streams: stages drained with availableNow, and event-time windows.

A stream stage reads its upstream tables as file streams with their known schemas and appends; it blocks until
all that was there is processed. The checkpoint folder makes a second run take only what is new.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..script.surface import ScriptError
from ..session import scratch
from ..sources import files


def source(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stored table as a file stream."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def in_batches(df: DataFrame, path: str, rows: int, key: str | None = None) -> int:
    """Write a table as files of about `rows` rows each, for a stream that takes one file at a time; the number of files."""
    n = max(1, -(-df.count() // rows))
    parts = df.repartitionByRange(n, key) if key else df.repartition(n)
    parts.write.mode("overwrite").option("maxRecordsPerFile", rows).parquet(path)
    return n


def drain(df: DataFrame, path: str, checkpoint: str, mode: str = "append", listener: list | None = None) -> None:
    """Run a stream over all that is available and wait for its end."""
    if not df.isStreaming:
        raise ScriptError("a stream table needs a streaming source")
    query = df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if listener is not None:
        listener += [p["numInputRows"] for p in query.recentProgress]


def drain_to_table(df: DataFrame, mode: str, checkpoint: str | None = None, folder: str | None = None, keys: list[str] | None = None) -> DataFrame:
    """Run a stream in any mode; the rows of its last state.

    Each batch is written by foreachBatch under its number: complete batches replace all before, those of update
    mode replace the rows of the same keys, which must be named, and those of append mode add rows. A batch that
    runs again overwrites itself. Without a folder, one below the shared checkpoint folder is made.
    """
    if mode == "update" and not keys:
        raise ScriptError("update mode needs the keys whose rows replace each other")
    folder = folder or scratch(df.sparkSession, "stream")
    out = f"{folder}/out"
    query = (
        df.writeStream.outputMode(mode)
        .foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={n}"))
        .option("checkpointLocation", checkpoint or f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    spark = df.sparkSession
    if not files.exists(out):
        return spark.createDataFrame([], df.schema)
    rows = spark.read.parquet(out)
    if mode == "update":
        last = F.max_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), F.col("batch"))
        return rows.groupBy(*keys).agg(last.alias("__last")).select("__last.*")
    return rows if mode == "complete" else rows.drop("batch")


def tumbling(df: DataFrame, time: str, size: str, keys: list[str], aggregates: list[Column], delay: str | None = None, slide: str | None = None) -> DataFrame:
    """Tumbling (or, with slide, sliding) event-time windows; with a delay late rows are dropped and state is freed."""
    if delay:
        df = df.withWatermark(time, delay)
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return df.groupBy(w, *keys).agg(*aggregates)


def sessions(df: DataFrame, time: str, gap: str, keys: list[str], aggregates: list[Column], delay: str | None = None) -> DataFrame:
    """Session windows: activity of a key without a gap of that length."""
    if delay:
        df = df.withWatermark(time, delay)
    return df.groupBy(F.session_window(time, gap), *keys).agg(*aggregates)
