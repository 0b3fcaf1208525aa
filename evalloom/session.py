"""Session helpers: table reading, checkpoint folder, lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table, a parquet file or a folder of them."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; only where it is unset (a local test session) an own one."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="evalloom-checkpoint-")
    sc.setCheckpointDir(configured)
    return configured


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path below the shared checkpoint folder, which all executors see; Spark makes it."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def ship(spark: SparkSession) -> str:
    """Send this package to the executors of a cluster that don't have it installed; the archive's path."""
    import shutil

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    # On the driver's own disk, from where Spark hands it to each executor.
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="evalloom-ship-"), "evalloom"), "zip", root, "evalloom")
    spark.sparkContext.addPyFile(archive)
    return archive


def cut(df: DataFrame) -> DataFrame:
    """Reliable lineage cut: computed once, kept in the shared checkpoint folder, survives lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Round-robin (or by key) over enough partitions for CPU-heavy Python stages over few input splits."""
    parts = max(shuffle_parts(df.sparkSession), df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(parts, *keys) if keys else df.repartition(parts)


def local_session(app: str = "evalloom", cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session for tests, the bench and the command line."""
    cpus = cpus or os.cpu_count() or 2
    builder = (
        SparkSession.builder.appName(app)
        .master(f"local[{cpus}]")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark

