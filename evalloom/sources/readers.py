"""Sources: files of the supported formats, read lazily with Spark's own readers."""

from __future__ import annotations

import os
import urllib.request
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import filter_paths
from ..script.surface import ScriptError
from ..session import scratch
from . import files

FORMATS = ("json", "jsonl", "ndjson", "csv", "parquet", "delta", "text", "directory")
SUFFIXES = {".jsonl": "jsonl", ".ndjson": "ndjson", ".json": "json", ".csv": "csv", ".delta": "delta", ".parquet": "parquet", ".txt": "text"}


def classify(path: str) -> str:
    """url, dataset (URI or bare id) or local."""
    if path.startswith(("http://", "https://")):
        return "url"
    if path.startswith("dataset://"):
        return "dataset"
    if "/" not in path and "." not in path:
        return "dataset"
    return "local"


def infer_format(path: str, given: str | None = None) -> str:
    """The format asked for, else that of the suffix; parquet where a local path has none."""
    if given:
        name = given.lower()
        if name.startswith("directory"):
            return "directory"
        if name not in FORMATS:
            raise ScriptError(f"format {given} is not supported")
        return name
    stem = path.removesuffix(".gz").rstrip("/")
    suffix = os.path.splitext(stem)[1].lower()
    if suffix in SUFFIXES:
        return SUFFIXES[suffix]
    if classify(path) == "url":
        raise ScriptError(f"the format of {path} can't be told; give FORMAT")
    return "parquet"


#: Seconds for a remote source to answer.
URL_TIMEOUT = 60.0


def fetch(spark: SparkSession, url: str, form: str) -> str:
    """A remote file copied once into the shared folder, from where the executors read it; the copy's path."""
    gz = ".gz" if url.split("?")[0].endswith(".gz") else ""
    place = f"{scratch(spark, 'url')}/source.{form}{gz}"
    try:
        with urllib.request.urlopen(url, timeout=URL_TIMEOUT) as stream:
            files.copy_from(stream, place)
    except (OSError, ValueError) as e:
        raise ScriptError(f"{url} can't be read: {e}") from e
    return place


def read(spark: SparkSession, path: str, options: dict[str, Any] | None = None, datasets: str | None = None) -> DataFrame:
    """A lazily read source. Dataset ids are folders below `datasets`; files behind URLs are copied to the shared folder first."""
    options = options or {}
    kind = classify(path)
    if kind == "url":
        form = infer_format(path.split("?")[0], options.get("FORMAT"))
        return read(spark, fetch(spark, path, form), {**options, "FORMAT": form})
    if kind == "dataset":
        name = path.removeprefix("dataset://")
        if datasets is None or not files.exists(f"{datasets}/{name}"):
            raise ScriptError(f"dataset {name} is not here")
        path = f"{datasets}/{name}"
    form = infer_format(path, options.get("FORMAT"))
    reader = spark.read
    if form in ("json", "jsonl", "ndjson"):
        return reader.option("multiLine", form == "json").json(path)
    if form == "csv":
        return reader.option("header", True).option("inferSchema", True).option("escape", '"').csv(path)
    if form == "text":
        return reader.text(path)
    if form == "directory":
        df = read_table(spark, path)
        name = "dataset_path" if "dataset_path" in df.columns else df.columns[0]
        return df.where(filter_paths(F.col(name), _list(options.get("INCLUDE_PATHS")), _list(options.get("EXCLUDE_PATHS"))))
    if form == "delta":
        return reader.format("delta").load(path)
    return read_table(spark, path)


def _list(value: Any) -> list[str] | None:
    return None if value is None else [str(v) for v in value] if isinstance(value, list) else [str(value)]


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A parquet table; folders of folders are looked through where the plain read finds no schema."""
    try:
        return spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001
        if "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return spark.read.option("recursiveFileLookup", True).parquet(path)


def list_directory(spark: SparkSession, path: str) -> DataFrame:
    """A directory's files as DirectoryEntry rows, listed by the executors; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).drop("content")
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(
        F.lit(None).cast("string").alias("content_type"), F.col("path").alias("dataset_path"), F.lit("file").alias("entry_type"), F.lit(False).alias("is_empty_dir"),
        name.alias("name"), F.col("path").alias("object_uri"), F.regexp_replace("path", "/[^/]*$", "").alias("parent_path"), "path", F.lit("1").alias("schema_version"),
        F.lit(None).cast("string").alias("sha256"), F.col("length").alias("size_bytes"),
    )
