"""Sinks: stage tables, SAVE and datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..cells.frame import CellFrame
from ..script.surface import ScriptError


def save(df: DataFrame, path: str, form: str | None = None) -> None:
    """Overwrite path; cells stay cells. jsonl and ndjson are Spark's json."""
    form = (form or "parquet").lower()
    form = {"jsonl": "json", "ndjson": "json"}.get(form, form)
    if form not in ("parquet", "json", "csv", "delta", "text"):
        raise ScriptError(f"format {form} is not supported")
    writer = df.write.mode("overwrite")
    (writer.option("header", True) if form == "csv" else writer).format(form).save(path)


def dataset(df: DataFrame, path: str) -> None:
    """The values of a table, without cells, as parquet."""
    CellFrame(df).unwrap().write.mode("overwrite").parquet(path)
