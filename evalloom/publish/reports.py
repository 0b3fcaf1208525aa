"""Publications: metric, issue and chart reports, annotation tasks and results, rendered reports."""

from __future__ import annotations

import hashlib
import html
import json
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..cells import types as C
from ..cells.frame import CellFrame
from ..script.surface import ScriptError
from ..sources import files

SEVERITIES = ("critical", "high", "medium", "low", "info")
CHART_AGGREGATIONS = ("sum", "count", "avg", "min", "max")
CONSENSUS = ("none", "majority", "unanimous")
#: Most rows that stand in a report's file itself; of more, the executors write a folder that the file names.
MAX_REPORT_ROWS = 100_000


def _errors(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    return F.size(F.coalesce(F.col(f"`{name}`")["metadata"]["errors"], F.array().cast(C.ERRORS))) > 0 if C.is_cell(kind) else F.lit(False)


def metric_rows(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(metrics, issues): rows whose metric is null or whose value is null, errored or no number become issues."""
    missing = {"metric", "value"} - set(df.columns)
    if missing:
        raise ScriptError(f"a METRIC report needs {' and '.join(sorted(missing))}")
    flags = df.withColumn("__err", _errors(df, "value") | _errors(df, "metric"))
    bare = CellFrame(flags).unwrap()
    value = F.col("value").cast("string").try_cast("double")
    good = F.col("metric").isNotNull() & ~F.col("__err") & value.isNotNull() & ~F.isnan(value)
    if "tags" in bare.columns:
        kind = bare.schema["tags"].dataType
        tags = F.map_from_entries("tags") if isinstance(kind, T.ArrayType) else F.col("tags")
        tags = F.transform_values(tags, lambda k, v: v.cast("string"))
    else:
        others = [c for c in bare.columns if c not in ("metric", "value", "__err")]
        pairs = [x for c in others for x in (F.lit(c), F.col(f"`{c}`").cast("string"))]
        tags = F.create_map(*pairs) if pairs else F.expr("CAST(map() AS map<string,string>)")
    metrics = bare.where(good).select(F.col("metric").cast("string").alias("metric"), value.alias("value"), tags.alias("tags"))
    shown = F.coalesce(F.col("metric").cast("string"), F.lit("?"))
    issues = bare.where(~good).select(
        F.lit("Metric row not published").alias("title"), F.lit("medium").alias("severity"), F.concat(F.lit("metric "), shown).alias("detail")
    )
    return metrics, issues


def issue_rows(df: DataFrame) -> DataFrame:
    """Issues with a severity of the known ones, in small letters; others become info."""
    if not {"title", "severity"} <= set(df.columns):
        raise ScriptError("an ISSUE report needs title and severity")
    low = F.lower(F.trim(F.col("severity").cast("string")))
    return CellFrame(df).unwrap().withColumn("severity", F.when(low.isin(*SEVERITIES), low).otherwise("info"))


def chart(df: DataFrame, options: dict[str, Any], place: str) -> dict:
    """A chart's settings with its rows; the aggregation is recorded, the rows are raw."""
    aggregation = str(options.get("AGGREGATION", "avg")).lower()
    if aggregation not in CHART_AGGREGATIONS:
        raise ScriptError(f"aggregation {aggregation} is not one of {', '.join(CHART_AGGREGATIONS)}")
    names = [options.get(k) for k in ("X_AXIS", "Y_AXIS", "GROUP_BY") if options.get(k)]
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ScriptError(f"the chart's table has no {', '.join(missing)}")
    bare = CellFrame(df).unwrap()
    if options.get("SORT"):
        desc = str(options["SORT"]).lower() == "desc"
        y = F.col(f"`{options['Y_AXIS']}`")
        bare = bare.orderBy(y.desc() if desc else y.asc())
    if options.get("LIMIT"):
        bare = bare.limit(int(options["LIMIT"]))
    settings = {k.lower(): v for k, v in options.items() if k != "COMPONENT"}
    return {**settings, "aggregation": aggregation, "rows": records(bare, place)}


def records(df: DataFrame, place: str) -> list[dict]:
    """A report's rows; if they are too many for one file, where the executors have written them."""
    rows = [json.loads(r[0]) for r in df.select(F.to_json(F.struct("*"))).limit(MAX_REPORT_ROWS + 1).collect()]
    if len(rows) <= MAX_REPORT_ROWS:
        return rows
    df.write.mode("append").option("ignoreNullFields", "false").json(place)
    return [{"rows_at": place}]


def append(path: str, items: list[dict]) -> None:
    """Append to a JSON list; the file appears whole or not at all."""
    old = json.loads(files.read_text(path)) if files.exists(path) else []
    files.write_text(path, json.dumps(old + items, ensure_ascii=False, indent=1))


def publish_report(df: DataFrame, name: str, options: dict[str, Any], folder: str) -> None:
    component = str(options["COMPONENT"]).upper()

    def put(kind: str, rows: DataFrame) -> None:
        found = records(rows, f"{folder}/rows/{kind}/{name}")
        if found or kind == component.lower() + "s":
            append(f"{folder}/{kind}.json", [{"table": name, **r} for r in found])

    if component == "METRIC":
        metrics, issues = metric_rows(df)
        put("metrics", metrics)
        put("issues", issues)
    elif component == "ISSUE":
        put("issues", issue_rows(df))
    else:
        append(f"{folder}/charts.json", [{"table": name, **chart(df, options, f"{folder}/rows/charts/{name}")}])


# --- annotations --------------------------------------------------------------------------------------------------


def annotation_settings(options: dict[str, Any]) -> dict:
    """TEMPLATE is needed; reviewers 1-10, reservation 5-1440 minutes, consensus none, majority or unanimous."""
    template = options.get("TEMPLATE")
    if not template:
        raise ScriptError("an annotation queue needs a TEMPLATE")
    check_template(str(template))
    reviewers, minutes = int(options.get("REVIEWERS_PER_TASK", 1)), int(options.get("RESERVATION_MINUTES", 60))
    consensus = str(options.get("CONSENSUS", "none")).lower()
    if not 1 <= reviewers <= 10 or not 5 <= minutes <= 1440 or consensus not in CONSENSUS:
        raise ScriptError("REVIEWERS_PER_TASK is 1-10, RESERVATION_MINUTES 5-1440, CONSENSUS none, majority or unanimous")
    return {"template": template, "reviewers_per_task": reviewers, "reservation_minutes": minutes, "consensus": consensus}


def check_template(text: str) -> None:
    """XML rooted at <View>, without a control that submits."""
    from xml.etree import ElementTree

    try:
        root = ElementTree.fromstring(text)
    except ElementTree.ParseError as e:
        raise ScriptError(f"the annotation template is no XML: {e}") from e
    if root.tag != "View":
        raise ScriptError("the annotation template's root is <View>")
    if any(n.tag.lower() in ("submit", "button") and n.attrib.get("type", "submit") == "submit" for n in root.iter()):
        raise ScriptError("the annotation template has its own submit control")


def publish_annotation(df: DataFrame, name: str, queue: str, alias: str | None, options: dict[str, Any], folder: str) -> str:
    """Tasks as JSONL, written by the executors; the request's id. A task's number is unique, not consecutive."""
    settings = annotation_settings(options)
    request = hashlib.sha256(f"{name}|{queue}|{alias}".encode()).hexdigest()[:16]
    place = f"{folder}/{request}"
    tasks = CellFrame(df).unwrap().select(F.struct("*").alias("data"))
    seen = Observation()
    numbered = tasks.observe(seen, F.count(F.lit(1)).alias("n")).select(F.concat(F.lit(f"{request}-"), F.monotonically_increasing_id() + 1).alias("task_id"), "data")
    numbered.select(F.to_json(F.struct("task_id", "data"), {"ignoreNullFields": "false"})).write.mode("overwrite").text(f"{place}/tasks")
    files.join_parts(f"{place}/tasks", f"{place}/tasks.jsonl")
    record = {"request": request, "table": name, "queue": queue, "alias": alias, "task_count": seen.get["n"], **settings}
    files.write_text(f"{place}/manifest.json", json.dumps(record, indent=1))
    if alias:
        files.write_text(f"{folder}/{alias}.alias", request)
    return request


def retrieve_annotation(spark: SparkSession, folder: str, alias: str | None, request: str | None) -> DataFrame | None:
    """The results of a request; None while there are none."""
    if request is None:
        if not files.exists(f"{folder}/{alias}.alias"):
            return None
        request = files.read_text(f"{folder}/{alias}.alias").strip()
    place = f"{folder}/{request}/results"
    if files.exists(f"{place}.parquet"):
        return spark.read.parquet(f"{place}.parquet")
    for suffix, multi in ((".json", True), (".jsonl", False)):
        if files.exists(place + suffix):
            return spark.read.option("multiLine", multi).json(place + suffix)
    return None


def consensus(reviews: DataFrame, kind: str, reviewers: int) -> DataFrame:
    """(task_id, result, agreed) of reviews (task_id, reviewer, result, submitted_at)."""
    if kind == "none":
        return reviews.groupBy("task_id").agg(F.min_by("result", "submitted_at").alias("result")).withColumn("agreed", F.lit(True))
    counts = reviews.groupBy("task_id", "result").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("task_id").agg(F.max_by("result", "n").alias("result"), F.max("n").alias("most"), F.sum("n").alias("all"))
    enough = F.col("most") >= reviewers // 2 + 1 if kind == "majority" else (F.col("most") == F.col("all")) & (F.col("all") >= reviewers)
    return best.select("task_id", F.when(enough, F.col("result")).alias("result"), enough.alias("agreed"))


# --- rendering ----------------------------------------------------------------------------------------------------


def redact(text: str, secrets: list[str]) -> str:
    for s in sorted(filter(None, secrets), key=len, reverse=True):
        text = text.replace(s, "***")
    return text


def render(folder: str, form: str = "md", secrets: list[str] | None = None) -> str:
    """The reports of a run as one Markdown or HTML text, secrets blacked out."""
    parts: dict[str, list[dict]] = {}
    for kind in ("metrics", "issues", "charts"):
        path = f"{folder}/{kind}.json"
        if files.exists(path):
            parts[kind] = json.loads(files.read_text(path))
    lines = []
    for kind, rows in parts.items():
        lines.append(("h", kind.capitalize()))
        for r in rows:
            if "rows_at" in r:
                lines.append(("i", f"{r.get('table')}: rows in {r['rows_at']}"))
            elif kind == "metrics":
                tags = ", ".join(f"{k}={v}" for k, v in sorted((r.get("tags") or {}).items()))
                lines.append(("i", f"{r.get('metric')}: {r.get('value')}" + (f" ({tags})" if tags else "")))
            elif kind == "issues":
                lines.append(("i", f"[{r.get('severity')}] {r.get('title')}"))
            else:
                lines.append(("i", f"{r.get('chart_type')} of {r.get('y_axis')} by {r.get('x_axis')}, {len(r.get('rows', []))} rows"))
    if form == "html":
        body = "".join(f"<h2>{html.escape(t)}</h2>" if k == "h" else f"<p>{html.escape(t)}</p>" for k, t in lines)
        text = f"<html><body>{body}</body></html>"
    else:
        text = "\n".join(f"## {t}" if k == "h" else f"- {t}" for k, t in lines) + "\n"
    return redact(text, secrets or [])
