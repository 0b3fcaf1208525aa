"""Stage manifests: fingerprints, error summaries, reuse of clean stages, rerun analysis."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import __version__
from ..cells import types as C
from ..plans.graph import Step, downstream
from ..script.surface import ScriptError
from ..sources import files


def fingerprint(step: Step, payload: str, upstream: dict[str, str], wrapped: bool = True) -> str:
    """What a stage's result depends on: its text, its inputs' values, the stages before it, and this engine."""
    record = {
        "name": step.makes, "kind": step.kind, "payload": " ".join(payload.split()), "needs": sorted(step.needs),
        "upstream": {n: upstream.get(n) for n in sorted(step.needs)}, "engine": __version__, "wrapped": wrapped,
    }
    return hashlib.sha256(json.dumps(record, sort_keys=True).encode()).hexdigest()


def error_summary(df: DataFrame, samples: int = 10) -> dict:
    """Counts of errors by code and column, in one pass over the stage, and a few samples.

    Codes are few by nature, but functions may invent them: all are counted, read one partition at a time.
    """
    names = [f.name for f in df.schema if C.is_cell(f.dataType)]
    errors = {n: F.coalesce(F.col(f"`{n}`")["metadata"]["errors"], F.array().cast(C.ERRORS)) for n in names}
    if not names:
        return {"row_count": df.count(), "row_error_count": 0, "cell_error_count": 0, "by_code": {}, "by_column": {}, "samples": []}
    any_error = F.greatest(*[F.size(e) for e in errors.values()], F.lit(0)) > 0
    one = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(F.when(any_error, 1)).alias("bad"),
        *[F.count(F.when(F.size(e) > 0, 1)).alias(f"c{i}") for i, e in enumerate(errors.values())],
    ).first()
    by_column = {n: one[f"c{i}"] for i, n in enumerate(names) if one[f"c{i}"]}
    by_code, shown = {}, []
    if by_column:
        each = F.explode(F.concat(*[F.transform(errors[n], lambda e, n=n: F.struct(F.lit(n).alias("column"), e["code"].alias("code"), e["message"].alias("message"))) for n in by_column]))
        found = df.select(each.alias("e"))
        by_code = {r["code"]: r["count"] for r in found.groupBy("e.code").count().toLocalIterator()}
        shown = [r["e"].asDict() for r in found.limit(samples).collect()]
    return {"row_count": one["rows"], "row_error_count": one["bad"], "cell_error_count": sum(by_column.values()), "by_code": by_code, "by_column": by_column, "samples": shown}


@dataclass
class Manifest:
    name: str
    kind: str
    fingerprint: str
    status: str = "completed"
    wrapped: bool = True
    path: str = ""
    schema: dict = field(default_factory=dict)
    errors: dict = field(default_factory=dict)

    def write(self, folder: str) -> None:
        files.write_text(f"{folder}/{self.name}.json", json.dumps(asdict(self), indent=1, default=str))

    def reusable(self, wanted: str, wrapped: bool = True) -> bool:
        """Same fingerprint and mode, completed, and without any error."""
        return self.fingerprint == wanted and self.wrapped == wrapped and self.status == "completed" and not self.errors.get("cell_error_count", 0)


def load(folder: str) -> dict[str, Manifest]:
    out = {}
    for name in files.names(folder):
        if name.endswith(".json"):
            m = Manifest(**json.loads(files.read_text(f"{folder}/{name}")))
            out[m.name] = m
    return out


@dataclass
class Rerun:
    """Which stages run again, which clean ones are taken over, and why it can't be done."""

    dirty: set[str]
    reused: dict[str, Manifest]
    errors: list[str]


def analyse_rerun(steps: list[Step], prints: dict[str, str], before: dict[str, Manifest], policy: str = "auto", node: str | None = None, descendants: bool = True) -> Rerun:
    """policy: auto, from_node or force_recompute_all."""
    made = {s.makes for s in steps if s.makes}
    if policy == "force_recompute_all":
        return Rerun(made, {}, [])
    if policy == "from_node":
        if node not in made:
            return Rerun(set(), {}, [f"{node} is no stage of this recipe"])
        dirty = downstream(steps, {node}) if descendants else {node}
    elif policy == "auto":
        changed = {n for n in made if n not in before or not before[n].reusable(prints.get(n, ""))}
        dirty = downstream(steps, changed)
    else:
        raise ScriptError(f"unknown rerun policy {policy}")
    errors, reused = [], {}
    for step in steps:
        if step.makes in dirty:
            for need in step.needs:
                if need in made and need not in dirty:
                    m = before.get(need)
                    if m is None or m.status != "completed":
                        errors.append(f"{step.makes} needs {need}, which has no completed result")
                    elif policy == "from_node" and m.fingerprint != prints.get(need):
                        errors.append(f"{need} has changed since its last run")
    for n in made - dirty:
        if n in before and before[n].status == "completed":
            reused[n] = before[n]
    return Rerun(dirty, reused, errors)
