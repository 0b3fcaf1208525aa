"""Running recipes: validation, stages in order or in parallel, manifests, reuse, events, publications."""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Iterator
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cells.algebra import Cell
from ..cells.frame import CellFrame
from ..functions.registry import Registry
from ..plans import graph
from ..plans.graph import Step
from ..publish import reports
from ..script import ast as N
from ..script import statements as S
from ..script.lower import Context, Macro, check_query, limit_rows, lower_query, output_name
from ..script.surface import ScriptError
from ..sources import files, readers, sinks
from ..streaming import stages as streams
from . import manifest as M
from . import plain
from .permits import PermitServer

#: Options that LOAD knows; WRAP may not be turned off.
WRAP_OPTIONS = ("WRAP", "WRAP_CELLS")


@dataclass
class Settings:
    """A run's folder and modes."""

    folder: str
    inputs: dict[str, Any] = field(default_factory=dict)
    macros: dict[str, str] = field(default_factory=dict)
    strict: bool = True
    parallel: int = 1
    datasets: str | None = None
    reuse_from: str | None = None
    policy: str = "auto"
    from_node: str | None = None
    wait_seconds: float = 0.0
    poll_seconds: float = 1.0
    environment: str | None = None
    debug_rows: int = 0
    #: False: plain mode. Stages hold values without cells, and queries are Spark SQL, read by Spark's own parser.
    wrapped: bool = True


@dataclass
class Result:
    tables: dict[str, str] = field(default_factory=dict)
    manifests: dict[str, M.Manifest] = field(default_factory=dict)
    reused: set[str] = field(default_factory=set)
    waiting: list[str] = field(default_factory=list)
    failed: dict[str, str] = field(default_factory=dict)
    blocked: set[str] = field(default_factory=set)

    @property
    def status(self) -> str:
        return "failed" if self.failed else "waiting" if self.waiting else "completed"


def keyword_functions(registry: Registry) -> frozenset[str]:
    return registry.keywords()


def validate(text: str, registry: Registry | None = None, macros: dict[str, str] | None = None, strict: bool = True, wrapped: bool = True) -> tuple[list[S.Statement], list[Step]]:
    """Everything that can be checked without running: syntax, inputs, names, calls, the constructs cells don't take."""
    registry = registry or Registry()
    statements = S.parse_script(text, macros, keyword_functions(registry), lenient=not wrapped)
    S.check_inputs(statements)
    for s in statements:
        if isinstance(s, S.AdHoc):
            raise ScriptError("a query outside CREATE TABLE")
        if isinstance(s, S.Load) and any(s.options.get(o) is False for o in WRAP_OPTIONS):
            raise ScriptError("LOAD ... WRAP = false is not supported; cells are needed")
        if isinstance(s, S.CreateTable):
            if strict and wrapped:
                check_query(s.query)
            if s.query is not None:
                _check_calls(s.query, registry, statements)
            _check_table_options(s, statements)
        if isinstance(s, S.Publish) and s.target == "annotation":
            reports.annotation_settings(s.options)
        if isinstance(s, S.Publish) and str(s.options.get("COMPONENT", "")).upper() == "METRIC":
            _check_metric_source(s, statements)
    if not any(isinstance(s, (S.Load, S.CreateTable)) for s in statements):
        raise ScriptError("a recipe makes at least one table")
    return statements, graph.steps(statements)


def _check_calls(q: N.Query, registry: Registry, statements: list[S.Statement]) -> None:
    macros = {s.name.lower() for s in statements if isinstance(s, S.CreateFunction)}
    kinds = {s.name: s.kind for s in statements if isinstance(s, S.DeclareInput)}
    for node in N.walk(q):
        if not isinstance(node, N.Call) or node.name.lower() in macros:
            continue
        if node.name in registry:
            f = registry.get(node.name)
            bound = f.bind(node.args, node.named)
            kinds_of = {p.name: p.kind for p in f.parameters}
            for name, a in bound.items():
                if kinds_of[name] == "function":
                    if not isinstance(a, N.Name):
                        raise ScriptError(f"{node.name}: {name} is the name of a function")
                    registry.callback(".".join(a.parts))
                want = {"limiter": "RATELIMIT", "pool": "POOL", "aisystem_id": "AISYSTEM"}.get(name)
                if want and isinstance(a, N.Name) and kinds.get(a.parts[0]) not in (want, None):
                    raise ScriptError(f"{node.name}: {name} must be a {want} input")
                if want in ("RATELIMIT", "POOL") and (not isinstance(a, N.Name) or a.parts[0] not in kinds):
                    raise ScriptError(f"{node.name}: {name} must be a declared {want} input")
        elif "." in node.name:
            raise ScriptError(f"unknown function {node.name}")


#: How a column is to be shown: a fixed list.
COLUMN_SEMANTICS = ("text", "markdown", "trace", "conversation", "code", "json", "directory", "image")


def _check_table_options(s: S.CreateTable, statements: list[S.Statement]) -> None:
    """POOL names a declared executor pool; COLUMN_SEMANTICS gives known kinds."""
    pools = {d.name: str(d.options.get("KIND", "")).lower() for d in statements if isinstance(d, S.DeclareInput) and d.kind == "POOL"}
    pool = s.options.get("POOL")
    if pool is not None and pools.get(str(pool)) != "executor":
        raise ScriptError(f"table {s.name}: POOL must name a declared executor pool")
    for column, shown in (s.options.get("COLUMN_SEMANTICS") or {}).items():
        kind = shown.get("type") if isinstance(shown, dict) else shown
        if kind not in COLUMN_SEMANTICS:
            raise ScriptError(f"table {s.name}: {column} can't be shown as {kind}")


def _check_metric_source(s: S.Publish, statements: list[S.Statement]) -> None:
    """A METRIC's table, where its columns are written out, has metric and value."""
    made = next((t for t in statements if isinstance(t, S.CreateTable) and t.name == s.name), None)
    if made is None or made.query is None:
        return
    q = made.query
    while q.operator:
        q = q.left
    names = {output_name(i) for i in q.items}
    if not any(isinstance(i.expr, N.Star) for i in q.items) and not {"metric", "value"} <= names:
        raise ScriptError(f"{s.name} needs metric and value to be published as METRIC")


def input_cells(statements: list[S.Statement], settings: Settings, context: Context) -> dict[str, Any]:
    """Declared inputs as cells of the context; overrides win over defaults. The plain values, for fingerprints."""
    declared = [s for s in statements if isinstance(s, S.DeclareInput) and (s.environment is None or s.environment == settings.environment)]
    unknown = set(settings.inputs) - {s.name for s in declared}
    if unknown:
        raise ScriptError(f"unknown input {', '.join(sorted(unknown))}")
    values: dict[str, Any] = {}
    for s in declared:
        if s.name not in settings.inputs and s.default is None:
            raise ScriptError(f"input {s.name} has no value")
        base = s.kind.split("(")[0]
        kind = {"BYTE": "TINYINT", "SHORT": "SMALLINT", "LONG": "BIGINT", "RATELIMIT": "INT"}.get(base, s.kind if base in S.INPUT_TYPES else "STRING")
        if s.name in settings.inputs:
            value = settings.inputs[s.name]
            literal = F.lit(json.dumps(value) if isinstance(value, (dict, list)) else value)
            values[s.name] = value
        else:
            from ..script.lower import Lowering

            literal = Lowering(context, {}).lower(s.default).value
            values[s.name] = s.default.value if isinstance(s.default, N.Literal) else repr(s.default)
        cast = literal.try_cast(kind)
        if context.spark.range(1).select((literal.isNotNull() & cast.isNull()).alias("bad")).first()["bad"]:
            raise ScriptError(f"input {s.name}: {values[s.name]!r} is no {s.kind}")
        context.inputs[s.name] = Cell(cast)
        if base == "RATELIMIT":
            context.limits[s.name] = int(values[s.name])
    return values


class Runner:
    """One run of a recipe into a folder: tables/, manifests/, reports/, annotations/, events.jsonl."""

    def __init__(self, spark: SparkSession, text: str, settings: Settings, registry: Registry | None = None) -> None:
        self.spark, self.settings, self.registry = spark, settings, registry or Registry()
        self.statements, self.steps = validate(text, self.registry, settings.macros, settings.strict, settings.wrapped)
        if self.registry.object_folder is None:
            self.registry.objects(f"{settings.folder}/objects")
        self.context = Context(spark, self.registry, strict=settings.strict)
        for s in self.statements:
            if isinstance(s, S.CreateFunction):
                self.context.macros[s.name.lower()] = Macro(s.name, s.parameters, s.body, s.returns)
        self.values = input_cells(self.statements, settings, self.context)
        self.result, self.lock = Result(), threading.RLock()
        self._published: frozenset[str] = frozenset()
        self._events: str | None = None
        self.prints: dict[str, str] = {}
        for step in self.steps:
            if step.makes:
                used = {n: v for n, v in self.values.items() if n in step.statement.text}
                macros = " ".join(s.text for s in self.statements if isinstance(s, S.CreateFunction) and s.name in step.statement.text)
                self.prints[step.makes] = M.fingerprint(step, f"{step.statement.text} {json.dumps(used, sort_keys=True, default=str)} {macros}", self.prints, settings.wrapped)

    # --- events -------------------------------------------------------------------------------------------

    def event(self, kind: str, name: str, **more: Any) -> None:
        path = f"{self.settings.folder}/events.jsonl"
        with self.lock:
            if self._events is None:
                self._events = files.read_text(path) if files.exists(path) else ""
            self._events += json.dumps({"time": time.time(), "event": kind, "stage": name, **more}, default=str) + "\n"
            files.write_text(path, self._events)

    # --- running ------------------------------------------------------------------------------------------

    def run(self) -> Result:
        """All steps; limits that the recipe declares hold over all executors while it runs."""
        server = PermitServer(self.spark) if self.context.limits else None
        self.context.permits = server.permits if server else None
        try:
            return self._run()
        finally:
            if server:
                server.close()

    def _run(self) -> Result:
        before = M.load(f"{self.settings.reuse_from}/manifests") if self.settings.reuse_from else {}
        plan = M.analyse_rerun(self.steps, self.prints, before, self.settings.policy, self.settings.from_node) if before else None
        if plan and plan.errors:
            raise ScriptError("; ".join(plan.errors))
        todo = []
        for step in self.steps:
            if plan and step.makes in plan.reused:
                m = plan.reused[step.makes]
                self._register(step.makes, self.spark.read.parquet(m.path), m)
                self.result.reused.add(step.makes)
                self.event("reused", step.makes)
            else:
                todo.append(step)
        if self.settings.parallel > 1:
            self._parallel(todo)
        else:
            for step in todo:
                self._guarded(step)
        return self.result

    def _ready(self, step: Step) -> bool | None:
        """True: may run; None: blocked by a failure; False: has to wait."""
        gone = set(self.result.failed) | self.result.blocked | set(self.result.waiting)
        if step.needs & gone:
            return None
        return all(n in self.result.tables or n.startswith("publish ") and n in self._published for n in step.needs)

    def _guarded(self, step: Step) -> None:
        if self._ready(step) is None:
            self.result.blocked.add(step.makes or step.key)
            self.event("blocked", step.statement.name)
            return
        began = time.time()
        self.event("started", step.statement.name, step=step.kind)
        try:
            self._one(step)
        except Exception as e:  # noqa: BLE001
            with self.lock:
                self.result.failed[step.makes or step.key] = f"{type(e).__name__}: {e}"
            self.event("failed", step.statement.name, error=str(e)[:2000], seconds=round(time.time() - began, 3))
            return
        self.event("waiting" if step.makes in self.result.waiting else "completed", step.statement.name, seconds=round(time.time() - began, 3))

    def _parallel(self, todo: list[Step]) -> None:
        left, running = list(todo), {}
        with ThreadPoolExecutor(self.settings.parallel) as pool:
            while left or running:
                for step in list(left):
                    ready = self._ready(step)
                    if ready is None:
                        left.remove(step)
                        self._guarded(step)
                    elif ready and len(running) < self.settings.parallel:
                        left.remove(step)
                        running[pool.submit(self._guarded, step)] = step
                if running:
                    done, _ = wait(running, return_when=FIRST_COMPLETED)
                    for f in done:
                        running.pop(f)
                        f.result()

    # --- steps --------------------------------------------------------------------------------------------

    def _path(self, name: str) -> str:
        return f"{self.settings.folder}/tables/{name}"

    def _register(self, name: str, df: DataFrame, m: M.Manifest) -> None:
        bad = m.errors.get("by_column", {})
        with self.lock:
            self.context.tables[name] = df
            self.context.clean[name] = frozenset(c for c in df.columns if c not in bad) if m.errors else frozenset()
            self.result.tables[name] = m.path
            self.result.manifests[name] = m

    def _finish(self, step: Step, path: str) -> None:
        stored = self.spark.read.parquet(path)
        summary = M.error_summary(stored)
        m = M.Manifest(step.makes, step.kind, self.prints[step.makes], wrapped=self.settings.wrapped, path=path, schema=json.loads(stored.schema.json()), errors=summary)
        m.write(f"{self.settings.folder}/manifests")
        if self.settings.debug_rows:
            # A sample of settings.debug_rows rows: the feature's own limit.
            rows = stored.limit(self.settings.debug_rows).toJSON().collect()
            files.write_text(f"{self.settings.folder}/debug/{step.makes}.jsonl", "".join(r + "\n" for r in rows))
        self._register(step.makes, stored, m)

    def _one(self, step: Step) -> None:
        s = step.statement
        if step.kind == "load":
            self._load(step, s)
        elif step.kind == "batch":
            if self.settings.wrapped:
                out = CellFrame.wrap(lower_query(s.query, self.context).df, step.makes).df
            else:
                with self.lock:
                    out = plain.query(self.spark, s.query_text, self.context, self.values, self.statements)
            if out.isStreaming:
                raise ScriptError("a batch table can't read a stream")
            with self._pool(s):
                out.write.mode("overwrite").parquet(self._path(step.makes))
                self._finish(step, self._path(step.makes))
        elif step.kind == "stream":
            self._stream(step, s)
        elif step.kind == "save":
            sinks.save(self.context.tables[s.name], s.path, s.options.get("FORMAT"))
        elif step.kind == "publish":
            self._publish(s)
        else:
            self._retrieve(step, s)

    def _load(self, step: Step, s: S.Load) -> None:
        path = s.path
        if path is None:
            if s.input not in self.values:
                raise ScriptError(f"{s.input} is no declared input")
            path = str(self.values[s.input])
        df = readers.read(self.spark, path, s.options, self.settings.datasets)
        if s.limit is not None:
            df = df.limit(limit_rows(s.limit, self.context))
        self._store(df, step)

    def _store(self, df: DataFrame, step: Step) -> None:
        """Rows from outside as a stage's table: cells with ids, or in plain mode the values."""
        out = CellFrame.wrap(df, step.makes).df if self.settings.wrapped else CellFrame(df).unwrap()
        out.write.mode("overwrite").parquet(self._path(step.makes))
        self._finish(step, self._path(step.makes))

    @contextmanager
    def _pool(self, s: S.CreateTable) -> Iterator[None]:
        """A table's executor pool as Spark's scheduler pool, for the jobs of this thread."""
        sc, pool = self.spark.sparkContext, s.options.get("POOL")
        if pool is None:
            yield
            return
        before = sc.getLocalProperty("spark.scheduler.pool")
        sc.setLocalProperty("spark.scheduler.pool", str(pool))
        try:
            yield
        finally:
            sc.setLocalProperty("spark.scheduler.pool", before)

    def _stream(self, step: Step, s: S.CreateTable) -> None:
        rows = s.options.get("BATCH_SIZE")
        own = replace(self.context, tables={})
        for need in step.needs:
            path = self.result.tables[need]
            if rows:
                batched = f"{self.settings.folder}/stream_sources/{step.makes}/{need}"
                streams.in_batches(self.spark.read.parquet(path), batched, int(rows))
                path = batched
            own.tables[need] = streams.source(self.spark, path, 1 if rows else None)
        if self.settings.wrapped:
            out = CellFrame.wrap(lower_query(s.query, own).df, step.makes).df
        else:
            with self.lock:
                out = plain.query(self.spark, s.query_text, own, self.values, self.statements)
        with self._pool(s):
            streams.drain(out, self._path(step.makes), f"{self.settings.folder}/checkpoints/{step.makes}")
            self._finish(step, self._path(step.makes))

    def _publish(self, s: S.Publish) -> None:
        df = self.context.tables[s.name]
        if s.target == "reports":
            with self.lock:
                reports.publish_report(df, s.name, s.options, f"{self.settings.folder}/reports")
        elif s.target == "dataset":
            name = s.destination or s.name
            path = f"{self.settings.folder}/datasets/{name}"
            sinks.dataset(df, path)
            record = {"name": name, "table": s.name, "path": path, "schema": json.loads(CellFrame(df).unwrap().schema.json())}
            files.write_text(f"{self.settings.folder}/datasets/{name}.json", json.dumps(record, indent=1))
        else:
            reports.publish_annotation(df, s.name, s.destination, s.alias, s.options, f"{self.settings.folder}/annotations")
            with self.lock:
                self._published = self._published | {f"publish {s.alias}"}

    def _retrieve(self, step: Step, s: S.Retrieve) -> None:
        end = time.time() + self.settings.wait_seconds
        while True:
            df = reports.retrieve_annotation(self.spark, f"{self.settings.folder}/annotations", s.alias, s.request)
            if df is not None:
                break
            if time.time() >= end:
                with self.lock:
                    self.result.waiting.append(step.makes)
                return
            time.sleep(max(0.1, self.settings.poll_seconds))
        self._store(df, step)


def run(spark: SparkSession, text: str, settings: Settings, registry: Registry | None = None) -> Result:
    return Runner(spark, text, settings, registry).run()


def transpile(spark: SparkSession, text: str, registry: Registry | None = None, schemas: dict[str, DataFrame] | None = None, macros: dict[str, str] | None = None) -> list[dict]:
    """The steps of a recipe, with Spark's plan for those whose sources' schemas are known."""
    registry = registry or Registry()
    statements, steps = validate(text, registry, macros)
    context = Context(spark, registry, dict(schemas or {}))
    for s in statements:
        if isinstance(s, S.CreateFunction):
            context.macros[s.name.lower()] = Macro(s.name, s.parameters, s.body, s.returns)
    input_cells([s for s in statements if not isinstance(s, S.DeclareInput) or s.default is not None], Settings(""), context)
    out = []
    for step in steps:
        record: dict[str, Any] = {"kind": step.kind, "name": step.statement.name, "needs": sorted(step.needs)}
        if step.kind in ("batch", "stream") and step.needs <= set(context.tables):
            df = lower_query(step.statement.query, context).df
            context.tables[step.makes] = df
            record["plan"] = df._jdf.queryExecution().optimizedPlan().toString()
        out.append(record)
    return out
