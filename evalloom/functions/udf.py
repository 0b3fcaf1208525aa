"""Python functions on cells: one Arrow batch function per call site, run once for value, error and latency.

A call takes plain values and a flag; where an argument has errors the call is skipped and the errors are passed
on. An exception becomes an error of the cell. Calls of a batch run in threads when a limit on calls in flight is
given, each under a permit of that limit's where a run serves them; equal calls of a worker are made once.
"""

from __future__ import annotations

import asyncio
import inspect
import json
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import nullcontext
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..cells import algebra as A
from ..cells import types as C
from ..cells.algebra import Cell
from .registry import Function

#: Most threads per batch, whatever the limit says.
FAN_OUT = 32
#: Results that a worker keeps per function.
CACHE = 10_000

_cache: dict[tuple[str, str], dict[str, Any]] = {}


def _plain(value: Any) -> Any:
    """Arrow's values as Python's."""
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, list):
        return [_plain(v) for v in value]
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    return None if isinstance(value, float) and value != value else value


def is_error_payload(value: Any) -> bool:
    """What functions return in place of raising: an object whose name and message are text."""
    return isinstance(value, dict) and all(isinstance(value.get(k), str) for k in ("name", "message"))


def call_once(function: Function, names: list[str], args: tuple, cached: bool) -> tuple[Any, str | None, str | None, int, bool]:
    """(value, error code, error message, milliseconds, whether it was kept from before) of one call."""
    began = time.monotonic()
    key = None
    kept = _cache.setdefault((function.name, function.version), {})
    try:
        if cached:
            key = json.dumps(args, sort_keys=True, default=str)
            if key in kept:
                return kept[key], None, None, 0, True
        value = function.python(**{n: a for n, a in zip(names, args)})
        if inspect.isawaitable(value):
            value = asyncio.run(_awaited(value))
        if is_error_payload(value):
            return None, C.PYTHON_ERROR, str(value["message"] or value["name"]), int((time.monotonic() - began) * 1000), False
        if key is not None and len(kept) < CACHE:
            kept[key] = value
        return value, None, None, int((time.monotonic() - began) * 1000), False
    except Exception as e:  # noqa: BLE001
        return None, C.PYTHON_ERROR, f"{type(e).__name__}: {e}", int((time.monotonic() - began) * 1000), False


async def _awaited(value):
    return await value


@dataclass(frozen=True)
class Limit:
    """At most so many calls in flight: in a batch, and with permits under the limit's name over all executors."""

    most: int
    name: str = ""
    permits: Any = None

    def held(self):
        return self.permits.permit(self.name, self.most) if self.permits is not None else nullcontext()


def caller(function: Function, names: list[str], limit: Limit | None = None, cached: bool = True) -> Callable[..., Column]:
    """The Arrow function of a call site: (skip, args...) -> struct(value, code, message, ms, hit)."""
    as_json = function.returns == "variant"
    kind = "string" if as_json else function.returns
    schema = f"struct<value:{kind},code:string,message:string,ms:bigint,hit:boolean>"

    @F.pandas_udf(schema)
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        pool = ThreadPoolExecutor(min(FAN_OUT, limit.most)) if limit and limit.most > 1 else None

        def one(item):
            with limit.held() if limit else nullcontext():
                return item[0], call_once(function, names, item[1], cached)

        for batch in batches:
            skip, *series = batch if isinstance(batch, tuple) else (batch,)
            columns = [s.to_dict("records") if isinstance(s, pd.DataFrame) else list(s) for s in series]
            rows = [tuple(_plain(v) for v in r) for r in zip(*columns)] if columns else [()] * len(skip)
            work = [(i, r) for i, (r, no) in enumerate(zip(rows, skip)) if not no]
            done = dict(pool.map(one, work) if pool else map(one, work))
            out = [done.get(i, (None, None, None, None, None)) for i in range(len(skip))]
            values = [None if v is None else json.dumps(v, ensure_ascii=False, default=str) if as_json else v for v, *_ in out]
            yield pd.DataFrame({"value": pd.Series(values, dtype="object"), "code": [o[1] for o in out], "message": [o[2] for o in out], "ms": pd.array([o[3] for o in out], dtype="Int64"), "hit": pd.array([o[4] for o in out], dtype="boolean")})

    return run


def prepare(function: Function, arguments: dict[str, Cell], limit: Limit | None = None, cached: bool = True) -> tuple[Column, Callable[[Column], Cell]]:
    """The hidden column of a call and, given that column, the cell it makes."""
    used = {n: c for n, c in arguments.items() if n not in function.controls}
    upstream = A.merged(*[c.parts for c in used.values()])
    if function.python is None:
        missing = A.error(C.UNAVAILABLE, f"{function.name} needs a {function.needs}")
        return F.lit(0), lambda _: Cell(F.lit(None).cast(function.returns), A.merged(upstream, missing))
    skip = A.any_error(upstream)
    values = [c.value.cast("string") if _kind(function, n) in ("string", "variant") else c.value for n, c in used.items()]
    hidden = caller(function, list(used), limit, cached)(skip, *values)

    def cell(done: Column) -> Cell:
        value = F.try_parse_json(done["value"]) if function.returns == "variant" else done["value"]
        own = A.error(done["code"], done["message"], function.name)
        errors = A.own_error(upstream, done["code"].isNotNull(), own)
        return Cell(value, errors, done["ms"], kind=_variant(function), trace=_trace(function, done, skip, limit))

    return hidden, cell


def _trace(function: Function, done: Column, skip: Column, limit: Limit | None) -> Column:
    """The call's trace in the fixed layout; what only a remote backend knows stays null."""
    known = {
        "schema_version": F.lit("1"), "function_name": F.lit(function.name), "runtime_alias": F.lit(function.name.replace(".", "_")), "backend": F.lit("spark"),
        "execution_runtime": F.lit("python"), "status": F.when(skip, "skipped").when(done["code"].isNotNull(), "error").otherwise("ok"), "duration_ms": F.when(skip, 0).otherwise(done["ms"]),
        "cache_hit": done["hit"], "limiter_key": F.lit(limit.name if limit else None), "max_in_flight": F.lit(limit.most if limit else None), "error_code": done["code"], "error_message": done["message"],
    }
    return F.struct(*[known.get(n, F.lit(None)).cast(kind).alias(n) for n, kind in C.TRACE_FIELDS])


def _kind(function: Function, name: str) -> str:
    return next((p.kind for p in function.parameters if p.name == name), "string")


def _variant(function: Function):
    from pyspark.sql import types as T

    return T.VariantType() if function.returns == "variant" else None


# --- plain adapters ------------------------------------------------------------------------------------------------


def _failure(e: BaseException) -> dict[str, str]:
    return {"name": type(e).__name__, "message": str(e)}


def _with_errors(returns: str) -> str:
    return f"struct<value:{returns},name:string,message:string>"


def _parts(results: list) -> pd.DataFrame:
    """Results as rows of value, name and message: the payloads of those that failed."""
    bad = [r if is_error_payload(r) else {} for r in results]
    values = [None if b else r for r, b in zip(results, bad)]
    return pd.DataFrame({"value": pd.Series(values, dtype="object"), "name": [b.get("name") for b in bad], "message": [b.get("message") for b in bad]})


def outcome(done: Column, source: str) -> Cell:
    """The cell of a function that was made with errors=True."""
    own = A.error(C.PYTHON_ERROR, F.coalesce(done["message"], done["name"]), source)
    return Cell(done["value"], (F.when(done["name"].isNotNull(), own),))


def batch_function(fn: Callable[[list], list], returns: str, errors: bool = False):
    """fn over a whole batch, as a vectorised function; an exception counts for every row of the batch.

    errors: the result is a struct of value, name and message, and outcome() makes it a cell; otherwise rows that
    failed are null.
    """

    def results(values: pd.Series) -> list:
        try:
            return list(fn(list(values)))
        except Exception as e:  # noqa: BLE001
            return [_failure(e)] * len(values)

    @F.pandas_udf(_with_errors(returns))
    def parts(values: pd.Series) -> pd.DataFrame:
        return _parts(results(values))

    @F.pandas_udf(returns)
    def run(values: pd.Series) -> pd.Series:
        return _parts(results(values))["value"]

    return parts if errors else run


def row_function(fn: Callable[..., Any], returns: str, as_json: bool = False):
    """fn row by row inside Arrow batches; as_json: its results as JSON text."""
    shape = (lambda v: None if v is None else json.dumps(v, ensure_ascii=False, default=str)) if as_json else (lambda v: v)

    @F.pandas_udf(returns)
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for series in batches:
            series = series if isinstance(series, tuple) else (series,)
            yield pd.Series([shape(fn(*[_plain(v) for v in r])) for r in zip(*series)], dtype="object")

    return run


def async_row_function(fn: Callable[..., Any], returns: str, in_flight: int = 8, errors: bool = False):
    """An async fn over the rows of a batch, at most in_flight at once; errors as in batch_function()."""

    async def all_rows(rows):
        gate = asyncio.Semaphore(in_flight)

        async def one(r):
            async with gate:
                return await fn(*r)

        return await asyncio.gather(*[one(r) for r in rows], return_exceptions=True)

    def batches_of(batches):
        for series in batches:
            series = series if isinstance(series, tuple) else (series,)
            done = asyncio.run(all_rows(list(zip(*series))))
            yield _parts([_failure(v) if isinstance(v, BaseException) else v for v in done])

    @F.pandas_udf(_with_errors(returns))
    def parts(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        yield from batches_of(batches)

    @F.pandas_udf(returns)
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for out in batches_of(batches):
            yield out["value"]

    return parts if errors else run


def explode_function(fn: Callable[..., list], element: str):
    """fn row -> list; explode() of it gives a row per element."""
    return row_function(fn, f"array<{element}>")


def aggregate_function(fn: Callable[[pd.Series], Any], returns: str):
    """fn series -> scalar, as a grouped aggregate. A whole group is one call: use it for groups of bounded size."""

    @F.pandas_udf(returns)
    def run(values: pd.Series) -> float:
        return fn(values)

    return run
