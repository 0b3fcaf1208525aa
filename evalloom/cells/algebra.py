"""The error algebra: expressions over cells as pairs of Spark columns, a value and the errors it carries.

`errors is None` means that no error is possible; such cells cost nothing. Every rule is an expression in the
JVM: nothing here needs Python on the executors, and plain values keep their predicates pushed down.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import types as C

_ERRORS = C.ERRORS.simpleString()


def no_errors() -> Column:
    return F.expr(f"CAST(array() AS {_ERRORS})")


def error(code: str | Column, message: str | Column, source: str = "engine", path: str | Column | None = None) -> Column:
    """An array of one error."""
    text = lambda v: v if isinstance(v, Column) else F.lit(v).cast("string")
    return F.array(
        F.struct(
            text(code).alias("code"), text(message).alias("message"), F.lit(source).alias("source"), text(path).alias("path"), F.lit(True).alias("recoverable"),
            F.lit(None).cast("string").alias("cause_code"), F.lit(None).cast("string").alias("cause_message"),
            F.lit(None).cast("map<string,string>").alias("details"),
        )
    )


def _strict(errors: Column | tuple[Column, ...] | None) -> tuple[Column, ...]:
    """Errors as parts, each null where there is none. A column from outside may hold empty arrays."""
    if errors is None:
        return ()
    return errors if isinstance(errors, tuple) else (F.when(F.size(errors) > 0, errors),)


def merged(*errors: Column | tuple[Column, ...] | None) -> tuple[Column, ...]:
    """The errors of all operands, one after another."""
    return tuple(p for e in errors for p in _strict(e))


def any_error(parts: tuple[Column, ...]) -> Column:
    out = F.lit(False)
    for i, p in enumerate(parts):
        out = p.isNotNull() if i == 0 else out | p.isNotNull()
    return out


def joined(parts: tuple[Column, ...]) -> Column:
    """The parts as one array."""
    known = [F.coalesce(p, no_errors()) for p in parts]
    return no_errors() if not known else known[0] if len(known) == 1 else F.concat(*known)


class Cell:
    """A value, its errors (None: none possible), its latency and call trace, and the stored cell if it is one unchanged.

    Errors are kept as parts, one per source, each null where it has none: so a step after a step mentions what
    came before once, and expressions grow with their length, not with its power.
    """

    __slots__ = ("value", "parts", "latency", "stored", "kind", "trace")

    def __init__(self, value: Column, errors: Column | tuple[Column, ...] | None = None, latency: Column | None = None, stored: Column | None = None, kind: T.DataType | None = None, trace: Column | None = None) -> None:  # noqa: E501
        self.value, self.parts = value, _strict(errors)
        self.latency, self.stored, self.kind, self.trace = latency, stored, kind, trace

    @property
    def errors(self) -> Column | None:
        """All errors as one array; None if no operand can have any."""
        return joined(self.parts) if self.parts else None

    def of(self, kind: T.DataType | None) -> Cell:
        """The same value of a known type, no longer the stored cell."""
        return Cell(self.value, self.parts, kind=kind)

    def plain(self) -> Column:
        """The value, null where the cell has errors."""
        return self.value if not self.parts else F.when(any_error(self.parts), None).otherwise(self.value)


def column(stored: Column, kind: T.DataType | None = None, clean: bool = False) -> Cell:
    """A wrapped column; clean: known to hold no error, so that its errors need no reading."""
    value = kind["value"].dataType if isinstance(kind, T.StructType) and C.is_cell(kind) else None
    return Cell(stored["value"], None if clean else stored["metadata"]["errors"], stored["metadata"]["latency_ms"], stored, value)


def raw(value: Column, kind: T.DataType | None = None) -> Cell:
    """A raw column or literal: free of errors."""
    return Cell(value, kind=kind)


def literal(value: object) -> Cell:
    return Cell(value if isinstance(value, Column) else F.lit(value))


def lift(fn: Callable[..., Column], *cells: Cell) -> Cell:
    """fn over the values, the errors of all operands (also of branches that aren't taken)."""
    return Cell(fn(*[c.value for c in cells]), merged(*[c.parts for c in cells]))


def own_error(upstream: tuple[Column, ...], failed: Column, new: Column) -> tuple[Column, ...]:
    """The operands' errors if they have any, else the new one where the step failed."""
    mine = F.when(failed, new)
    if not upstream:
        return (mine,)
    before = upstream[0] if len(upstream) == 1 else F.when(any_error(upstream), joined(upstream))
    return (F.coalesce(before, mine),)


def cast(cell: Cell, kind: str) -> Cell:
    """A recoverable cast: a value that doesn't convert gives null and CAST_ERROR."""
    source = cell.value
    value = source.try_cast(kind)
    failed = source.isNotNull() & value.isNull()
    return Cell(value, own_error(cell.parts, failed, error(C.CAST_ERROR, f"value does not convert to {kind}")), kind=None)


def parse_json(cell: Cell) -> Cell:
    """A VARIANT from JSON text; a VARIANT is parsed again from its text."""
    text = cell.value.cast("string")
    value = F.try_parse_json(text)
    failed = text.isNotNull() & value.isNull()
    return Cell(value, own_error(cell.parts, failed, error(C.JSON_PARSE_ERROR, "text is not JSON")), kind=T.VariantType())


def json_path(*steps: str | int) -> str:
    """A path expression; keys that are no identifiers are quoted."""
    out = "$"
    for s in steps:
        if isinstance(s, int):
            out += f"[{s}]"
        elif s.isidentifier():
            out += f".{s}"
        else:
            quoted = s.replace("\\", "\\\\").replace("'", "\\'")
            out += f"['{quoted}']"
    return out


def variant_get(value: Column, path: str, kind: str = "variant") -> Column:
    """Tolerant access below a VARIANT; null where the path leads nowhere. A VARIANT that is text counts as the JSON it holds."""
    v = value.cast("variant")
    text = F.when(F.schema_of_variant(v) == "STRING", F.try_parse_json(v.cast("string")))
    return F.coalesce(F.try_variant_get(v, path, kind), F.try_variant_get(text, path, kind))


def access_json(cell: Cell, *steps: str | int) -> Cell:
    """v['k'], v[0], v:a.b[0]: an error where the base or the result is SQL null; a JSON null is a value."""
    path = json_path(*steps)
    value = variant_get(cell.value, path)
    failed = cell.value.isNull() | value.isNull()
    return Cell(value, own_error(cell.parts, failed, error(C.JSON_ACCESS_ERROR, "nothing at this path", path=path)), kind=T.VariantType())


def access_json_key(cell: Cell, key: Cell) -> Cell:
    """v[expr]: a key that is computed."""
    entries = F.from_json(F.to_json(cell.value), "map<string,variant>")
    value = F.try_element_at(entries, key.value.cast("string"))
    failed = cell.value.isNull() | key.value.isNull() | value.isNull()
    upstream = merged(cell.parts, key.parts)
    return Cell(value, own_error(upstream, failed, error(C.JSON_ACCESS_ERROR, "no such key", path=key.value.cast("string"))), kind=T.VariantType())


def access(cell: Cell, key: Cell, is_map: bool) -> Cell:
    """a[i] on arrays (from 0) and m[k] on maps."""
    value = F.try_element_at(cell.value, key.value) if is_map else F.get(cell.value, key.value.cast("int"))
    failed = cell.value.isNull() | value.isNull()
    upstream = merged(cell.parts, key.parts)
    return Cell(value, own_error(upstream, failed, error(C.ACCESS_ERROR, "nothing at this position or key")))


def get(cell: Cell, key: Cell, kind: T.DataType | None) -> Cell:
    """get(x, k): tolerant, without an error of its own."""
    if isinstance(kind, T.VariantType):
        entries = F.from_json(F.to_json(cell.value), "map<string,variant>")
        items = F.from_json(F.to_json(cell.value), "array<variant>")
        by_key = F.try_element_at(entries, key.value.cast("string"))
        return Cell(F.coalesce(by_key, F.get(items, key.value.try_cast("int"))), merged(cell.parts, key.parts), kind=T.VariantType())
    if isinstance(kind, T.MapType):
        return lift(lambda v, k: F.try_element_at(v, k), cell, key)
    return lift(lambda v, k: F.get(v, k.cast("int")), cell, key)


def is_err(cell: Cell) -> Cell:
    return Cell(any_error(cell.parts))


def err_or(cell: Cell, fallback: Cell) -> Cell:
    """The value, or the fallback where there are errors; free of errors, the fallback's too."""
    if not cell.parts:
        return Cell(cell.value)
    return Cell(F.when(any_error(cell.parts), fallback.value).otherwise(cell.value))


def latency(cell: Cell) -> Cell:
    return Cell(F.lit(None).cast("bigint") if cell.latency is None else cell.latency)


def concat(*cells: Cell) -> Cell:
    """||: every operand as text, null if one is null."""
    return lift(lambda *v: F.concat(*[x.cast("string") for x in v]), *cells)


def gathered(parts: tuple[Column, ...]) -> Column:
    """A group's errors, flattened. Rows without errors add nothing, so the state grows with the errors alone."""
    return F.flatten(F.collect_list(parts[0] if len(parts) == 1 else F.when(any_error(parts), joined(parts))))


def aggregate(fn: Callable[..., Column], *cells: Cell) -> Cell:
    """fn over the group's values, errored ones being null; the errors of the whole group, flattened.

    Stored, the cell has no value where the group has errors; err_or() around the argument takes them out first.
    """
    value = fn(*[c.plain() for c in cells])
    parts = merged(*[c.parts for c in cells])
    return Cell(value, gathered(parts)) if parts else Cell(value)


def over(fn: Callable[..., Column], window, cells: list[Cell], keys: list[Cell]) -> Cell:
    """A window function over values; the errors are those of this row's operands and keys."""
    return Cell(fn(*[c.plain() for c in cells]).over(window), merged(*[c.parts for c in cells], *[k.parts for k in keys]))


def assemble(cell: Cell, cell_id: Column | None = None) -> Column:
    """The stored form; a bare column passes through whole."""
    if cell.stored is not None:
        return cell.stored
    return F.struct(
        (cell_id if cell_id is not None else F.lit(None)).cast("string").alias("cell_id"),
        cell.plain().alias("value"),
        F.struct(
            joined(cell.parts).alias("errors"),
            (F.lit(None) if cell.latency is None else cell.latency).cast("bigint").alias("latency_ms"),
            (F.lit(None) if cell.trace is None else cell.trace).cast(C.TRACE).alias("trace"),
        ).alias("metadata"),
        F.lit(True).alias("marker"),
    )


def decision(cell: Cell, clause: str) -> Column:
    """The value as a predicate or order key; the job fails where the clause reads an errored cell.

    The check and the value are one conditional expression, so the optimizer can't part them.
    """
    if not cell.parts:
        return cell.value
    return F.when(any_error(cell.parts), F.raise_error(F.lit(f"cells: {clause} consumed an errored cell"))).otherwise(cell.value)


def without_stored(cell: Cell) -> Cell:
    return Cell(cell.value, cell.parts, cell.latency, None, cell.kind, cell.trace)
