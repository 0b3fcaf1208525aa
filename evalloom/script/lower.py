"""Queries of the recipe language as operators over cells.

A query is lowered against the real schemas of its sources: what a `[...]` means is read from the value's type.
Python calls become hidden columns of their own, once each, before the projection that reads them.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import partial
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..cells import algebra as A
from ..cells import types as C
from ..cells.algebra import Cell
from ..cells.frame import CellFrame
from ..functions import udf as U
from ..functions.registry import BindError, Registry
from . import ast as N
from .surface import ScriptError

#: Aggregate functions, as Spark names them.
AGGREGATES = frozenset(
    "any_value approx_count_distinct avg bit_and bit_or bit_xor bool_and bool_or collect_list collect_set corr count count_if count_min_sketch covar_pop covar_samp every first "
    "first_value grouping grouping_id last last_value max max_by mean median min min_by mode percentile percentile_approx approx_percentile some stddev stddev_pop stddev_samp sum "
    "var_pop var_samp variance skewness kurtosis array_agg regr_count listagg string_agg".split()
)
GENERATORS = frozenset(("explode", "posexplode", "explode_outer", "posexplode_outer"))
BANNED_FIELDS = ("metadata", "marker", "cell_id")


class Ungrouped(ScriptError):
    """A column of a grouped query that is neither a key nor below an aggregate."""


def unsupported(construct: str, rewrite: str) -> ScriptError:
    return ScriptError(f"{construct} is not supported over cells; {rewrite}")


#: What no mode lowers onto cells.
NEVER = ("PIVOT", "UNPIVOT", "WITH RECURSIVE")

REWRITES = {
    "PIVOT": "use conditional aggregates", "UNPIVOT": "use UNION ALL", "LATERAL VIEW": "use explode() in the projection", "QUALIFY": "filter in an outer query",
    "ROLLUP": "use UNION ALL of grouped queries", "CUBE": "use UNION ALL of grouped queries", "GROUPING SETS": "use UNION ALL of grouped queries",
    "window frame": "leave the frame out", "scalar subquery": "join to a derived table", "JOIN USING": "write ON", "NATURAL JOIN": "write ON",
    "WITH RECURSIVE": "use plain mode, which Spark's own parser reads", "INTERSECT": "join on the values", "EXCEPT": "left join and keep the unmatched rows",
    "JOIN without ON": "write ON with equalities", "non-equi JOIN": "join on equalities", "cell field": "use is_err(), err_or() or latency()",
}


def check_query(q: N.Query) -> None:
    """The constructs that cells don't take, each with a way to write it."""
    for node in N.walk(q):
        if isinstance(node, N.Query):
            for construct in node.banned:
                raise unsupported(construct, REWRITES[construct])
            if node.operator and not node.operator.startswith("union"):
                kind = node.operator.split()[0].upper()
                raise unsupported(kind, REWRITES[kind])
            for j in node.joins:
                if j.using is not None:
                    raise unsupported("JOIN USING", REWRITES["JOIN USING"])
                if j.natural:
                    raise unsupported("NATURAL JOIN", REWRITES["NATURAL JOIN"])
                if j.kind in ("semi", "anti", "cross"):
                    raise unsupported(f"{j.kind.upper()} JOIN", "use an inner or outer join on equalities")
                if j.on is None:
                    raise unsupported("JOIN without ON", REWRITES["JOIN without ON"])
                if not _equalities(j.on):
                    raise unsupported("non-equi JOIN", REWRITES["non-equi JOIN"])
        elif isinstance(node, N.Window) and node.frame:
            raise unsupported("window frame", REWRITES["window frame"])
        elif isinstance(node, N.Subquery):
            raise unsupported("scalar subquery", REWRITES["scalar subquery"])
        elif isinstance(node, N.Call) and node.name.lower() == "exists" and any(isinstance(a, N.Subquery) for a in node.args):
            raise unsupported("scalar subquery", REWRITES["scalar subquery"])
        elif isinstance(node, N.Name) and (len(node.parts) > 2 and node.parts[-2] == "metadata" or len(node.parts) > 1 and node.parts[-1] == "marker"):
            raise unsupported("cell field", REWRITES["cell field"])


def _equalities(e: N.Expr) -> bool:
    if isinstance(e, N.Binary) and e.op == "and":
        return _equalities(e.left) and _equalities(e.right)
    return isinstance(e, N.Binary) and e.op == "="


@dataclass
class Macro:
    name: str
    parameters: list[tuple[str, str]]
    body: N.Expr
    returns: str | None = None


@dataclass
class Context:
    """What a query may refer to besides its sources."""

    spark: SparkSession
    registry: Registry = field(default_factory=Registry)
    tables: dict[str, DataFrame] = field(default_factory=dict)
    #: Per table the columns of cells that hold no error.
    clean: dict[str, frozenset[str]] = field(default_factory=dict)
    inputs: dict[str, Cell] = field(default_factory=dict)
    limits: dict[str, int] = field(default_factory=dict)
    #: Where calls ask for permits of these limits; None: each batch keeps them by itself.
    permits: Any = None
    macros: dict[str, Macro] = field(default_factory=dict)
    strict: bool = True


@dataclass
class _Source:
    """A relation: its columns as hidden ones of the frame; `merged` ones were joined away and answer to `alias.name` only."""

    alias: str
    columns: dict[str, str]
    merged: dict[str, str] = field(default_factory=dict)


def _conjuncts(e: N.Expr | None) -> list[N.Expr]:
    if isinstance(e, N.Binary) and e.op == "and":
        return _conjuncts(e.left) + _conjuncts(e.right)
    return [] if e is None else [e]


class Lowering:
    """One SELECT: a DataFrame that grows hidden columns, and the names that its expressions may use."""

    def __init__(self, context: Context, ctes: dict[str, CellFrame]) -> None:
        self.context, self.ctes = context, dict(ctes)
        self.df: DataFrame | None = None
        self.clean: set[str] = set()
        self.sources: list[_Source] = []
        self.scoped: dict[str, str] = {}
        self.bound: dict[str, Cell] = {}
        self.keys: list[tuple[N.Expr, Cell]] = []
        self.grouping = False
        self.hidden = 0

    # --- sources ------------------------------------------------------------------------------------------

    def frame(self, s: N.Source) -> CellFrame:
        if s.query is not None:
            return lower_query(s.query, self.context, self.ctes)
        if s.values is not None:
            rows = [F.struct(*[self._constant(v).alias(f"c{i}") for i, v in enumerate(r)]) for r in s.values]
            names = s.columns or [f"col{i + 1}" for i in range(len(s.values[0]))]
            df = self.context.spark.range(1).select(F.explode(F.array(*rows)).alias("r"))
            return CellFrame(df.select(*[F.col(f"r.c{i}").alias(n) for i, n in enumerate(names)]))
        name = s.table
        if name in self.ctes:
            return self.ctes[name]
        if name in self.context.tables:
            return CellFrame(self.context.tables[name], self.context.clean.get(name, ()))
        raise ScriptError(f"unknown relation {name}")

    def _constant(self, e: N.Expr) -> Column:
        return self.lower(e).value

    def add_source(self, s: N.Source) -> DataFrame:
        """A source under names of its own; it becomes the frame only if there is none yet."""
        f = self.frame(s)
        n = len(self.sources)
        names = {c: f"__s{n}_{c}" for c in f.columns}
        df = f.df.select(*[F.col(f"`{c}`").alias(new) for c, new in names.items()])
        self.clean |= {names[c] for c in f.clean if c in names}
        self.sources.append(_Source(s.alias or (s.table or "").rpartition(".")[2] or f"__t{n}", names))
        if self.df is None:
            self.df = df
        return df

    def join(self, j: N.Join) -> None:
        """A join by its equalities between the two sides; what else the condition holds is checked beside them."""
        left, n = self.df, len(self.sources)
        right = self.add_source(j.source)
        how = {"inner": "inner", "left": "left", "right": "right", "full": "full", "semi": "left_semi", "anti": "left_anti", "cross": "cross"}[j.kind]
        shared = self._shared(j, n)
        pairs: list[tuple[Cell, Cell]] = []
        rest: list[N.Expr] = []
        for name in shared:
            self.df = left
            mine = self.resolve([name], before=n)
            self.df = right
            pairs.append((mine, self.stored(self.sources[n].columns[name])))
        for e in _conjuncts(j.on):
            sides = [self._owners(x) for x in (e.left, e.right)] if isinstance(e, N.Binary) and e.op == "=" else [set(), set()]
            if all(sides) and (sides[0] == {n}) != (sides[1] == {n}) and not (n in sides[0] and n in sides[1]) and (sides[0] == {n} or n not in sides[0]) and (sides[1] == {n} or n not in sides[1]):
                mine, other = (e.right, e.left) if sides[0] == {n} else (e.left, e.right)
                self.df = left
                a = self.lower(mine)
                left = self.df
                self.df = right
                b = self.lower(other)
                right = self.df
                pairs.append((a, b))
            else:
                rest.append(e)
        extra = None
        if rest:
            both = left.crossJoin(right)
            self.df = both
            condition = self.lower(rest[0]) if len(rest) == 1 else A.lift(lambda *v: _all(v), *[self.lower(e) for e in rest])
            if self.df is not both:
                raise ScriptError("Python calls across both sides of a JOIN ON are not allowed; call them in a derived table")
            extra = A.decision(condition, "JOIN ON")
        if not pairs and extra is None:
            if j.kind not in ("inner", "cross"):
                raise unsupported("JOIN without ON", REWRITES["JOIN without ON"])
            self.df = left.crossJoin(right)
        else:
            self.df = CellFrame(left).join_keys(CellFrame(right), pairs, "inner" if how == "cross" else how, extra).df
        for name in shared:
            self._merge(name, n, j.kind)
        if j.kind in ("semi", "anti"):
            self.sources.pop()

    def _shared(self, j: N.Join, n: int) -> list[str]:
        """The columns of USING or NATURAL."""
        mine = [c for s in self.sources[:n] for c in s.columns]
        other = self.sources[n].columns
        if j.natural:
            return [c for c in mine if c in other]
        for name in j.using or []:
            if mine.count(name) != 1 or name not in other:
                raise ScriptError(f"USING: {name} must be one column of each side")
        return list(j.using or [])

    def _merge(self, name: str, n: int, kind: str) -> None:
        """A column of USING appears once, as the side's that is always there, or as either's."""
        if kind in ("semi", "anti"):
            return
        right = self.sources[n]
        owner = next(s for s in self.sources[:n] if name in s.columns)
        owner.merged[name], right.merged[name] = owner.columns[name], right.columns.pop(name)
        if kind == "right":
            owner.columns[name] = right.merged[name]
        elif kind == "full":
            both = f"__u{n}_{name}"
            self.df = self.df.withColumn(both, F.coalesce(F.col(f"`{owner.merged[name]}`"), F.col(f"`{right.merged[name]}`")))
            if {owner.merged[name], right.merged[name]} <= self.clean:
                self.clean.add(both)
            owner.columns[name] = both

    def _owners(self, e: N.Expr) -> set[int]:
        """Which sources an expression reads; -1 for what can't be told."""
        out: set[int] = set()
        for node in N.walk(e):
            if isinstance(node, (N.Lambda, N.Subquery)):
                out.add(-1)
            if isinstance(node, N.Name):
                first, rest = node.parts[0], node.parts[1:]
                found = [i for i, s in enumerate(self.sources) if rest and s.alias == first and (rest[0] in s.columns or rest[0] in s.merged)]
                found = found or [i for i, s in enumerate(self.sources) if first in s.columns]
                out |= set(found[:1]) if len(found) == 1 else set(found) | ({-1} if found else set())
        return out

    # --- names --------------------------------------------------------------------------------------------

    def stored(self, column: str) -> Cell:
        kind = self.df.schema[column].dataType
        c = F.col(f"`{column}`")
        return A.column(c, kind, column in self.clean) if C.is_cell(kind) else A.raw(c, kind)

    def resolve(self, parts: list[str], before: int | None = None) -> Cell:
        first, rest = parts[0], parts[1:]
        if first in self.bound:
            return self._fields(self.bound[first], rest)
        if first in self.scoped:
            return self._fields(self.stored(self.scoped[first]), rest)
        sources = self.sources[:before]
        for s in sources:
            own = s.merged | s.columns if rest and s.alias == first else {}
            if rest and rest[0] in own:
                return self._fields(self.stored(s.merged.get(rest[0], s.columns.get(rest[0]))), rest[1:])
        owners = [s for s in sources if first in s.columns]
        if len(owners) > 1:
            raise ScriptError(f"{first} is a column of {' and '.join(s.alias for s in owners)}")
        if owners:
            return self._fields(self.stored(owners[0].columns[first]), rest)
        if first in self.context.inputs:
            return self._fields(self.context.inputs[first], rest)
        raise ScriptError(f"unknown name {'.'.join(parts)}")

    def explode(self, items: Cell, name: str, position: str | None, outer: bool = False) -> None:
        f = CellFrame(self.df, self.clean).explode(items, name, position, outer)
        self.df, self.clean = f.df, set(f.clean)

    def _fields(self, cell: Cell, names: list[str]) -> Cell:
        for n in names:
            kind = self.type_of(cell)
            if isinstance(kind, T.VariantType):
                cell = A.access_json(cell, n)
            else:
                cell = A.lift(lambda v, n=n: v[n], cell)
        return cell

    def type_of(self, cell: Cell) -> T.DataType:
        if cell.kind is not None:
            return cell.kind
        if self.grouping:
            return self._grouped_type(cell)
        return self.df.select(cell.value.alias("v")).schema["v"].dataType if self.df is not None else self.context.spark.range(1).select(cell.value.alias("v")).schema["v"].dataType

    def _grouped_type(self, cell: Cell) -> T.DataType:
        keys = [F.col(f"__k{i}") for i in range(len(self.keys))]
        return self.df.groupBy(*keys).agg(cell.value.alias("v")).schema["v"].dataType

    def hide(self, column: Column) -> Column:
        name = f"__h{self.hidden}"
        self.hidden += 1
        self.df = self.df.withColumn(name, column)
        return F.col(name)

    # --- expressions --------------------------------------------------------------------------------------

    def lower(self, e: N.Expr) -> Cell:
        if self.grouping:
            for known, cell in self.keys:
                if known == e:
                    return cell
        method = getattr(self, f"_{type(e).__name__.lower()}", None)
        if method is None:
            raise ScriptError(f"{type(e).__name__} is not allowed here")
        return method(e)

    def _literal(self, e: N.Literal) -> Cell:
        if e.kind in ("date", "timestamp", "timestamp_ntz"):
            return Cell(F.lit(e.value).cast(e.kind))
        if e.kind == "interval":
            return Cell(F.expr(f"INTERVAL {e.value}"))
        return Cell(F.lit(e.value))

    def _name(self, e: N.Name) -> Cell:
        if self.grouping:
            for known, cell in self.keys:
                if isinstance(known, N.Name) and known.parts[-1] == e.parts[-1]:
                    return cell
            if e.parts[0] not in self.context.inputs and e.parts[0] not in self.bound:
                raise Ungrouped(f"{'.'.join(e.parts)} is neither grouped nor aggregated")
        return self.resolve(e.parts)

    def _unary(self, e: N.Unary) -> Cell:
        return A.lift((lambda v: ~v) if e.op == "not" else (lambda v: -v), self.lower(e.operand))

    _OPS = {
        "and": lambda a, b: a & b, "or": lambda a, b: a | b, "=": lambda a, b: a == b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b,
        ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<=>": lambda a, b: a.eqNullSafe(b), "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b,
        "/": lambda a, b: a / b, "%": lambda a, b: a % b,
    }

    def _binary(self, e: N.Binary) -> Cell:
        if e.op == "||":
            parts, stack = [], [e]
            while stack:
                x = stack.pop()
                if isinstance(x, N.Binary) and x.op == "||":
                    stack += [x.right, x.left]
                else:
                    parts.append(self.lower(x))
            return A.concat(*parts)
        return A.lift(self._OPS[e.op], self.lower(e.left), self.lower(e.right))

    def _case(self, e: N.Case) -> Cell:
        cells: list[Cell] = []
        for condition, value in e.whens:
            test = self.lower(condition if e.operand is None else N.Binary("=", e.operand, condition))
            cells += [test, self.lower(value)]
        if e.otherwise is not None:
            cells.append(self.lower(e.otherwise))

        def build(*v: Column) -> Column:
            out = F.when(v[0], v[1])
            for k in range(1, len(e.whens)):
                out = out.when(v[2 * k], v[2 * k + 1])
            return out.otherwise(v[-1]) if e.otherwise is not None else out

        return A.lift(build, *cells)

    def _cast(self, e: N.Cast) -> Cell:
        cell = self.lower(e.operand)
        kind = "variant" if e.kind.lower() == "json" else e.kind
        return A.cast(cell, kind)

    def _in(self, e: N.In) -> Cell:
        cells = [self.lower(e.operand), *[self.lower(i) for i in e.items]]
        return A.lift((lambda v, *i: ~v.isin(*i)) if e.negated else (lambda v, *i: v.isin(*i)), *cells)

    def _between(self, e: N.Between) -> Cell:
        cells = [self.lower(x) for x in (e.operand, e.low, e.high)]
        return A.lift((lambda v, a, b: ~((v >= a) & (v <= b))) if e.negated else (lambda v, a, b: (v >= a) & (v <= b)), *cells)

    def _like(self, e: N.Like) -> Cell:
        fn = lambda v, p: F.call_function(e.op, v, p)
        return A.lift((lambda v, p: ~fn(v, p)) if e.negated else fn, self.lower(e.operand), self.lower(e.pattern))

    def _isnull(self, e: N.IsNull) -> Cell:
        return A.lift((lambda v: v.isNotNull()) if e.negated else (lambda v: v.isNull()), self.lower(e.operand))

    def _index(self, e: N.Index) -> Cell:
        steps: list[N.Expr] = []
        base: N.Expr = e
        while isinstance(base, N.Index):
            steps.insert(0, base.key)
            base = base.base
        cell = self.lower(base)
        while steps:
            kind = self.type_of(cell)
            key = steps.pop(0)
            constant = isinstance(key, N.Literal) and isinstance(key.value, (str, int)) and not isinstance(key.value, bool)
            if isinstance(kind, T.VariantType):
                if not constant:
                    cell = A.access_json_key(cell, self.lower(key))
                    continue
                path = [key.value]
                while steps and isinstance(steps[0], N.Literal) and isinstance(steps[0].value, (str, int)):
                    path.append(steps.pop(0).value)
                cell = A.access_json(cell, *path)
            elif isinstance(key, N.Literal) and (key.kind == "field" or isinstance(kind, T.StructType)):
                cell = A.lift(lambda v, k=key.value: v[k], cell)
            else:
                cell = A.access(cell, self.lower(key), isinstance(kind, T.MapType))
        return cell

    def _slice(self, e: N.Slice) -> Cell:
        """x[a:b] of an array or a VARIANT list, positions a to b - 1 from 0; no error of its own."""
        cell = self.lower(e.base)
        variant = isinstance(self.type_of(cell), T.VariantType)
        low = self.lower(e.low) if e.low is not None else A.literal(0)
        high = self.lower(e.high) if e.high is not None else None

        def build(v: Column, a: Column, *b: Column) -> Column:
            items = F.from_json(F.to_json(v), "array<variant>") if variant else v
            n = F.greatest((b[0] if b else F.size(items)) - a, F.lit(0))
            part = F.when(items.isNotNull(), F.slice(items, a.cast("int") + 1, n.cast("int")))
            return F.to_variant_object(part) if variant else part

        return Cell(*_pair(A.lift(build, cell, low, *([high] if high else []))), kind=T.VariantType() if variant else None)

    def _path(self, e: N.Path) -> Cell:
        cell = self.lower(e.base)
        kind = self.type_of(cell)
        if not isinstance(kind, T.VariantType):
            raise ScriptError("':' reads below a VARIANT; use parse_json() first")
        return A.access_json(cell, *e.steps)

    def _listliteral(self, e: N.ListLiteral) -> Cell:
        cells = [self.lower(i) for i in e.items]
        return Cell(*_pair(A.lift(lambda *v: F.to_variant_object(F.array(*v)), *cells)), kind=T.VariantType())

    def _mapliteral(self, e: N.MapLiteral) -> Cell:
        cells = [self.lower(v) for _, v in e.items]
        names = [k for k, _ in e.items]
        return Cell(*_pair(A.lift(lambda *v: F.to_variant_object(F.struct(*[c.alias(n) for n, c in zip(names, v)])), *cells)), kind=T.VariantType())

    def _call(self, e: N.Call) -> Cell:
        low = e.name.lower()
        if e.window is not None:
            return self._over(e)
        if low in self.context.macros:
            return self._macro(self.context.macros[low], e)
        if e.name in self.context.registry:
            return self._function(e)
        if "." in e.name:
            raise ScriptError(f"unknown function {e.name}")
        if low in AGGREGATES:
            return self._aggregate(e)
        if low == "is_err":
            return A.is_err(self.lower(e.args[0]))
        if low == "err_or":
            return A.err_or(self.lower(e.args[0]), self.lower(e.args[1]))
        if low == "latency":
            return A.latency(self.lower(e.args[0]))
        if low == "parse_json":
            return A.parse_json(self.lower(e.args[0]))
        if low in ("try_variant_get", "variant_get"):
            base, path = self.lower(e.args[0]), e.args[1]
            kind = e.args[2].value if len(e.args) > 2 else "variant"
            if not isinstance(path, N.Literal):
                raise ScriptError(f"{low} needs a literal path")
            return Cell(A.variant_get(base.value, path.value, kind), base.parts, kind=T.VariantType() if kind == "variant" else None)
        if low == "get" and len(e.args) == 2:
            base = self.lower(e.args[0])
            return A.get(base, self.lower(e.args[1]), self.type_of(base))
        if low == "array_size":
            base = self.lower(e.args[0])
            if isinstance(self.type_of(base), T.VariantType):
                return A.lift(lambda v: F.array_size(F.from_json(F.to_json(v), "array<variant>")), base)
        if low in GENERATORS:
            raise ScriptError(f"{low}() is only allowed as an item of a projection")
        return self._spark_function(e, low)

    def _spark_function(self, e: N.Call, name: str) -> Cell:
        if any(isinstance(a, N.Lambda) for a in e.args):
            cells = [None if isinstance(a, N.Lambda) else self.lower(a) for a in e.args]
            texts = []
            for a, c in zip(e.args, cells):
                if isinstance(a, N.Lambda):
                    texts.append(f"{a.names[0] if len(a.names) == 1 else '(' + ', '.join(a.names) + ')'} -> {a.text}")
                else:
                    hidden = f"__h{self.hidden}"
                    self.hide(c.value)
                    texts.append(f"`{hidden}`")
            return Cell(F.expr(f"{name}({', '.join(texts)})"), A.merged(*[c.parts for c in cells if c is not None]))
        cells = [self.lower(a) for a in e.args]
        return A.lift(lambda *v: F.call_function(name, *v), *cells)

    def _macro(self, m: Macro, e: N.Call) -> Cell:
        names = [p for p, _ in m.parameters]
        given: dict[str, Cell] = {}
        for name, a in list(zip(names, e.args)) + list(e.named.items()):
            if name not in names or name in given:
                raise BindError(f"{m.name}: argument {name} is unknown or given twice")
            given[name] = self.lower(a)
        if len(e.args) > len(names) or len(given) < len(names):
            raise BindError(f"{m.name} takes {len(names)} arguments")
        before, grouping = self.bound, self.grouping
        # The body is lowered as if written in place of the call, over the arguments with their errors.
        self.bound = {n: c.of(self.type_of(c)) for n, c in given.items()}
        self.grouping = False
        try:
            return self.lower(m.body)
        finally:
            self.bound, self.grouping = before, grouping

    def _function(self, e: N.Call) -> Cell:
        f = self.context.registry.get(e.name)
        bound = f.bind(e.args, e.named)
        limit = None
        arguments: dict[str, Cell] = {}
        kinds = {p.name: p.kind for p in f.parameters}
        called = {n: self.context.registry.callback(".".join(a.parts)) for n, a in bound.items() if kinds[n] == "function" and isinstance(a, N.Name)}
        if called:
            f = replace(f, python=partial(f.python, **called, functions=self.context.registry.own()))
        for name, a in bound.items():
            if name in called:
                continue
            if kinds[name] == "function":
                raise BindError(f"{e.name}: {name} is the name of a function")
            if name in f.controls:
                if not isinstance(a, N.Name) or a.parts[0] not in self.context.limits and a.parts[0] not in self.context.inputs:
                    raise BindError(f"{e.name}: {name} must be a declared input")
                if a.parts[0] in self.context.limits:
                    limit = U.Limit(self.context.limits[a.parts[0]], a.parts[0], self.context.permits)
            else:
                arguments[name] = self.lower(a)
        if f.column is not None and f.python is None or f.column is not None and not self.grouping:
            order = [p.name for p in f.parameters if p.name in arguments]
            return A.lift(lambda *v: f.column(**dict(zip(_column_names(f.column, order), v))), *[arguments[n] for n in order])
        if self.grouping:
            raise ScriptError(f"{e.name} over aggregates: call it in an outer query")
        hidden, cell = U.prepare(f, arguments, limit)
        return cell(self.hide(hidden))

    def _aggregate(self, e: N.Call) -> Cell:
        if not self.grouping:
            raise ScriptError(f"{e.name} is an aggregate; it is not allowed here")
        name = e.name.lower()
        if name in ("grouping", "grouping_id"):
            return Cell(F.call_function(name, *[self.lower(a).value for a in e.args]))
        self.grouping = False
        try:
            if len(e.args) == 1 and isinstance(e.args[0], N.Star) or not e.args:
                cells: list[Cell] = []
            else:
                cells = [self.lower(a) for a in e.args]
            test = self.lower(e.filter) if e.filter is not None else None
        finally:
            self.grouping = True

        def fn(*v: Column) -> Column:
            v = v or (F.lit(1),)
            if test is not None:
                v = (F.when(A.decision(test, "FILTER"), v[0]), *v[1:])
            if e.distinct:
                if name not in ("count", "sum", "avg", "collect_list"):
                    return F.call_function(name, *v)
                return {"count": F.count_distinct, "sum": F.sum_distinct, "avg": lambda x: F.sum_distinct(x) / F.count_distinct(x), "collect_list": F.collect_set}[name](*v)
            return F.call_function(name, *v)

        return A.aggregate(fn, *cells)

    def _over(self, e: N.Call) -> Cell:
        args = [self.lower(a) for a in e.args if not isinstance(a, N.Star)]
        parts = [self.lower(p) for p in e.window.partition]
        orders = [(self.lower(o.expr), o) for o in e.window.order]
        w = Window.partitionBy(*[p.plain() for p in parts])
        if orders:
            w = w.orderBy(*[_direction(c.plain(), o) for c, o in orders])
        if e.window.frame:
            w = _framed(w, e.window.frame)
        name = e.name.lower()
        star = not args and name == "count"
        literal = [a.value if isinstance(a, N.Literal) else None for a in e.args]

        def fn(*v: Column) -> Column:
            if name in ("lag", "lead"):
                offset = literal[1] if len(literal) > 1 else 1
                default = literal[2] if len(literal) > 2 else None
                return (F.lag if name == "lag" else F.lead)(v[0], offset, default)
            if name == "ntile":
                return F.ntile(literal[0])
            if name == "nth_value":
                return F.nth_value(v[0], literal[1])
            return F.call_function(name, *((F.lit(1),) if star else v))

        return A.over(fn, w, args, [*parts, *[c for c, _ in orders]])


def _all(parts) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


def _framed(w, text: str):
    """ROWS or RANGE frames with whole-number bounds."""
    words = text.lower().split()
    kind, bounds = words[0], " ".join(words[1:]).removeprefix("between ").split(" and ")
    if len(bounds) == 1:
        bounds.append("current row")

    def bound(b: str) -> int:
        amount, _, side = b.partition(" ")
        if b == "current row":
            return Window.currentRow
        if amount == "unbounded":
            return Window.unboundedPreceding if side == "preceding" else Window.unboundedFollowing
        if not amount.isdigit() or side not in ("preceding", "following"):
            raise unsupported(f"frame bound {b}", "use a whole number")
        return -int(amount) if side == "preceding" else int(amount)

    return (w.rowsBetween if kind == "rows" else w.rangeBetween)(*[bound(b.strip()) for b in bounds])


def _pair(cell: Cell) -> tuple[Column, tuple[Column, ...]]:
    return cell.value, cell.parts


def _column_names(fn, order: list[str]) -> list[str]:
    import inspect

    own = list(inspect.signature(fn).parameters)
    if any(p.kind is inspect.Parameter.VAR_KEYWORD for p in inspect.signature(fn).parameters.values()):
        return order
    return own[: len(order)]


def _direction(c: Column, o: N.Order) -> Column:
    nulls = o.nulls or ("last" if o.desc else "first")
    return getattr(c, f"{'desc' if o.desc else 'asc'}_nulls_{nulls}")()


def _has_aggregate(node, context: Context) -> bool:
    """An aggregate call outside OVER, also through macros."""
    if isinstance(node, N.Call):
        if node.window is not None:
            return any(_has_aggregate(a, context) for a in node.args)
        if node.name.lower() in AGGREGATES:
            return True
    if isinstance(node, N.Subquery):
        return False
    if isinstance(node, (list, tuple)):
        return any(_has_aggregate(c, context) for c in node)
    if hasattr(node, "__dataclass_fields__"):
        return any(_has_aggregate(getattr(node, f), context) for f in node.__dataclass_fields__)
    return False


def output_name(item: N.Item) -> str:
    if item.alias:
        return item.alias
    if isinstance(item.expr, N.Name):
        return item.expr.parts[-1]
    if isinstance(item.expr, N.Path):
        return str(item.expr.steps[-1])
    return " ".join(item.text.split())


def lower_query(q: N.Query, context: Context, ctes: dict[str, CellFrame] | None = None) -> CellFrame:
    for construct in q.banned:
        if construct in NEVER or context.strict:
            raise unsupported(construct, REWRITES[construct])
    known = dict(ctes or {})
    for name, sub in q.ctes:
        known[name] = lower_query(sub, context, known)
    if q.operator:
        return _set_operation(q, context, known)
    low = Lowering(context, known)
    if q.source is not None:
        low.add_source(q.source)
    else:
        low.df = context.spark.range(1).select(F.lit(0).alias("__one"))
    for j in q.joins:
        low.join(j)
    _laterals(q, low)
    if q.where is not None:
        low.df = low.df.where(A.decision(low.lower(q.where), "WHERE"))
    _generators(q, low)
    aggregated = bool(q.group) or _has_aggregate([i.expr for i in q.items], context) or _has_aggregate(q.having, context)
    return _cut(_grouped(q, low) if aggregated else _projected(q, low), q, context)


def _cut(out: CellFrame, q: N.Query, context: Context) -> CellFrame:
    skip = limit_rows(q.offset, context) if q.offset is not None else 0
    if q.limit is not None:
        return out.limit(limit_rows(q.limit, context), skip)
    return out.offset(skip) if skip else out


def limit_rows(e: N.Expr, context: Context) -> int:
    if isinstance(e, N.Literal) and isinstance(e.value, int):
        return e.value
    if isinstance(e, N.Name) and e.parts[0] in context.inputs:
        return int(context.spark.range(1).select(context.inputs[e.parts[0]].value).first()[0])
    raise ScriptError("LIMIT and OFFSET take a number or a declared input")


def _set_operation(q: N.Query, context: Context, known: dict[str, CellFrame]) -> CellFrame:
    left, right = (CellFrame.wrap(f.df, clean=f.clean) for f in (lower_query(q.left, context, known), lower_query(q.right, context, known)))
    if len(left.columns) != len(right.columns):
        raise ScriptError("both sides of a set operation need as many columns")
    places = dict(zip(right.columns, left.columns))
    right = CellFrame(right.df.toDF(*left.columns), {places[c] for c in right.clean})
    op = q.operator
    if op.startswith("union"):
        out = left.union(right, distinct=op == "union")
    else:
        # Rows are compared by value; an errored cell has none, so it fails the stage.
        a, b = (f.df.select(*[A.decision(f[n], op.upper()).alias(n) for n in f.columns]) for f in (left, right))
        fn = {"intersect": a.intersect, "intersect all": a.intersectAll, "except": a.subtract, "except all": a.exceptAll}[op]
        out = CellFrame.wrap(fn(b))
    if q.order:
        out = out.order(*[(out[".".join(o.expr.parts)] if isinstance(o.expr, N.Name) else out[out.columns[o.expr.value - 1]], _how(o)) for o in q.order])
    return _cut(out, q, context)


def _how(o: N.Order) -> str:
    return f"{'desc' if o.desc else 'asc'}_nulls_{o.nulls or ('last' if o.desc else 'first')}"


def _laterals(q: N.Query, low: Lowering) -> None:
    """LATERAL VIEW: a row per item beside the columns so far."""
    for n, view in enumerate(q.laterals):
        name = view.call.name.lower()
        if name not in GENERATORS:
            raise ScriptError(f"LATERAL VIEW {view.call.name} is not supported; use explode or posexplode")
        items = low.lower(view.call.args[0])
        positions = name.startswith("pos")
        names = view.names if len(view.names) == 1 + positions else ["pos", "col"] if positions else ["col"]
        cell, at = f"__l{n}", f"__lp{n}" if positions else None
        low.explode(items.of(low.type_of(items)), cell, at, view.outer or name.endswith("_outer"))
        columns = {names[-1]: cell} | ({names[0]: at} if positions else {})
        low.sources.append(_Source(f"__lateral{n}", columns))


def _generators(q: N.Query, low: Lowering) -> None:
    """Row-expanding items first: their outputs are names that all items may use."""
    for n, item in enumerate(q.items):
        if isinstance(item.expr, N.Call) and item.expr.name.lower() in GENERATORS:
            items = low.lower(item.expr.args[0])
            items = items.of(low.type_of(items))
            positions = item.expr.name.lower().startswith("pos")
            names = item.aliases or ([item.alias] if item.alias else (["pos", "col"] if positions else ["col"]))
            if len(names) != 1 + positions:
                raise ScriptError(f"{item.expr.name} has {1 + positions} outputs")
            cell, at = f"__g{n}", f"__p{n}" if positions else None
            low.explode(items, cell, at, item.expr.name.lower().endswith("_outer"))
            low.scoped[names[-1]] = cell
            outputs = [N.Item(N.Name([names[-1]]), names[-1])]
            if positions:
                low.scoped[names[0]] = at
                outputs.insert(0, N.Item(N.Name([names[0]]), names[0]))
            item.aliases, item.expr = None, N.ListLiteral([o.expr for o in outputs])
            item.text = "\x00" + "\x00".join(o.alias for o in outputs)


def _items(q: N.Query, low: Lowering) -> list[tuple[str, Cell]]:
    out: list[tuple[str, Cell]] = []
    for item in q.items:
        if item.text.startswith("\x00"):
            out += [(n, low.stored(low.scoped[n])) for n in item.text[1:].split("\x00")]
        elif isinstance(item.expr, N.Star):
            for s in low.sources:
                if item.expr.source in (None, s.alias):
                    out += [(c, low.stored(new)) for c, new in s.columns.items()]
        else:
            out.append((output_name(item), low.lower(item.expr)))
    names = [n for n, _ in out]
    twice = {n for n in names if names.count(n) > 1}
    if twice:
        raise ScriptError(f"the projection has {', '.join(sorted(twice))} twice")
    return out


def _projected(q: N.Query, low: Lowering) -> CellFrame:
    cells = dict(_items(q, low))
    order: list[tuple[Column, str]] = []
    for o in q.order:
        name = o.expr.parts[0] if isinstance(o.expr, N.Name) and len(o.expr.parts) == 1 else None
        if name in cells:
            cell = cells[name]
        elif isinstance(o.expr, N.Literal) and isinstance(o.expr.value, int):
            cell = list(cells.values())[o.expr.value - 1]
        else:
            cell = low.lower(o.expr)
        order.append((A.decision(cell, "ORDER BY"), _how(o)))
    keep = None
    if q.qualify is not None:
        before = low.bound
        low.bound = {**{n: A.without_stored(c) for n, c in cells.items() if not any(n in s.columns for s in low.sources)}, **before}
        keep = A.decision(low.lower(q.qualify), "QUALIFY")
        low.bound = before
    out = CellFrame(low.df, low.clean).select(cells, keep, [] if q.distinct else order)
    if q.distinct:
        out = out.distinct()
        if q.order:
            out = out.order(*[(out[o.expr.parts[-1]], _how(o)) for o in q.order])
    return out


def _grouped(q: N.Query, low: Lowering) -> CellFrame:
    aliases = {i.alias: i.expr for i in q.items if i.alias}
    key_cells = []
    for n, g in enumerate(q.group):
        if isinstance(g, N.Literal) and isinstance(g.value, int):
            g = q.items[g.value - 1].expr
        elif isinstance(g, N.Name) and len(g.parts) == 1 and g.parts[0] in aliases and not any(g.parts[0] in s.columns for s in low.sources):
            g = aliases[g.parts[0]]
        key_cells.append((g, low.lower(g)))
    errors = []
    for n, (g, c) in enumerate(key_cells):
        value = F.to_json(c.plain()) if isinstance(low.type_of(c), T.VariantType) else c.plain()
        low.df = low.df.withColumn(f"__k{n}", value)
        errors.append(None)
        if c.errors is not None:
            low.df = low.df.withColumn(f"__ke{n}", c.errors)
            errors[n] = A.gathered((F.when(F.size(F.col(f"__ke{n}")) > 0, F.col(f"__ke{n}")),))
    low.keys = [(g, Cell(F.col(f"__k{n}"), errors[n])) for n, (g, _) in enumerate(key_cells)]
    low.grouping = True
    cells = dict(_items(q, low))
    having = low.lower(q.having) if q.having is not None else None
    named = []
    for o in q.order:
        if isinstance(o.expr, N.Name) and o.expr.parts[-1] in cells:
            named.append((o.expr.parts[-1], None, o))
        else:
            named.append((None, _order_of_group(o.expr, low), o))
    parts = []
    for i, c in enumerate(cells.values()):
        parts.append(c.value.alias(f"__v{i}"))
        if c.errors is not None:
            parts.append(c.errors.alias(f"__e{i}"))
    if having is not None:
        parts.append(A.decision(having, "HAVING").alias("__having"))
    for i, (name, c, _) in enumerate(named):
        if name is None:
            parts.append(A.decision(c, "ORDER BY").alias(f"__o{i}"))
    columns = [F.col(f"__k{n}") for n in range(len(low.keys))]
    if q.group_kind == "grouping sets":
        places = [next(n for n, g in enumerate(q.group) if g == e) for s in q.sets for e in s]
        at = iter(places)
        grouped = low.df.groupingSets([[columns[next(at)] for _ in s] for s in q.sets], *columns)
    else:
        grouped = {"rollup": low.df.rollup, "cube": low.df.cube}.get(q.group_kind, low.df.groupBy)(*columns)
    df = grouped.agg(*parts)
    if having is not None:
        df = df.where("__having")
    places = {n: i for i, n in enumerate(cells)}
    if named:
        df = df.orderBy(*[_direction(F.col(f"__v{places[name]}") if name else F.col(f"__o{i}"), o) for i, (name, _, o) in enumerate(named)])
    final = [A.assemble(Cell(F.col(f"__v{i}"), F.col(f"__e{i}") if c.errors is not None else None)).alias(n) for i, (n, c) in enumerate(cells.items())]
    out = CellFrame(df.select(*final), {n for n, c in cells.items() if c.errors is None})
    return out.distinct() if q.distinct else out


def _order_of_group(e: N.Expr, low: Lowering) -> Cell:
    """An order key of a grouped query; what is neither grouped nor aggregated counts as the group's first value."""
    try:
        return low.lower(e)
    except Ungrouped:
        low.grouping = False
        try:
            return A.aggregate(lambda v: F.first(v, ignorenulls=True), low.lower(e))
        finally:
            low.grouping = True
