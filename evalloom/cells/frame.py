"""Relational operators over tables of cells.

Each operator is one declarative DataFrame step. A projection is compiled in two: the values and errors of its
expressions become plain hidden columns, once each, and the stored cells are built from those, so no expression
is evaluated twice and generated methods stay small. Joins, grouping and ordering work on values; Catalyst
chooses their physical form.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import algebra as A
from . import types as C
from .algebra import Cell


class CellFrame:
    """A DataFrame whose columns are cells, or raw columns that are read as cells without errors.

    `clean` names the columns of cells that hold no error: those made of error-free expressions, and those of
    stored stages whose manifest counted none. Their errors are neither read nor checked, so that filters, joins
    and aggregates over them are those of plain columns.
    """

    def __init__(self, df: DataFrame, clean: Iterable[str] = ()) -> None:
        self.df, self.clean = df, frozenset(clean)

    # --- sources ------------------------------------------------------------------------------------------

    @classmethod
    def wrap(cls, df: DataFrame, stage: str | None = None, clean: Iterable[str] = ()) -> CellFrame:
        """Every column as a cell. Present cells are kept, older layouts refused.

        With a stage, each cell gets an id of its own, also where a cell came from another stage.
        """
        for f in df.schema:
            if C.is_old_cell(f.dataType):
                raise ValueError(f"column {f.name} holds cells of an older layout")
        known = set(clean)
        if stage:
            df = df.withColumn("__row", cls._row_id(df, stage))
        columns = []
        for f in df.schema:
            if f.name == "__row" and stage:
                continue
            c = F.col(f"`{f.name}`")
            own = F.md5(F.concat_ws("|", F.col("__row"), F.lit(f.name))) if stage else None
            if C.is_cell(f.dataType):
                columns.append(c if own is None else F.struct(own.alias("cell_id"), c["value"].alias("value"), cls._metadata(c).alias("metadata"), F.lit(True).alias("marker")).alias(f.name))
                continue
            known.add(f.name)
            columns.append(A.assemble(A.raw(c), own).alias(f.name))
        return cls(df.select(*columns), known)

    @staticmethod
    def _metadata(c: Column) -> Column:
        """A cell's metadata; that of an unmatched side of an outer join, which has no cell, is empty."""
        m = c["metadata"]
        return F.struct(F.coalesce(m["errors"], A.no_errors()).alias("errors"), m["latency_ms"].alias("latency_ms"), m["trace"].alias("trace"))

    @staticmethod
    def _row_id(df: DataFrame, stage: str) -> Column:
        """A hash of the stage and the row's content; in a batch also of its place, so that equal rows differ.

        It needs no window and no shuffle. A stream's rows have no place that outlives a restart: there equal rows
        share their id.
        """
        values = []
        for f in df.schema:
            c, kind = F.col(f"`{f.name}`"), f.dataType
            if C.is_cell(kind):
                c, kind = c["value"], kind["value"].dataType
            values.append(c if isinstance(kind, T.AtomicType) and not isinstance(kind, T.VariantType) else F.to_json(F.struct(c)))
        parts = [F.lit(stage), F.xxhash64(*values).cast("string"), F.xxhash64(F.lit(17), *values).cast("string")]
        if not df.isStreaming:
            parts.append(F.monotonically_increasing_id().cast("string"))
        return F.concat_ws("|", *parts)

    # --- columns ------------------------------------------------------------------------------------------

    def __getitem__(self, name: str) -> Cell:
        kind = self.df.schema[name].dataType
        c = F.col(f"`{name}`")
        return A.column(c, kind, name in self.clean) if C.is_cell(kind) else A.raw(c, kind)

    def _clean_of(self, cells: Mapping[str, Cell]) -> set[str]:
        return {n for n, c in cells.items() if not c.parts}

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    # --- operators ----------------------------------------------------------------------------------------

    def select(self, cells: Mapping[str, Cell], keep: Column | None = None, order: Sequence[tuple[Column, str]] = ()) -> CellFrame:
        """A projection; bare columns pass whole, everything else is rebuilt from its value, errors, latency and trace.

        keep and order are evaluated beside the values, so that they may hold window functions.
        """
        hidden, final = [], []
        for i, (name, c) in enumerate(cells.items()):
            if c.stored is not None:
                hidden.append(c.stored.alias(f"__v{i}"))
                final.append(F.col(f"__v{i}").alias(name))
                continue
            parts = {}
            for part in ("value", "errors", "latency", "trace"):
                made = getattr(c, part)
                if made is not None:
                    parts[part] = F.col(f"__{part[0]}{i}")
                    hidden.append(made.alias(f"__{part[0]}{i}"))
            final.append(A.assemble(Cell(**parts)).alias(name))
        if keep is not None:
            hidden.append(keep.alias("__keep"))
        hidden += [c.alias(f"__o{i}") for i, (c, _) in enumerate(order)]
        df = self.df.select(*hidden)
        if keep is not None:
            df = df.where("__keep")
        if order:
            df = df.orderBy(*[getattr(F.col(f"__o{i}"), how)() for i, (_, how) in enumerate(order)])
        return CellFrame(df.select(*final), self._clean_of(cells))

    def with_cells(self, cells: Mapping[str, Cell]) -> CellFrame:
        keep = {n: self[n] for n in self.columns if n not in cells}
        return self.select({**keep, **cells})

    def where(self, condition: Cell, clause: str = "WHERE") -> CellFrame:
        return CellFrame(self.df.where(A.decision(condition, clause)), self.clean)

    def join(self, other: CellFrame, on: Callable[[CellFrame, CellFrame], Cell], how: str = "inner") -> CellFrame:
        """on() gets both sides under the aliases it may name; columns of equal names stay apart by these.

        A condition over columns that may hold errors is one check and can't be a join's key: give those as keys.
        """
        return CellFrame(self.df.join(other.df, A.decision(on(self, other), "JOIN ON"), how), self.clean | other.clean)

    def join_keys(self, other: CellFrame, keys: list[tuple[Cell, Cell]], how: str = "inner", extra: Column | None = None) -> CellFrame:
        """A join on equalities of a cell of this side and one of the other; the job fails where a key is errored.

        Keys that may be errored are checked in hidden columns before the join, so that the join itself is on
        plain equalities and Spark can sort, hash or broadcast by them.
        """
        left, right, on = self.df, other.df, extra
        for i, (a, b) in enumerate(keys):
            if a.parts:
                left, a = left.withColumn(f"__jl{i}", A.decision(a, "JOIN ON")), Cell(F.col(f"__jl{i}"))
            if b.parts:
                right, b = right.withColumn(f"__jr{i}", A.decision(b, "JOIN ON")), Cell(F.col(f"__jr{i}"))
            on = a.value == b.value if on is None else (a.value == b.value) & on
        names = [f"__j{side}{i}" for side in "lr" for i in range(len(keys))]
        return CellFrame(left.join(right, on, how).drop(*names), self.clean | other.clean)

    def renamed(self, prefix: str) -> CellFrame:
        return CellFrame(self.df.select(*[F.col(f"`{c}`").alias(prefix + c) for c in self.columns]), {prefix + c for c in self.clean})

    def group(self, keys: Mapping[str, Cell], aggregates: Mapping[str, Cell], having: Callable[[CellFrame], Cell] | None = None) -> CellFrame:
        """Group by values; each key comes out with its group's errors, errored keys group as null."""
        grouped = [k.plain().alias(f"__k{i}") for i, k in enumerate(keys.values())]
        parts = []
        for i, k in enumerate(keys.values()):
            if k.errors is not None:
                parts.append(A.gathered(k.parts).alias(f"__ke{i}"))
        for i, c in enumerate(aggregates.values()):
            parts.append(c.value.alias(f"__a{i}"))
            if c.errors is not None:
                parts.append(c.errors.alias(f"__ae{i}"))
        df = self.df.groupBy(*grouped).agg(*parts) if parts else self.df.groupBy(*grouped).agg(F.count(F.lit(1)).alias("__n"))
        final = [
            A.assemble(Cell(F.col(f"__k{i}"), F.col(f"__ke{i}") if k.errors is not None else None)).alias(n) for i, (n, k) in enumerate(keys.items())
        ] + [A.assemble(Cell(F.col(f"__a{i}"), F.col(f"__ae{i}") if c.errors is not None else None)).alias(n) for i, (n, c) in enumerate(aggregates.items())]
        out = CellFrame(df.select(*final), self._clean_of(keys) | self._clean_of(aggregates))
        return out.where(having(out), "HAVING") if having else out

    def order(self, *keys: tuple[Cell, str]) -> CellFrame:
        """keys: (cell, 'asc' | 'desc' | 'asc_nulls_last' | ...)."""
        return CellFrame(self.df.orderBy(*[getattr(A.decision(c, "ORDER BY"), how)() for c, how in keys]), self.clean)

    def limit(self, n: int, offset: int = 0) -> CellFrame:
        return CellFrame((self.df.offset(offset) if offset else self.df).limit(n), self.clean)

    def offset(self, n: int) -> CellFrame:
        return CellFrame(self.df.offset(n), self.clean)

    def distinct(self) -> CellFrame:
        """Distinct values; VARIANT, which Spark can't compare, counts as its JSON text."""
        keys = {n: self._comparable(self[n]) for n in self.columns}
        return self.group(keys, {})

    @staticmethod
    def _comparable(c: Cell) -> Cell:
        return Cell(F.to_json(c.value), c.parts) if isinstance(c.kind, T.VariantType) else A.without_stored(c)

    def union(self, other: CellFrame, distinct: bool = False) -> CellFrame:
        places = {n for n, m in zip(self.columns, other.columns) if self[n].errors is None and other[m].errors is None}
        merged = CellFrame(self.df.unionAll(other.df), places)
        return merged.distinct() if distinct else merged

    def explode(self, items: Cell, name: str, position: str | None = None, outer: bool = False) -> CellFrame:
        """A row per item, beside all columns; each item carries the errors of the array."""
        value = items.value
        if isinstance(items.kind, T.VariantType):
            value = F.from_json(F.to_json(value), "array<variant>")
        df = self.df
        if items.errors is not None:
            df = df.withColumn("__ge", items.errors)
        generator = (F.posexplode_outer if outer else F.posexplode)(value).alias("__gp", "__gv")
        df = df.select("*", generator)
        errors = F.col("__ge") if items.errors is not None else None
        df = df.withColumn(name, A.assemble(Cell(F.col("__gv"), errors)))
        if position:
            df = df.withColumn(position, A.assemble(Cell(F.col("__gp"), errors)))
        made = {name, position} - {None} if errors is None else set()
        return CellFrame(df.drop("__gp", "__gv", "__ge"), self.clean | made)

    # --- results ------------------------------------------------------------------------------------------

    def unwrap(self) -> DataFrame:
        """The values; cells inside structs and arrays are unwrapped too."""
        return self.df.select(*[_bare(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in self.df.schema])

    def error_count(self, name: str) -> Column:
        return F.size(F.coalesce(F.col(f"`{name}`")["metadata"]["errors"], A.no_errors()))

    def first_code(self, name: str) -> Column:
        """Code of the first error of a cell; null if it has none."""
        return F.get(F.col(f"`{name}`")["metadata"]["errors"], F.lit(0))["code"]


def _holds_cells(kind: T.DataType) -> bool:
    if C.is_cell(kind):
        return True
    if isinstance(kind, T.ArrayType):
        return _holds_cells(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_holds_cells(f.dataType) for f in kind)
    return False


def _bare(c: Column, kind: T.DataType) -> Column:
    if C.is_cell(kind):
        return _bare(c["value"], kind["value"].dataType)
    if not _holds_cells(kind):
        return c
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _bare(x, kind.elementType))
    return F.when(c.isNull(), None).otherwise(F.struct(*[_bare(c[f.name], f.dataType).alias(f.name) for f in kind]))
