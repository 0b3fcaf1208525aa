"""Plain mode: queries of a recipe as Spark SQL over stages without cells.

The text goes to Spark's own parser, so that all of its SQL is there: semi, anti, cross and theta joins, window
frames, ROLLUP and PIVOT, subqueries, LATERAL VIEW, recursive CTEs. Stages are temporary views, declared inputs
session variables, macros and Python functions temporary functions (`ns.f` under the name `ns_f`).
"""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..functions import udf as U
from ..functions.registry import Registry
from ..script import statements as S
from ..script.lower import Context
from ..script.surface import ScriptError, tokenize


def query(spark: SparkSession, text: str, context: Context, values: dict[str, Any], statements: list[S.Statement]) -> DataFrame:
    """A query's DataFrame. Views, variables and functions are only there while it is analysed."""
    drop: list[str] = []
    try:
        for name, df in context.tables.items():
            if re.search(rf"\b{re.escape(name)}\b", text):
                df.createOrReplaceTempView(name)
                drop.append(f"VIEW IF EXISTS `{name}`")
        for s in statements:
            if isinstance(s, S.DeclareInput) and s.name in context.inputs and re.search(rf"\b{re.escape(s.name)}\b", text):
                kind = spark.range(1).select(context.inputs[s.name].value.alias("v")).schema["v"].dataType.simpleString()
                spark.sql(f"DECLARE OR REPLACE VARIABLE `{s.name}` {kind}")
                drop.append(f"TEMPORARY VARIABLE IF EXISTS `{s.name}`")
                spark.sql(f"SET VARIABLE `{s.name}` = CAST(:v AS {kind})", args={"v": None if values.get(s.name) is None else str(values[s.name])})
        macros = {s.name: s for s in statements if isinstance(s, S.CreateFunction)}
        for s in macros.values():
            parameters = ", ".join(f"{n} {k}" for n, k in s.parameters)
            body = _renamed(s.text[re.search(r"\breturn\b(?!s)", s.text, re.IGNORECASE).end() :], macros, context.registry)
            returns = f"RETURNS {s.returns} " if s.returns else ""
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {_name(s.name)}({parameters}) {returns}RETURN {body}")
            drop.append(f"TEMPORARY FUNCTION IF EXISTS {_name(s.name)}")
        for name in _calls(text, context.registry):
            f = context.registry.get(name)
            if f.python is None:
                raise ScriptError(f"{name} needs a {f.needs}")
            spark.udf.register(_name(name), U.row_function(_positional(f), "string" if f.returns == "variant" else f.returns, f.returns == "variant"))
            drop.append(f"TEMPORARY FUNCTION IF EXISTS {_name(name)}")
        return spark.sql(_renamed(text, macros, context.registry))
    finally:
        for what in drop:
            spark.sql(f"DROP {what}")


def _name(name: str) -> str:
    return name.replace(".", "_")


def _positional(f):
    names = [p.name for p in f.parameters if p.name not in f.controls]
    return lambda *args: f.python(**dict(zip(names, args)))


def _calls(text: str, registry: Registry) -> set[str]:
    return {name for name, _, _ in _dotted(text) if name in registry}


def _dotted(text: str) -> list[tuple[str, int, int]]:
    """Names before an opening bracket, with their places."""
    tokens, out = tokenize(text), []
    for i, t in enumerate(tokens):
        if t.kind != "name" or (i and tokens[i - 1].text == "."):
            continue
        j = i
        while j + 2 < len(tokens) and tokens[j + 1].text == "." and tokens[j + 2].kind == "name":
            j += 2
        if j + 1 < len(tokens) and tokens[j + 1].text == "(":
            out.append((text[t.start : tokens[j].end], t.start, tokens[j].end))
    return out


def _renamed(text: str, macros: dict[str, S.CreateFunction], registry: Registry) -> str:
    """Calls of `ns.f` as `ns_f`; `name = value` arguments of these as Spark's `name => value`."""
    known = {n for n in macros} | set(registry.functions)
    for name, start, end in reversed(_dotted(text)):
        if name not in known:
            if "." in name:
                raise ScriptError(f"unknown function {name}")
            continue
        tokens, depth, marks = tokenize(text[end:]), 0, []
        for i, t in enumerate(tokens):
            depth += (t.text in "([{") - (t.text in ")]}") if t.kind == "op" else 0
            if depth == 0:
                break
            if depth == 1 and t.text == "=" and i > 1 and tokens[i - 1].kind == "name" and tokens[i - 2].text in ("(", ","):
                marks.append(end + t.start)
        for at in reversed(marks):
            text = text[:at] + "=>" + text[at + 1 :]
        text = text[:start] + _name(name) + text[end:]
    return text

