"""Deeply nested records into related flat tables by Dewey labelling.

Every object that is an element of a list becomes a node. Its label is the list of ordinal path steps from
the column to it, one step per enclosing node, so that the parent's label is the label without its last step
and ancestors at any distance are truncations. Nodes of one schema path (the path without ordinals) form one
flat table. All that stands between two nodes belongs to the nearer one above: its attributes hold the scalars
under their dotted path (`arguments.limit`), lists of scalars, plain text and empty lists and objects whole, and
the scalars of a list that also holds nodes under their ordinal (`content[2]`). Keys that hold a point, bracket or
backquote are quoted by backquotes, so that no two values share a path. What stands above all nodes of a column
(plain text in its list) forms one row that is named like the column, unless it is all null or empty.

The walk runs once per record inside Arrow batches with its own stack, so depth is bounded by memory only;
nothing is grouped, and parent links need no join.

Nulls: null elements and plain text keep their ordinal but give no node; text that isn't JSON is plain text.
Numbers that JSON can't write (NaN, Infinity, overflowing ones) stay text.
Duplicate node paths of redelivered records count once.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .strict_json import deep_value


@dataclass(frozen=True)
class NestedSpec:
    """What the walk has to know about a column beyond its JSON.

    columns: paths `column.field` to walk. list_keys: keys under which a bare object counts as element 0.
    json_keys: keys whose text value is itself JSON. scoped_list_keys: such keys that count only below a path.
    json_fields: fields of the typed part (arrays of structs) that hold JSON text.
    """

    columns: tuple[str, ...]
    list_keys: frozenset[str]
    json_keys: frozenset[str] = frozenset()
    scoped_list_keys: dict[str, str] = field(default_factory=dict)
    json_fields: frozenset[str] = frozenset()


class _Json(str):
    """Text that stands for the JSON value in it."""


def _float(text: str) -> float | str:
    return value if math.isfinite(value := float(text)) else text


_DECODER = json.JSONDecoder(parse_float=_float, parse_constant=str)


def _decode(text: str):
    """The value that JSON text holds, however often it is wrapped in text; the text itself if it isn't JSON."""
    value = text
    while isinstance(value, str):
        try:
            inner = _DECODER.decode(value)
        except ValueError:
            return value
        except RecursionError:
            try:
                inner = deep_value(value, _float)
            except ValueError:
                return value
        if isinstance(inner, str) and inner == value:
            return value
        value = inner
    return value


def _typed(value, json_fields: frozenset[str], name: str):
    """A value of a typed column: text in a JSON field is marked, the rest stays."""
    if isinstance(value, str):
        return _Json(value) if name in json_fields else value
    if isinstance(value, list):
        return [_typed(v, json_fields, name) for v in value]
    if isinstance(value, dict):
        return {k: _typed(v, json_fields, k) for k, v in value.items()}
    return value


def _quoted(key: str) -> str:
    """A key as a step of an attribute's path."""
    return "`" + key.replace("`", "``") + "`" if not key or any(c in key for c in ".[]`") else key


def _between(start: list[tuple], label: tuple[str, ...], spec: NestedSpec) -> tuple[dict, list[tuple]]:
    """What stands below a node down to the next ones: its leaves by attribute path, and (value, label) of those nodes."""
    leaves, nodes = {}, []
    # (value, key it stands under, path since the node, attribute path, is it a list element)
    stack = start[::-1]
    while stack:
        value, key, step, name, element = stack.pop()
        value = _opened(value, key, spec)
        scope = spec.scoped_list_keys.get(key)
        stands = key in spec.list_keys or scope is not None and scope in "".join((*label, step))
        if isinstance(value, dict) and not element and stands:
            value = [value]
        if isinstance(value, list):
            value = [_opened(v, key, spec) for v in value]
            if any(isinstance(v, (dict, list)) for v in value):
                stack += [(v, key, f"{step}[{i}]", f"{name}[{i}]", True) for i, v in reversed(list(enumerate(value)))]
                continue
        elif isinstance(value, dict) and element:
            nodes.append((value, (*label, step)))
            continue
        elif isinstance(value, dict) and value:
            stack += [(v, str(k), f"{step}.{k}", f"{name}.{_quoted(str(k))}", False) for k, v in reversed(list(value.items()))]
            continue
        leaves[name] = value
    return leaves, nodes


def _opened(value, key: str, spec: NestedSpec):
    """The value itself, or the one that its JSON text holds."""
    return _decode(str(value)) if isinstance(value, _Json) or isinstance(value, str) and key in spec.json_keys else value


def walk(value, column: str, spec: NestedSpec) -> Iterator[tuple[list[str], list[str], str]]:
    """(label, schema path steps, own leaves as JSON) of every node of one column value, in document order.

    Leaves above all nodes come first, under the column as the only step.
    """
    short = column.rpartition(".")[2]
    leaves, stack = _between([(_typed(value, spec.json_fields, short), short, column, _quoted(short), False)], (), spec)
    if any(v is not None and v != {} and not (isinstance(v, list) and all(x is None for x in v)) for v in leaves.values()):
        yield [column], [column], _text(leaves)
    stack.reverse()
    while stack:
        value, label = stack.pop()
        leaves, nodes = _between([(v, str(k), f".{k}", _quoted(str(k)), False) for k, v in value.items()], label, spec)
        yield list(label), [_pathless(s) for s in label], _text(leaves)
        stack += reversed(nodes)


_UNPAIRED = re.compile("[\ud800-\udfff]")


def _text(leaves: dict) -> str:
    text = json.dumps(leaves, ensure_ascii=False, default=str)
    return json.dumps(leaves, default=str) if not text.isascii() and _UNPAIRED.search(text) else text


def _pathless(step: str) -> str:
    """A path step without its ordinals."""
    while step.endswith("]"):
        step = step[: step.rindex("[")] + "*"
    return step


NODE = "label array<string>, schema_steps array<string>, attributes string"


def _node_batches(keys: list[str], spec: NestedSpec, key_types: list[pa.DataType]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = {k: batch.column(k).to_pylist() for k in keys}
            values = {c: batch.column(f"__c{n}").to_pylist() for n, c in enumerate(spec.columns)}
            at, labels, steps, own = [], [], [], []

            def flush() -> pa.RecordBatch:
                arrays = [pa.array([kept[k][i] for i in at], t) for k, t in zip(keys, key_types)]
                arrays += [pa.array(labels, pa.list_(pa.string())), pa.array(steps, pa.list_(pa.string())), pa.array(own, pa.string())]
                out = pa.RecordBatch.from_arrays(arrays, names=[*keys, "label", "schema_steps", "attributes"])
                for x in (at, labels, steps, own):
                    x.clear()
                return out

            for i in range(len(batch)):
                for column in spec.columns:
                    if (value := values[column][i]) is None:
                        continue
                    for label, schema, attributes in walk(value, column, spec):
                        at.append(i)
                        labels.append(label)
                        steps.append(schema)
                        own.append(attributes)
                if len(at) >= 20_000:
                    yield flush()
            yield flush()

    return run


def path(label: Column) -> Column:
    return F.array_join(label, "")


def parent(label: Column) -> Column:
    """The parent's label: the label truncated by one step; empty at the top."""
    return F.slice(label, F.lit(1), F.size(label) - 1)


def flatten(df: DataFrame, keys: list[str], spec: NestedSpec) -> DataFrame:
    """Every node of the records: keys, label, schema_steps, attributes (JSON of its own leaves)."""
    from pyspark.sql.pandas.types import to_arrow_type

    picked = df.select(*keys, *[F.col(c).alias(f"__c{n}") for n, c in enumerate(spec.columns)])
    types = [to_arrow_type(df.schema[k].dataType) for k in keys]
    schema = ", ".join([f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys] + [NODE])
    return picked.mapInArrow(_node_batches(keys, spec, types), schema)


def links(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, node_path, parent_path of every node, each once."""
    elements = nodes.where(F.element_at("label", -1).endswith("]"))  # the leaves above all nodes are none
    return elements.select(*keys, path(F.col("label")).alias("node_path"), path(parent(F.col("label"))).alias("parent_path")).distinct()


def tables(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """The flat tables in one long form: table_name (schema path), keys, node_path, parent_path, ordinal, attributes.

    `where table_name = ...` with from_json over attributes gives one table; write it partitioned by table_name
    to have them as files.
    """
    last = F.element_at("label", -1)
    return nodes.select(
        F.array_join("schema_steps", "").alias("table_name"),
        *keys,
        path(F.col("label")).alias("node_path"),
        path(parent(F.col("label"))).alias("parent_path"),
        F.regexp_extract(last, r"\[(\d+)\]$", 1).try_cast("int").alias("ordinal"),
        "attributes",
    ).dropDuplicates([*keys, "node_path"])


def table_columns(long: DataFrame) -> DataFrame:
    """(table_name, column_name, column_type, n_values) of the tables that tables() holds, from their rows' attributes.

    Whole numbers are bigint, numbers double, truth values boolean, all else (lists, mixtures) text. As many rows as
    the data's schema is wide.
    """
    each = F.explode(F.from_json("attributes", "map<string,variant>")).alias("column_name", "v")
    kinds = long.select("table_name", each).select("table_name", "column_name", F.schema_of_variant("v").alias("kind"))
    kinds = kinds.groupBy("table_name", "column_name").agg(
        F.collect_set(F.regexp_replace("kind", r"[(<].*", "")).alias("kinds"), F.count(F.when(F.col("kind") != "VOID", 1)).alias("n_values")
    )
    only = lambda *names: F.size(F.array_except("kinds", F.array(*[F.lit(n) for n in ("VOID", *names)]))) == 0
    kind = F.when(F.col("n_values") == 0, "string").when(only("BIGINT"), "bigint").when(only("BIGINT", "DOUBLE", "DECIMAL", "FLOAT"), "double").when(only("BOOLEAN"), "boolean").otherwise("string")
    return kinds.select("table_name", "column_name", kind.alias("column_type"), "n_values")


def typed_table(long: DataFrame, keys: list[str], name: str, columns: list[tuple[str, str]]) -> DataFrame:
    """One flat table of tables(): keys, node_path, parent_path (its row in the parent's table), ordinal, and the typed columns.

    A column named like a key or link gets an underscore before it.
    """
    fixed = [*keys, "node_path", "parent_path", "ordinal"]
    values = F.from_json("attributes", "map<string,variant>")
    rows = long.where(F.col("table_name") == name).select(*fixed, values.alias("__v"))
    made, taken = [], {f.lower() for f in fixed}
    for column, kind in columns:
        v = F.try_element_at("__v", F.lit(column))
        alias = column.lstrip(".")
        while alias.lower() in taken:
            alias = "_" + alias
        taken.add(alias.lower())
        made.append((F.try_variant_get(v, "$", kind) if kind != "string" else v.cast("string")).alias(alias))
    return rows.select(*fixed, *made)


def relational(long: DataFrame, keys: list[str]) -> dict[str, DataFrame]:
    """The related flat tables, one DataFrame per schema path, with typed columns; each links to its parent by parent_path."""
    columns: dict[str, list[tuple[str, str]]] = {}
    for r in table_columns(long).orderBy("table_name", "column_name").collect():
        columns.setdefault(r["table_name"], []).append((r["column_name"], r["column_type"]))
    return {name: typed_table(long, keys, name, own) for name, own in columns.items()}


def write_relational(long: DataFrame, keys: list[str], folder: str) -> list[str]:
    """Write the related tables as parquet, a folder per schema path; their names."""
    made = relational(long, keys)
    for name, df in made.items():
        df.write.mode("overwrite").parquet(f"{folder}/{re.sub(r'[^A-Za-z0-9_.]+', '_', name).strip('_')}")
    return sorted(made)


#: The columns of agent runs and what their JSON's keys mean.
AGENT_RUNS = NestedSpec(
    columns=("simulator_result.turns", "simulator_result.observations", "harness_result.transcript", "harness_result.artifacts"),
    list_keys=frozenset("messages content files pages tool_calls filters rows checks evidence changes hunks".split()),
    json_keys=frozenset(["arguments"]),
    scoped_list_keys={"lines": "].metadata"},
    json_fields=frozenset("request response user_request observation artifacts transcript metadata".split()),
)
