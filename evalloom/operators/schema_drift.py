"""Schemas that drift between files: edit scripts between schema trees, compiled into one projection per file.

1. Each file's value schema becomes a canonical tree (order, nullability, descriptions dropped).
2. Between consecutive files of a table, fields that only one side has are possible renames if they share
   parent and type; for those, and only those, record values are compared per key, pre-aggregated per file pair.
3. The constrained tree edit distance between the two trees, with costs for add, delete, retype and rename and
   a minimum-cost assignment among the children of each matched struct, gives the script. A rename is allowed
   where the values agree.
4. The scripts compose: each field of a file gets the name it has in the newest file, and the widest type it
   ever has; the composition is a projection applied to the file's records, which stay as rows throughout.

Comparison keys contain the record key, so a table that holds a third of all records spreads over all tasks.
Nulls: a file with neither schema readable is passed over, its neighbours are compared. Empty tables give
empty results. Repeated sidecars of a file count once, the one with a readable schema first.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

COST_ADD, COST_DROP, COST_RETYPE, COST_RENAME = 1.0, 1.0, 0.9, 1.0
#: Dearer than any drop and add.
FORBIDDEN = 1e9


# --- trees ------------------------------------------------------------------------------------------------


def _children(kind) -> dict | None:
    """The children of a struct, or of a list of structs; None for anything else."""
    while isinstance(kind, dict) and "list" in kind:
        kind = kind["list"]
    return kind["struct"] if isinstance(kind, dict) and "struct" in kind else None


def _kind(node):
    """Spark schema JSON without order, nullability and metadata."""
    if isinstance(node, str):
        return node
    name = node["type"]
    if name == "struct":
        return {"struct": {f["name"]: _kind(f["type"]) for f in sorted(node["fields"], key=lambda f: f["name"])}}
    if name == "array":
        return {"list": _kind(node["elementType"])}
    if name == "map":
        return {"map": [_kind(node["keyType"]), _kind(node["valueType"])]}
    if name == "udt":
        return _kind(node["sqlType"])
    return name


#: The fields by which a stored cell is known, a fixed layout.
CELL_FIELDS = {"cell_id", "value", "metadata", "marker"}


def _uncelled(kind):
    """The value's kind, where the kind is that of a cell."""
    if isinstance(kind, dict) and "struct" in kind and set(kind["struct"]) >= {"cell_id", "value", "metadata"}:
        return kind["struct"]["value"]
    return kind


def read_schema(text: str | None, cells: bool) -> dict | None:
    """The tree of a schema's JSON, or None if it is missing, unknown or unreadable."""
    try:
        node = json.loads(text) if text else None
        if not isinstance(node, dict) or node.get("type") != "struct":
            return None
        tree = _kind(node)
    except (ValueError, KeyError, TypeError, AttributeError, RecursionError):
        return None
    if cells:
        tree = {"struct": {k: _uncelled(v) for k, v in tree["struct"].items()}}
    return tree


def value_tree(wrapped: str | None, value: str | None) -> str | None:
    """Canonical JSON of a file's value tree; its value schema first, else its stored schema without cells."""
    tree = read_schema(value, False) or read_schema(wrapped, True)
    return json.dumps(tree, sort_keys=True) if tree else None


def _plain(kind) -> str:
    """What a change of type is judged by: the kind, where structs (also in lists) count by their fields' own changes."""
    if isinstance(kind, dict) and "list" in kind:
        return f"list<{_plain(kind['list'])}>"
    return "struct" if isinstance(kind, dict) and "struct" in kind else json.dumps(kind, sort_keys=True)


def rename_candidates(old: dict, new: dict, at: tuple = ()) -> Iterator[tuple[tuple, str, str]]:
    """(parent path, gone name, new name) of same-typed fields of which each is on one side only.

    Below a renamed pair nothing is compared, since both have the same children.
    """
    a, b = _children(old) or {}, _children(new) or {}
    gone, come = [k for k in a if k not in b], [k for k in b if k not in a]
    for g in gone:
        for c in come:
            if a[g] == b[c]:
                yield at, g, c
    for k in a:
        if k in b and _children(a[k]) is not None and _children(b[k]) is not None:
            yield from rename_candidates(a[k], b[k], (*at, k))


def assign(cost: list[list[float]]) -> list[int]:
    """Minimum-cost assignment of rows to columns (rows <= columns), by shortest augmenting paths."""
    n, m = len(cost), len(cost[0]) if cost else 0
    u, v, owner, way = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        least, used = [float("inf")] * (m + 1), [False] * (m + 1)
        while True:
            used[j0] = True
            i0, delta, j1 = owner[j0], float("inf"), 0
            for j in range(1, m + 1):
                if not used[j]:
                    now = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if now < least[j]:
                        least[j], way[j] = now, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(m + 1):
                if used[j]:
                    u[owner[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if owner[j0] == 0:
                break
        while j0:
            owner[j0] = owner[way[j0]]
            j0 = way[j0]
    out = [0] * n
    for j in range(1, m + 1):
        if owner[j]:
            out[owner[j] - 1] = j - 1
    return out


def name_distance(a: str, b: str) -> float:
    """Edit distance of two names, letter case aside, as a share of the longer."""
    a, b = a.lower(), b.lower()
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1] / max(len(a), len(b), 1)


def edit_script(old: dict, new: dict, support: dict[tuple, tuple[int, int]], at: tuple = ()) -> tuple[float, list[tuple]]:
    """(cost, [(change_kind, old path, new path)]) that turns old into new at least cost.

    support: (parent path, gone, new) -> (keys with both values, keys whose values differ); a pair is a rename
    if none differs. Same names always match; the rest is assigned at minimum cost, where a rename costs little
    more than nothing against drop plus add, less so the more keys agree and the closer the names are.
    """
    a, b = _children(old) or {}, _children(new) or {}
    total, script = 0.0, []
    for k in a:
        if k not in b:
            continue
        if _plain(a[k]) != _plain(b[k]):
            total += COST_RETYPE
            script.append(("retyped", (*at, k), (*at, k)))
        elif _children(a[k]) is not None:
            cost, below = edit_script(a[k], b[k], support, (*at, k))
            total += cost
            script += below
    gone, come = [k for k in a if k not in b], [k for k in b if k not in a]
    n, m = len(gone), len(come)
    if n + m:
        # Square matrix with n + m rows: a gone field takes a new one or its own drop, a new one its own add.
        cost = [[FORBIDDEN] * (n + m) for _ in range(n + m)]
        for i, g in enumerate(gone):
            for j, c in enumerate(come):
                both, differ = support.get((at, g, c), (0, 1))
                if a[g] == b[c] and not differ:
                    cost[i][j] = COST_RENAME + 0.4 * name_distance(g, c) + (0.3 / (1 + both))
            cost[i][m + i] = COST_DROP
        for j in range(m):
            cost[n + j][j] = COST_ADD
            for i in range(n):
                cost[n + j][m + i] = 0.0
        chosen = assign(cost)
        for i, g in enumerate(gone):
            j = chosen[i]
            total += cost[i][j]
            script.append(("renamed", (*at, g), (*at, come[j])) if j < m else ("removed", (*at, g), ()))
        for j, c in enumerate(come):
            if chosen[n + j] == j:
                total += COST_ADD
                script.append(("added", (), (*at, c)))
    return total, script


# --- Spark ------------------------------------------------------------------------------------------------


def file_schemas(sidecars: DataFrame) -> DataFrame:
    """(stage_table, file_no, tree, prev_no, prev_tree): each file with a readable schema and the one before it."""
    tree = F.pandas_udf(lambda w, v: pd.Series([value_tree(x, y) for x, y in zip(w, v)], dtype="object"), "string")
    # Two columns are read: equal pairs of schemas parse once. A sidecar without table or number describes no file.
    pairs = sidecars.where(F.col("stage_table").isNotNull() & F.col("file_no").isNotNull()).groupBy("stage_table", "file_no", "wrapped_schema", "value_schema").agg(F.max("sidecar_id").alias("sidecar_id"))
    files = pairs.select("stage_table", "file_no", "sidecar_id", tree("wrapped_schema", "value_schema").alias("tree"))
    files = files.where(F.col("tree").isNotNull()).groupBy("stage_table", "file_no").agg(F.max_by("tree", "sidecar_id").alias("tree"))
    w = Window.partitionBy("stage_table").orderBy("file_no")
    return files.select(
        "stage_table", "file_no", "tree", F.lag("file_no").over(w).alias("prev_no"), F.lag("tree").over(w).alias("prev_tree")
    )


_CANDIDATE = "array<struct<pair:string,old_path:array<string>,new_path:array<string>>>"


def _paths(tree, at: tuple = ()) -> Iterator[tuple[tuple, str]]:
    for k, v in (_children(tree) or {}).items():
        yield (*at, k), json.dumps(v, sort_keys=True)
        yield from _paths(v, (*at, k))


def move_candidates(old: dict, new: dict) -> list[tuple[tuple, tuple]]:
    """(old path, new path) of the fields that may have gone from one parent to another."""
    a, b = dict(_paths(old)), dict(_paths(new))
    gone = [("removed", p, (), kind) for p, kind in a.items() if p not in b]
    return moves(gone + [("added", (), p, kind) for p, kind in b.items() if p not in a])


def _move_key(a: tuple, b: tuple) -> str:
    return json.dumps(["move", list(a), list(b)])


def _candidates(prev: pd.Series, tree: pd.Series) -> pd.Series:
    out = []
    for p, t in zip(prev, tree):
        rows = []
        if p is not None and t is not None and p != t:
            for at, g, c in rename_candidates(json.loads(p), json.loads(t)):
                rows.append({"pair": json.dumps([list(at), g, c]), "old_path": [*at, g], "new_path": [*at, c]})
            for a, b in move_candidates(json.loads(p), json.loads(t)):
                rows.append({"pair": _move_key(a, b), "old_path": list(a), "new_path": list(b)})
        out.append(rows)
    return pd.Series(out, dtype="object")


def _dig(value, path):
    """The value below a path as canonical JSON; None if null or absent."""
    for step in path:
        if isinstance(value, list):
            value = [v.get(step) if isinstance(v, dict) else None for v in value]
        else:
            value = value.get(step) if isinstance(value, dict) else None
    return None if value is None else json.dumps(value, sort_keys=True)


def _compare_values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Record rows with the paths wanted of them -> (stage_table, change_no, pair, case_id, side, value)."""
    names = ["stage_table", "change_no", "pair", "case_id", "is_new", "value"]
    for batch in batches:
        rows = []
        for table, case, text, wanted in zip(batch.stage_table, batch.case_id, batch.record_json, batch.wanted):
            try:
                record = json.loads(text)
            except (ValueError, RecursionError):
                continue
            for w in wanted:
                value = _dig(record, w["path"])
                if value is not None:
                    rows.append((table, w["change_no"], w["pair"], case, w["is_new"], value))
        yield pd.DataFrame(rows, columns=names)


def rename_support(files: DataFrame, records: DataFrame) -> DataFrame:
    """(stage_table, change_no, pair, n_both, n_differ) of every possible rename."""
    find = F.pandas_udf(_candidates, _CANDIDATE)
    pairs = files.where(F.col("prev_tree").isNotNull() & (F.col("prev_tree") != F.col("tree"))).select(
        "stage_table", "file_no", "prev_no", F.explode(find("prev_tree", "tree")).alias("c")
    )
    side = lambda no, path, new: F.struct(
        F.col(no).alias("no"), F.col("file_no").alias("change_no"), F.col("c.pair").alias("pair"), F.col(path).alias("path"), F.lit(new).alias("is_new")
    )
    wanted = pairs.select("stage_table", F.explode(F.array(side("prev_no", "c.old_path", False), side("file_no", "c.new_path", True))).alias("s"))
    # One row per file: as long as the file's schema is wide, whatever its number of records.
    wanted = wanted.groupBy("stage_table", F.col("s.no").alias("file_no")).agg(
        F.collect_list(F.struct("s.change_no", "s.pair", "s.path", "s.is_new")).alias("wanted")
    )
    found = (
        records.select("stage_table", "file_no", "case_id", "record_json")
        .join(wanted, ["stage_table", "file_no"])
        .select("stage_table", "case_id", "record_json", "wanted")
        .mapInPandas(_compare_values, "stage_table string, change_no int, pair string, case_id string, is_new boolean, value string")
    )
    old, new = ~F.col("is_new"), F.col("is_new")
    per_case = found.groupBy("stage_table", "change_no", "pair", "case_id").agg(
        F.min(F.when(old, F.col("value"))).alias("a"), F.max(F.when(old, F.col("value"))).alias("z"),
        F.min(F.when(new, F.col("value"))).alias("b"), F.max(F.when(new, F.col("value"))).alias("y"),
    )
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    same = (F.col("a") == F.col("b")) & (F.col("z") == F.col("y"))
    return per_case.groupBy("stage_table", "change_no", "pair").agg(
        F.count(F.when(both, 1)).alias("n_both"), F.count(F.when(both & ~same, 1)).alias("n_differ")
    )


_SCRIPT = "array<struct<change_kind:string,old_path:array<string>,new_path:array<string>>>"


def _scripts(prev: pd.Series, tree: pd.Series, support: pd.Series) -> pd.Series:
    out = []
    for p, t, rows in zip(prev, tree, support):
        if p is None or t is None or p == t:
            out.append([])
            continue
        old, new = json.loads(p), json.loads(t)
        # A pair without any comparable record has nothing against it.
        known = {(at, g, c): (0, 0) for at, g, c in rename_candidates(old, new)}
        agreed = set()
        for r in rows if rows is not None else []:
            at, g, c = json.loads(r["pair"])
            if at == "move":
                agreed |= {(tuple(g), tuple(c))} if r["n_both"] and not r["n_differ"] else set()
            else:
                known[tuple(at), g, c] = (r["n_both"], r["n_differ"])
        script = edit_script(old, new, known)[1]
        # Unlike a renamed field, a moved one needs records that show it: names recur below many parents.
        script = script + [("moved", a, b) for a, b in moves(_with_types(old, new, script)) if (a, b) in agreed]
        out.append([{"change_kind": k, "old_path": list(a), "new_path": list(b)} for k, a, b in script])
    return pd.Series(out, dtype="object")


def drift_scripts(sidecars: DataFrame, records: DataFrame) -> DataFrame:
    """(stage_table, file_no, tree, script) for every file, the script against the file before.

    A move is in the script twice: as the removal and the addition that it is between two structs, and as `moved`.
    """
    files = file_schemas(sidecars)
    support = (
        rename_support(files, records)
        .groupBy("stage_table", F.col("change_no").alias("file_no"))
        .agg(F.collect_list(F.struct("pair", "n_both", "n_differ")).alias("support"))
    )
    make = F.pandas_udf(_scripts, _SCRIPT)
    return files.join(support, ["stage_table", "file_no"], "left").select(
        "stage_table", "file_no", "tree", make("prev_tree", "tree", "support").alias("script")
    )


def field_changes(sidecars: DataFrame, records: DataFrame) -> DataFrame:
    """(stage_table, file_no, change_kind, old_field, new_field), each once."""
    dotted = lambda c: F.array_join(c, ".")
    return (
        drift_scripts(sidecars, records)
        .select("stage_table", "file_no", F.explode("script").alias("s"))
        .where(F.col("s.change_kind") != "moved")
        .select("stage_table", "file_no", "s.change_kind", dotted("s.old_path").alias("old_field"), dotted("s.new_path").alias("new_field"))
        .distinct()
    )


def moves(script: list[tuple]) -> list[tuple[tuple, tuple]]:
    """(old path, new path) of the fields that a script removes below one parent and adds, with their name and type, below another.

    script: (kind, old path, new path, type). A move costs one edit where a removal and an addition cost two; fields
    that could go to or come from several places are left as they are.
    """
    gone: dict[tuple, list[tuple]] = {}
    came: dict[tuple, list[tuple]] = {}
    for kind, old, new, field_type in script:
        if kind == "removed":
            gone.setdefault((old[-1], field_type), []).append(tuple(old))
        elif kind == "added":
            came.setdefault((new[-1], field_type), []).append(tuple(new))
    return [(gone[k][0], came[k][0]) for k in gone if len(gone[k]) == 1 and len(came.get(k, ())) == 1 and gone[k][0][:-1] != came[k][0][:-1]]


def _type_at(tree, path) -> str:
    """The type below a path of a schema tree, as text; lists of structs are gone through."""
    for step in path:
        tree = (_children(tree) or {}).get(step)
    return json.dumps(tree, sort_keys=True)


def _with_types(prev, tree, script) -> list[tuple]:
    """A script with the types of the fields it removes (in the old tree) and adds (in the new one)."""
    return [(k, tuple(a), tuple(b), _type_at(prev, a) if k == "removed" else _type_at(tree, b) if k == "added" else "") for k, a, b in script]


def changes_with_moves(sidecars: DataFrame, records: DataFrame) -> DataFrame:
    """field_changes(), but the removal and the addition of a moved field as one `moved`."""
    moved = F.filter("script", lambda s: s["change_kind"] == "moved")
    gone, came = F.transform(moved, lambda s: s["old_path"]), F.transform(moved, lambda s: s["new_path"])
    part = lambda s: (s["change_kind"] == "removed") & F.array_contains(gone, s["old_path"]) | (s["change_kind"] == "added") & F.array_contains(came, s["new_path"])
    each = F.explode(F.filter("script", lambda s: ~part(s))).alias("s")
    dotted = lambda c: F.array_join(c, ".")
    rows = drift_scripts(sidecars, records).select("stage_table", "file_no", each)
    return rows.select("stage_table", "file_no", "s.change_kind", dotted("s.old_path").alias("old_field"), dotted("s.new_path").alias("new_field")).distinct()


# --- one consistent table ---------------------------------------------------------------------------------

#: Types from narrow to wide; any other mix of types is text.
WIDENING = ["byte", "short", "integer", "long", "float", "double"]


def _wider(a: str, b: str) -> str:
    if a == b:
        return a
    if a in WIDENING and b in WIDENING:
        return max(a, b, key=WIDENING.index)
    return "string"


#: Step of a path from a list to the fields of its elements.
ELEMENT = None


def _leaves(tree, at=(), within=None) -> Iterator[tuple[tuple, str, tuple | None]]:
    """(path, type, path of the list of structs around it) of every column; lists of structs come before their fields."""
    for k, v in (_children(tree) or {}).items():
        if isinstance(v, dict) and "struct" in v:
            yield from _leaves(v, (*at, k), within)
        elif _children(v) is not None:
            yield (*at, k), _plain(v), within
            yield from _leaves(v, (*at, k, ELEMENT), (*at, k))
        else:
            yield (*at, k), v if isinstance(v, str) else json.dumps(v, sort_keys=True), within


def _renamed(path: tuple, renames: dict[tuple, tuple]) -> tuple:
    """The path after the longest rename that it begins with; a rename changes the last step."""
    for cut in range(len(path), 0, -1):
        new = renames.get(tuple(p for p in path[:cut] if p is not ELEMENT)) if path[cut - 1] is not ELEMENT else None
        if new:
            return (*path[: cut - 1], new[-1], *path[cut:])
    return path


def compile_projections(files: list[tuple[int, dict, list[tuple]]]) -> dict[int, list[tuple]]:
    """Per file_no the projection [(path in the file, name in the consistent table, type there, columns of elements)].

    Every projection lists all columns of the table, with no path where the file lacks the field. A field lives
    from its addition to its removal, through all renames; its column has its newest name, with `_<file_no>` of
    its first file where another field took that name later. A list of structs is one column, whose elements have
    columns of their own by the same rules.
    """
    lives: list[dict] = []
    alive: dict[tuple, dict] = {}
    held: dict[int, dict[int, list[str]]] = {}
    for no, tree, script in files:
        renames = {tuple(a): tuple(b) for k, a, b in script if k == "renamed"}
        moved = {tuple(a): tuple(b) for k, a, b in script if k == "moved"}
        bare = lambda path: tuple(p for p in path if p is not ELEMENT)
        now = {_renamed(path, renames): life for path, life in alive.items()}
        # A moved field takes its column along, unless it goes into or out of a list, whose elements have their own columns.
        places = {bare(path): path for path, _, within in _leaves(tree) if within is None}
        for path, life in alive.items():
            target = next((b + bare(path)[len(a) :] for a, b in moved.items() if bare(path)[: len(a)] == a), None)
            if target in places and life["within"] is None:
                now[places[target]] = life
        alive, held[no] = {}, {}
        for path, kind, within in _leaves(tree):
            around = alive[within] if within else None
            life = now.get(path)
            if life is None:
                life = {"first": no, "type": kind, "no": len(lives), "within": around and around["no"]}
                lives.append(life)
            life["type"], life["path"] = _wider(life["type"], kind), list(path[len(within) + 1 if within else 0 :])
            alive[path] = life
            held[no][life["no"]] = life["path"]
    names: set[tuple] = set()
    for life in reversed(lives):
        name = ".".join(life["path"])
        while (life["within"], name) in names:
            name = f"{name}_{life['first']}"
        names.add((life["within"], name))
        life["name"] = name
    below: dict[int | None, list[dict]] = {}
    for life in lives:
        below.setdefault(life["within"], []).append(life)

    def columns(within: int | None, paths: dict[int, list[str]]) -> list[tuple]:
        out = []
        for life in below.get(within, []):
            listed = life["type"].startswith("list<") and life["no"] in paths
            out.append((paths.get(life["no"]), life["name"], life["type"], columns(life["no"], paths) if listed else None))
        return out

    return {no: columns(None, paths) for no, paths in held.items()}


def _projection_rows(key, pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("file_no")
    files = [
        (int(no), json.loads(tree), [(s["change_kind"], s["old_path"], s["new_path"]) for s in script])
        for no, tree, script in zip(pdf.file_no, pdf.tree, pdf.script)
    ]
    done = compile_projections(files)
    return pd.DataFrame([(key[0], no, json.dumps(p)) for no, p in done.items()], columns=["stage_table", "file_no", "projection"])


def projections(sidecars: DataFrame, records: DataFrame) -> DataFrame:
    """(stage_table, file_no, projection as JSON); grouped per table over its files' schemas, never over records."""
    return drift_scripts(sidecars, records).groupBy("stage_table").applyInPandas(
        _projection_rows, "stage_table string, file_no int, projection string"
    )


def _row(record, columns: list) -> dict:
    row = {}
    for path, name, kind, elements in columns:
        value = record if path is not None else None
        for step in path or ():
            value = value.get(step) if isinstance(value, dict) else None
        if elements is not None:
            value = _elements(value, elements)
        elif value is not None and kind == "string" and not isinstance(value, str):
            value = json.dumps(value, ensure_ascii=False)
        row[name] = float(value) if kind == "double" and isinstance(value, int) and not isinstance(value, bool) else value
    return row


def _elements(value, columns: list):
    """A list of records, however deep, with each record in the given columns; nulls stay."""
    if isinstance(value, list):
        return [_elements(v, columns) for v in value]
    return _row(value, columns) if isinstance(value, dict) else value


def _project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        compiled: dict[str, list] = {}
        out = []
        for text, projection in zip(batch.record_json, batch.projection):
            try:
                record = json.loads(text)
            except (ValueError, TypeError, RecursionError):
                out.append(None)
                continue
            if projection is not None:
                record = _row(record, compiled.get(projection) or compiled.setdefault(projection, json.loads(projection)))
            out.append(json.dumps(record, ensure_ascii=False, sort_keys=True))
        yield batch.assign(record=out)[["record_id", "stage_table", "file_no", "line_no", "case_id", "record"]]


def consistent_table(sidecars: DataFrame, records: DataFrame) -> DataFrame:
    """All records of all files in the consistent schema of their table; every field of it in every row.

    record is JSON with the consistent names; null where a record isn't JSON. A file without a readable schema is
    read by that of the nearest file before it, else after it; records of a table without any come out as they are.
    """
    records = records.select("record_id", "stage_table", "file_no", "line_no", "case_id", "record_json")
    known = projections(sidecars, records)
    # One row per file: as many as the table has files, without their records.
    files = records.select("stage_table", "file_no").distinct().join(known, ["stage_table", "file_no"], "full")
    w = Window.partitionBy("stage_table").orderBy("file_no")
    near = [F.last("projection", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first("projection", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))]
    files = files.select("stage_table", "file_no", F.coalesce(*near).alias("projection"))
    joined = records.join(files, ["stage_table", "file_no"], "left")
    return joined.select("record_id", "stage_table", "file_no", "line_no", "case_id", "record_json", "projection").mapInPandas(
        _project, "record_id bigint, stage_table string, file_no int, line_no int, case_id string, record string"
    )
