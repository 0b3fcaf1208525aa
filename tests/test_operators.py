"""The general data problems against brute force and odd input."""

import datetime as dt
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from evalloom.operators import nested, quarantine, schema_drift, strict_json
from evalloom.operators.strict_json import is_object

RUN = "run_id string, simulator_result struct<turns:array<struct<turn:int,request:string,response:string,user_request:string>>,observations:array<struct<observation:string,artifacts:array<string>>>>, harness_result struct<transcript:array<string>,artifacts:array<struct<name:string,metadata:string>>>"


def found(spark, runs):
    df = spark.createDataFrame(runs, RUN)
    return {(r.run_id, r.node_path, r.parent_path) for r in nested.links(nested.flatten(df, ["run_id"], nested.AGENT_RUNS), ["run_id"]).collect()}


def test_nested_paths(spark):
    request = json.dumps({"messages": {"content": [{"kind": "t"}, None, "text", {"files": {"pages": []}}]}})
    call = json.dumps({"tool_calls": [{"arguments": json.dumps({"filters": [{"f": 1}]})}], "lines": {"no": 1}, "content": "plain"})
    run = ("r", ([(0, request, json.dumps(call), None), None], [('{"checks": []}', ['{"files": null}', None, "x"])]), (["null", "not json", '[{"a": 1}]'], [("n", '{"lines": {"no": 3}}')]))
    t, p = "simulator_result.turns[0]", "simulator_result.turns[0].request.messages[0]"
    assert found(spark, [run, run]) == {
        ("r", t, ""), ("r", p, t), ("r", f"{p}.content[0]", p), ("r", f"{p}.content[3]", p), ("r", f"{p}.content[3].files[0]", f"{p}.content[3]"),
        ("r", f"{t}.response.tool_calls[0]", t), ("r", f"{t}.response.tool_calls[0].arguments.filters[0]", f"{t}.response.tool_calls[0]"),
        ("r", "simulator_result.observations[0]", ""), ("r", "simulator_result.observations[0].artifacts[0]", "simulator_result.observations[0]"),
        ("r", "harness_result.transcript[2][0]", ""), ("r", "harness_result.artifacts[0]", ""), ("r", "harness_result.artifacts[0].metadata.lines[0]", "harness_result.artifacts[0]"),
    }


def test_nested_nulls_and_depth(spark):
    deep = "[" * 60 + '{"a": 1}' + "]" * 60
    assert found(spark, [("a", None, None), (None, (None, []), (None, None))]) == set()
    assert found(spark, [("d", None, ([deep], None))]) == {("d", "harness_result.transcript[0]" + "[0]" * 60, "")}
    assert found(spark, []) == set()


def test_flat_tables_link_by_truncation(spark):
    df = spark.createDataFrame([("r", None, (['{"content": [{"files": [{"n": 1}]}]}'], None))], RUN)
    rows = {r.table_name: r for r in nested.tables(nested.flatten(df, ["run_id"], nested.AGENT_RUNS), ["run_id"]).collect()}
    assert rows["harness_result.transcript*.content*.files*"].parent_path == rows["harness_result.transcript*.content*"].node_path
    assert json.loads(rows["harness_result.transcript*.content*.files*"].attributes) == {"n": 1}


def leaves_of(value, key, path, json_fields=nested.AGENT_RUNS.json_fields):
    """(path, leaf) of everything in a value, by plain recursion; a bare object under a list's key is element 0."""
    spec = nested.AGENT_RUNS
    if isinstance(value, str) and (key in json_fields or key in spec.json_keys):
        value = nested._decode(value)
        json_fields = frozenset()
    if isinstance(value, dict) and key in spec.list_keys and not path.endswith("]"):
        value = [value]
    if isinstance(value, dict) and value:
        return [x for k, v in value.items() for x in leaves_of(v, k, f"{path}.{k}", json_fields)]
    if isinstance(value, list) and value:
        return [x for i, v in enumerate(value) for x in leaves_of(v, key, f"{path}[{i}]", json_fields)]
    return [] if value == {} and path.endswith("]") else [(path, repr(value))]


def test_every_leaf_is_in_one_flat_row(spark):
    request = {"messages": [{"role": "u", "content": "plain"}, {"content": [{"kind": "t"}, None, "text", ["a", {"deep": 1}]]}], "tags": ["vip", None], "meta": {"x": {"y": 2, "none": {}}, "x.y": 3}, "half": "\ud83d"}
    calls = [{"arguments": {"limit": 7, "filters": [], "note": None}}, {"arguments": json.dumps({"limit": 8})}, {"arguments": "free text"}]
    turn = (1, json.dumps(request), "plain answer", json.dumps({"tool_calls": calls, "content": "NaN", "big": 1e300}))
    run = ("r", ([turn, None], [('{"n": 1}', ["[1, 2]", None, "x"])]), (["not json", '{"error": {"code": "e", "retryable": false}}', "null"], [("n", "5"), ("m", "[1e999, NaN]")]))
    rows = nested.tables(nested.flatten(spark.createDataFrame([run, run], RUN), ["run_id"], nested.AGENT_RUNS), ["run_id"]).collect()
    kept = []
    for r in rows:
        at = r.node_path if r.ordinal is not None else r.node_path.rpartition(".")[0]
        for name, value in json.loads(r.attributes, parse_constant=lambda c: pytest.fail(c)).items():
            name = f"{at}.{name}".replace("`", "")
            kept += [(f"{name}[{i}]", repr(v)) for i, v in enumerate(value)] if isinstance(value, list) and value else [(name, repr(value))]
    plain = spark.createDataFrame([run], RUN).first().asDict(True)
    want = [x for c in nested.AGENT_RUNS.columns for x in leaves_of(plain[c.split(".")[0]][c.split(".")[1]], c.split(".")[1], c)]
    want.remove(("simulator_result.turns[1]", "None"))  # nothing but a null above the nodes of its column
    assert sorted(kept) == sorted(want)
    by_path = {r.node_path: r for r in rows}
    top = by_path["harness_result.transcript"]
    assert (top.table_name, top.parent_path, top.ordinal, json.loads(top.attributes)) == ("harness_result.transcript", "", None, {"transcript[0]": "not json", "transcript[2]": None})
    own = json.loads(by_path["simulator_result.turns[0]"].attributes)
    assert own["request.tags"] == ["vip", None] and own["request.meta.x.y"] == 2 and own["request.meta.`x.y`"] == 3
    assert {path for _, path, _ in found(spark, [run])} == {p for p, r in by_path.items() if r.ordinal is not None}


@pytest.mark.parametrize(
    "text, good",
    [
        ("{}", True), (' {"a":[1,-0.5e3,"\\u00e4"]}\n', True), ("[]", False), ("", False), ("{'a':1}", False), ('{"a":01}', False), ('{"a":NaN}', False), ('{"a":1,}', False),
        ('{"a":"\t"}', False), ("{}{}", False), ('{"a":' + "9" * 6000 + "}", True), ('{"a":' + "[" * 50_000 + "]" * 50_000 + "}", True), ('{"a":' + "[" * 50_000 + "}", False), ('"{}"', False),
        ('{"a":"\\x"}', False), ("\ufeff{}", False),
    ],
)
def test_strict_json(text, good):
    assert is_object(text) is good


@pytest.mark.parametrize(
    "text, good",
    [("1", True), (" -.5 ", True), ("1.", True), ("+2E-3", True), ("1e999", False), ("\t1", False), ("1_0", False), ("NaN", False), ("٣", False), ("1 2", False), (".", False), ("1e", False), ("0x1", False)],
)
def test_numbers(text, good):
    assert quarantine.good_number(text) is good


@pytest.mark.parametrize(
    "line, fields, reason",
    [
        ("a,b", ["a", "b"], None), ('"a,b",c', ["a,b", "c"], None), ('"a""b",', ['a"b', ""], None), ('"open,c', None, "broken_quoting"), ('"a"x,c', None, "broken_quoting"),
        ('a"b,c', None, "broken_quoting"), ('"two\nlines",c', ["two\nlines", "c"], None), ("", [""], None), (",", ["", ""], None),
    ],
)
def test_records(line, fields, reason):
    assert quarantine.split_record(line, ",") == (fields, reason)


def test_quarantine_matches_single_records(spark):
    header = "row_id,score_text,payload_text,note"
    good = ['1,0.5,"{""a"": 1}",x', "2,,,", '"3", 1e3 ,"{}","a\nb"']
    bad = [('4,"x,y', "broken_quoting"), ("5,1", "column_count"), ("6,abc,,", "bad_score"), ('7,1,"{",n', "bad_payload"), ('8,1,{""},"', "broken_quoting"), ('9,x,"[1]",n', "bad_score")]
    lines = [(1, "f", 1, "scores", header)] + [(i, "f", i, "scores", t) for i, t in enumerate(good * 700 + [b for b, _ in bad], 2)]
    lines += [(9001, "f", 9001, "scores", ""), (9002, "f", 9002, "scores", None), (9003, "g", 2, "scores", "1,2"), (9004, "g", 1, "scores", "a,b")]
    df = spark.createDataFrame(lines, "line_id bigint, file_name string, line_no int, dataset string, raw_line string")
    scores = spark.createDataFrame([(1, "x", None), (1, "x", None), (2, " ", "{}"), (None, "1", "["), (3, None, " ")], "row_id bigint, score_text string, payload_text string")
    cases = spark.createDataFrame([("a", "{}"), ("b", "1"), ("c", None)], "case_id string, payload_json string")
    rows = {tuple(r) for r in quarantine.bad_rows(df, scores, cases).collect()}
    first_bad = 2 + len(good) * 700
    want = {("raw_lines", str(first_bad + i), why) for i, (_, why) in enumerate(bad)}
    assert rows == want | {("scores", "1", "bad_score"), ("scores", None, "bad_payload"), ("metadata_cases", "b", "bad_payload")}
    assert quarantine.load_lines(df).count() == len(good) * 700 + 1


def test_valid_rows_of_all_tables_are_loaded(spark):
    lines = [(1, "f", 1, "scores", "row_id;score_text"), (2, "f", 2, "scores", "5;0.5"), (3, "f", 3, "scores", "6;x")]
    score = "row_id bigint, score_text string, payload_text string, note string, arrived_at timestamp_ntz"
    early, late = datetime(2026, 1, 1, 0, 0, 0, 123456), datetime(2026, 2, 1)
    scores = [(1, "1", "{}", None, late), (1, "1", "{}", None, early), (2, None, " ", "n", early), (3, "x", "{}", "n", early), (4, "1", "[]", "n", early), (None, "2", None, "n", early)]
    cases = [("a", "not judged", '{"k": [1]}', early), ("a", "not judged", '{"k": [1]}', late), ("b", "1", "{", early), ("c", None, None, None)]
    tables = (
        spark.createDataFrame(lines, "line_id bigint, file_name string, line_no int, dataset string, raw_line string"),
        spark.createDataFrame(scores, score),
        spark.createDataFrame(cases, "case_id string, score_text string, payload_json string, arrived_at timestamp_ntz"),
    )
    rows = [(r.source_table, r.row_key, r.file_name, json.loads(r.fields)) for r in quarantine.load_all(*tables).collect()]
    first = "2026-01-01T00:00:00.123456"
    value = lambda *v: dict(zip(("row_id", "score_text", "payload_text", "note", "arrived_at"), v))
    case = lambda *v: dict(zip(("case_id", "score_text", "payload_json", "arrived_at"), v))
    want = [
        ("raw_lines", "2", "f", {"row_id": "5", "score_text": "0.5"}),
        ("scores", "1", None, value(1, "1", "{}", None, first)), ("scores", "2", None, value(2, None, " ", "n", first)), ("scores", None, None, value(None, "2", None, "n", first)),
        ("metadata_cases", "a", None, case("a", "not judged", '{"k": [1]}', first)), ("metadata_cases", "c", None, case("c", None, None, None)),
    ]
    assert sorted(rows, key=str) == sorted(want, key=str)
    bad = {tuple(r)[:2] for r in quarantine.bad_rows(*tables).collect()}
    assert bad == {("raw_lines", "3"), ("scores", "3"), ("scores", "4"), ("metadata_cases", "b")}


def schema(fields):
    kind = lambda k: schema(k) if isinstance(k, dict) else {"type": "array", "elementType": k[1:-1], "containsNull": True} if k.startswith("[") else k
    return {"type": "struct", "fields": [{"name": n, "type": kind(k), "nullable": True, "metadata": {}} for n, k in fields.items()]}


def celled(fields):
    out = schema(fields)
    for f in out["fields"]:
        inner = [{"name": "cell_id", "type": "string"}, {"name": "value", "type": f["type"]}, {"name": "metadata", "type": "string"}, {"name": "marker", "type": "boolean"}]
        f["type"] = {"type": "struct", "fields": inner}
    return json.dumps(out)


SIDE = "sidecar_id bigint, stage_table string, file_no int, wrapped_schema string, value_schema string"
RECORD = "record_id bigint, stage_table string, file_no int, line_no int, case_id string, record_json string"


def test_drift(spark):
    files = [
        {"id": "string", "a": "integer", "b": "string", "s": {"x": "integer", "y": "string"}, "gone": "string"},
        {"id": "string", "a": "long", "B": "string", "s": {"x2": "integer", "y": "string"}, "fresh": "string"},
        {"id": "string", "a": "long", "B": "[string]", "t": {"x2": "integer", "y": "string"}, "fresh": "string", "more": "date"},
    ]
    sides = [(1, "t", 1, None, json.dumps(schema(files[0]))), (2, "t", 2, celled(files[1]), "broken"), (3, "t", 3, json.dumps({"type": "unknown"}), json.dumps(schema(files[2]))), (4, "t", 3, None, None)]
    records = [
        (1, "t", 1, 1, "c1", json.dumps({"a": 1, "b": "u", "s": {"x": 5, "y": "q"}, "gone": "v"})), (2, "t", 2, 1, "c1", json.dumps({"a": 1, "B": "u", "s": {"x2": 5}, "fresh": "w"})),
        (3, "t", 3, 1, "c1", json.dumps({"B": ["u"], "t": {"x2": 5}, "fresh": None})), (4, "t", 3, 2, "c9", "not json"),
    ]
    s, r = spark.createDataFrame(sides, SIDE), spark.createDataFrame(records, RECORD)
    assert {tuple(x)[1:] for x in schema_drift.field_changes(s, r).collect()} == {
        (2, "retyped", "a", "a"), (2, "renamed", "b", "B"), (2, "renamed", "s.x", "s.x2"), (2, "removed", "gone", ""), (2, "added", "", "fresh"),
        (3, "retyped", "B", "B"), (3, "renamed", "s", "t"), (3, "added", "", "more"),
    }
    table = {x.record_id: x.record and json.loads(x.record) for x in schema_drift.consistent_table(s, r).collect()}
    assert table[1]["B"] == "u" and table[1]["t.x2"] == 5 and table[1]["gone"] == "v" and table[3]["t.x2"] == 5 and table[4] is None


def test_drift_with_nulls_and_clashing_names(spark):
    text = json.dumps(schema({"a": "string"}))
    s = spark.createDataFrame([(1, "t", 1, None, text, "x"), (2, None, 1, None, text, "x"), (3, "t", None, None, text, "x")], SIDE + ", projection string")
    r = spark.createDataFrame([(1, "t", 1, None, None, '{"a": "b"}', "x"), (2, None, None, 1, "c", None, "x")], RECORD + ", projection string")
    assert schema_drift.field_changes(s, r).collect() == []
    assert {(x.record_id, x.record) for x in schema_drift.consistent_table(s, r).collect()} == {(1, '{"a": "b"}'), (2, None)}


def test_every_column_is_in_every_row_also_of_elements(spark):
    listed = lambda name, **fields: {"name": name, "type": {"type": "array", "elementType": schema(fields), "containsNull": True}, "nullable": True, "metadata": {}}
    files = [schema({"a": "string", "gone": "string"}), schema({"a": "string", "fresh": "double"}), schema({"a": "string", "fresh": "double"})]
    files[0]["fields"].append(listed("items", price="integer", s={"x": "string"}, code="integer"))
    files[1]["fields"].append(listed("items", cost="integer", s={"y": "string"}, code="string"))
    files[2]["fields"].append(listed("items", cost="integer", s={"y": "string"}, code="string", more="date"))
    s = spark.createDataFrame([(n, "t", n, None, json.dumps(f)) for n, f in enumerate(files, 1)], SIDE)
    records = [
        {"a": "u", "gone": "v", "items": [{"price": 1, "s": {"x": "p"}, "code": 7}, None]},
        {"a": "u", "fresh": 2, "items": [{"cost": 1, "s": {"y": "p"}, "code": "8"}, None]},
        {"a": "u", "items": []},
    ]
    r = spark.createDataFrame([(n, "t", n, 1, "c", json.dumps(x)) for n, x in enumerate(records, 1)], RECORD)
    assert (2, "renamed", "items.price", "items.cost") in {tuple(x)[1:] for x in schema_drift.field_changes(s, r).collect()}
    table = {x.record_id: json.loads(x.record) for x in schema_drift.consistent_table(s, r).collect()}
    assert table == {
        1: {"a": "u", "gone": "v", "fresh": None, "items": [{"cost": 1, "s.y": "p", "code": "7", "more": None}, None]},
        2: {"a": "u", "gone": None, "fresh": 2.0, "items": [{"cost": 1, "s.y": "p", "code": "8", "more": None}, None]},
        3: {"a": "u", "gone": None, "fresh": None, "items": []},
    }


def test_drift_of_nothing(spark):
    assert schema_drift.field_changes(spark.createDataFrame([], SIDE), spark.createDataFrame([], RECORD)).collect() == []


def test_assignment_is_cheapest():
    import itertools
    import random

    rng = random.Random(4)
    for n in (1, 2, 4, 5):
        cost = [[rng.random() for _ in range(n)] for _ in range(n)]
        best = min(sum(cost[i][p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
        chosen = schema_drift.assign(cost)
        assert abs(sum(cost[i][chosen[i]] for i in range(n)) - best) < 1e-9


# --- related tables, depth, moves, headers ------------------------------------------------------------------------


def test_json_of_any_depth_keeps_its_nodes(spark):
    depth = 20_000
    text = '{"a":' * depth + '{"messages":[{"x":1},{"x":2}]}' + "}" * depth
    spec = nested.NestedSpec(columns=("doc",), list_keys=frozenset(("messages",)), json_fields=frozenset(("doc",)))
    rows = list(nested.walk("[" + text + "]", "doc", spec))
    assert [len(label) for label, _, _ in rows] == [1, 2, 2]
    assert rows[1][0][1].endswith(".messages[0]")


@pytest.mark.parametrize("text", ['{"a": [1, 2.5, true, null, "x\\n"], "b": {}, "c": []}', "[]", "3", '"x"', ' [ { } , [ ] ] ', '{"a":{"b":[{"c":[]}]}}'])
def test_deep_values_against_the_decoder(text):
    assert strict_json.deep_value(text) == json.loads(text)


@pytest.mark.parametrize("text", ["", "{", "[1,]", '{"a":1,}', '{"a" 1}', "[1] 2", "{1:2}", "nul", "[1", '{"a":}'])
def test_deep_values_refuse_what_is_no_json(text):
    with pytest.raises(ValueError):
        strict_json.deep_value(text)


def test_related_tables_link_to_their_parents(spark):
    kind = "run string, doc string"
    rows = [("r1", '[{"turn": 1, "run": "x", "messages": [{"role": "a", "n": 1}, {"role": "b", "n": 2.5}]}, {"turn": "2", "messages": {"role": "c"}}]'), ("r2", None), ("r3", "[]")]
    spec = nested.NestedSpec(columns=("doc",), list_keys=frozenset(("messages",)), json_fields=frozenset(("doc",)))
    long = nested.tables(nested.flatten(spark.createDataFrame(rows, kind), ["run"], spec), ["run"])
    made = nested.relational(long, ["run"])
    assert set(made) == {"doc*", "doc*.messages*"}
    top, below = made["doc*"], made["doc*.messages*"]
    assert dict(below.dtypes)["n"] == "double" and dict(top.dtypes)["turn"] == "string" and "_run" in top.columns
    joined = below.join(top.select("run", F.col("node_path").alias("parent_path"), "turn"), ["run", "parent_path"])
    assert sorted((r.turn, r.role, r.n) for r in joined.collect()) == [("1", "a", 1.0), ("1", "b", 2.5), ("2", "c", None)]


def test_moves():
    script = [("removed", ("a", "x"), (), "t"), ("added", (), ("b", "x"), "t"), ("removed", ("y",), (), "t"), ("added", (), ("c", "y"), "u"), ("renamed", ("p",), ("q",), "")]
    assert schema_drift.moves(script) == [(("a", "x"), ("b", "x"))]
    # Two places to come from: no move can be told.
    assert schema_drift.moves([("removed", ("a", "x"), (), "t"), ("removed", ("d", "x"), (), "t"), ("added", (), ("b", "x"), "t")]) == []


def test_moved_fields_keep_their_column_and_unreadable_sidecars_take_their_neighbours(spark):
    struct = lambda **fields: json.dumps({"type": "struct", "fields": [{"name": k, "type": json.loads(v) if v.startswith("{") else v, "nullable": True, "metadata": {}} for k, v in fields.items()]})
    inner = struct(x="string", z="long")
    schemas = {1: struct(a=inner, b=struct(w="long")), 2: struct(a=struct(z="long"), b=struct(w="long", x="string")), 3: "no json"}
    sidecars = spark.createDataFrame(
        [(i, "t", no, "batch", "p", None, s, None, dt.datetime(2026, 1, no)) for i, (no, s) in enumerate(schemas.items())],
        "sidecar_id bigint, stage_table string, file_no int, stage_kind string, table_path string, wrapped_schema string, value_schema string, description string, written_at timestamp_ntz",
    )
    docs = [(1, 1, '{"a": {"x": "one", "z": 1}, "b": {"w": 2}}'), (2, 2, '{"a": {"z": 3}, "b": {"w": 4, "x": "one"}}'), (3, 3, '{"a": {"z": 5}, "b": {"w": 6, "x": "three"}}')]
    records = spark.createDataFrame([(i, "t", no, 1, "c", r) for i, no, r in docs], "record_id bigint, stage_table string, file_no int, line_no int, case_id string, record_json string")
    changes = {tuple(r) for r in schema_drift.changes_with_moves(sidecars, records).select("file_no", "change_kind", "old_field", "new_field").collect()}
    assert changes == {(2, "moved", "a.x", "b.x")}
    out = {r.record_id: json.loads(r.record) for r in schema_drift.consistent_table(sidecars, records).collect()}
    assert [out[i]["b.x"] for i in (1, 2, 3)] == ["one", "one", "three"] and all(len(o) == 3 for o in out.values())
    # Where a record of both files has another value, it is no move.
    other = records.withColumn("record_json", F.regexp_replace("record_json", '"b": ."w": 4, "x": "one"', '"b": {"w": 4, "x": "two"'))
    changes = {tuple(r) for r in schema_drift.changes_with_moves(sidecars, other).select("file_no", "change_kind", "old_field", "new_field").collect()}
    assert changes == {(2, "removed", "a.x", ""), (2, "added", "", "b.x")}


def test_headers_with_bars_load_and_salted_headers_agree(spark, monkeypatch):
    lines = [(0, "f", 1, "scores", "row_id|score_text|payload_text"), (1, "f", 2, "scores", "1|2.5|{}"), (2, "f", 3, "scores", '2|x|"{}"'), (3, "g", 1, "scores", "row_id;a,b;payload_text"), (4, "g", 2, "scores", "7;u,v;{}")]
    df = spark.createDataFrame(lines, "line_id bigint, file_name string, line_no int, dataset string, raw_line string")
    got = {r.line_id: r.fields for r in quarantine.load_lines(df).collect()}
    assert got == {1: {"row_id": "1", "score_text": "2.5", "payload_text": "{}"}, 4: {"row_id": "7", "a,b": "u,v", "payload_text": "{}"}}
    monkeypatch.setattr(quarantine, "BROADCAST_FILES", -1)
    assert {r.line_id: r.fields for r in quarantine.load_lines(df).collect()} == got
