"""Project folders, the command line, readers, reports and the function catalog."""

import inspect
import json

import pytest

from evalloom import cli
from evalloom.functions import native
from evalloom.functions import registry as R
from evalloom.project import folder as projects
from evalloom.publish import reports
from evalloom.script import statements as S
from evalloom.script.surface import ScriptError, expand_macros, split_statements, triple_quotes
from evalloom.sources import readers


@pytest.fixture
def project(tmp_path):
    (tmp_path / "recipe.sql").write_text(
        f"DECLARE INPUT least INT; DECLARE INPUT key SECRET DEFAULT 'secret.K'; LOAD rows FROM '{tmp_path}/rows.csv';"
        "CREATE BATCH TABLE scored SELECT id, local.double_it(x = n) AS d FROM rows WHERE n >= least;"
        "CREATE BATCH TABLE m SELECT 'total' AS metric, SUM(d) AS value FROM scored; PUBLISH m TO REPORTS WITH (COMPONENT = METRIC);"
    )
    (tmp_path / "rows.csv").write_text("id,n\na,1\nb,2\nc,3\n")
    (tmp_path / "fixture_math.py").write_text("from evalloom.functions.registry import function\n\n@function()\ndef double_it(x: int) -> int:\n    return int(x) * 2\n")
    (tmp_path / "inputs.yaml").write_text("least: 2\n")
    (tmp_path / "secrets.yaml").write_text("K: hidden-value\n")
    return tmp_path


def test_command_line(spark, project, capsys):
    assert cli.main(["validate", str(project)]) == 0
    assert cli.main(["run", str(project), "--out", str(project / "run")]) == 0
    assert "total: 10.0" in (project / "run" / "report.md").read_text()
    assert cli.main(["run", str(project), "--out", str(project / "run2"), "--input", "least=3", "--reuse", str(project / "run")]) == 0
    assert "1 reused" in capsys.readouterr().out
    assert cli.main(["report", str(project / "run2"), "--format", "html"]) == 0 and "total: 6.0" in capsys.readouterr().out
    assert cli.main(["run", str(project), "--out", str(project / "r3"), "--input", "nope=1"]) == 2


def test_recipe_choice(tmp_path):
    for n in ("a.sql", "b.sql"):
        (tmp_path / n).write_text("LOAD t FROM 'x.csv'")
    with pytest.raises(ScriptError, match="2 .sql files"):
        projects.find_recipe(str(tmp_path))
    assert projects.find_recipe(str(tmp_path), "b.sql").endswith("b.sql")


def test_missing_secret_is_refused(project):
    (project / "inputs.yaml").write_text("least: secret.NOPE\n")
    with pytest.raises(ScriptError, match="NOPE"):
        projects.load(str(project))


def test_surface():
    assert split_statements("a ';' b; -- c;\n d(1;2); /* ; */") == ["a ';' b", "-- c;\n d(1;2)"]
    assert triple_quotes('SELECT """it\'s"""') == "SELECT 'it''s'"
    assert expand_macros("SELECT $N\n$LIMIT_ROWS;", {"N": "5"}) == "SELECT 5\n;"
    s = S.parse_statement("CREATE BATCH TABLE t OPTIONS (POOL = p, COLUMN_SEMANTICS = {a: {type: 'json'}}, N = [1, 2]) SELECT 1 AS a")
    assert s.options == {"POOL": "p", "COLUMN_SEMANTICS": {"a": {"type": "json"}}, "N": [1, 2]}


@pytest.mark.parametrize("path, form", [("a/b.jsonl", "jsonl"), ("b.csv.gz", "csv"), ("/data/t", "parquet"), ("x.json", "json")])
def test_formats(path, form):
    assert readers.infer_format(path) == form


def test_sources_that_are_refused(spark):
    for path, options in (("http://h/x.csv", {}), ("nowhere", {}), ("a/b.csv", {"FORMAT": "orc"})):
        with pytest.raises(ScriptError):
            readers.read(spark, path, options)
    with pytest.raises(ScriptError, match="can't be told"):
        readers.infer_format("https://h/x")


def test_directory_listing(spark, tmp_path):
    for n in ("a.json", "b.txt"):
        (tmp_path / n).write_text("{}")
    assert {r.name for r in readers.list_directory(spark, str(tmp_path)).collect()} == {"a.json", "b.txt"}


def test_consensus(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (1, "b", 3), (2, "a", 1), (2, "b", 2)], "task_id int, result string, submitted_at int")
    found = lambda kind: {r.task_id: r.result for r in reports.consensus(df, kind, 3).collect()}
    assert found("majority") == {1: "a", 2: None} and found("none") == {1: "a", 2: "a"} and found("unanimous") == {1: None, 2: None}


def test_secrets_are_blacked_out(tmp_path):
    reports.append(str(tmp_path / "metrics.json"), [{"metric": "k tok-1", "value": 1}])
    assert "tok-1" not in reports.render(str(tmp_path), "md", ["tok-1"])


def test_catalog_is_complete_and_callable():
    assert len(R.CATALOG) == 74
    for f in R.CATALOG.values():
        assert f.python or f.column or f.needs
        if f.python:
            own = inspect.signature(f.python).parameters
            if not any(p.kind is inspect.Parameter.VAR_KEYWORD for p in own.values()):
                assert {p.name for p in f.parameters} <= set(own), f.name


def test_binding():
    f = R.CATALOG["data.parse_csv"]
    assert f.bind(["x"], {"max_rows": 3}) == {"content": "x", "max_rows": 3}
    for args, named in (([], {}), (["x"], {"content": "y"}), (["x"], {"zz": 1}), (list("abcdef"), {})):
        with pytest.raises(R.BindError):
            f.bind(args, named)
    with pytest.raises(ValueError, match="of the catalog"):
        R.Registry().add(f)


def test_manifest_functions():
    f = R.from_manifest({"name": "x.y", "arguments": [{"name": "a", "schema": {"type": "integer", "format": "int64"}}], "returns": {"type": "array", "items": {"type": "number"}}})
    assert (f.parameters[0].kind, f.returns) == ("bigint", "array<double>")
    with pytest.raises(ValueError):
        R.from_manifest({"arguments": []})


def test_native_functions():
    assert native.fenced_blocks("```json\n{}\n```\n```\nopen", "json") == ["{}"] and native.fenced_blocks(None) == []
    assert native.parse_csv("a,b\n1\n", None, None, None, 0) == json.dumps({"columns": ["a", "b"], "rows": [], "row_count": 0, "truncated": True})
    steps = {"expected_steps": [{"id": "a"}, {"id": "b"}], "observed_steps": [{"id": "1", "matches_expected_ids": ["b"]}, {"id": "2", "matches_expected_ids": ["a"]}]}
    assert [native.step_adherence(steps, p)["label"] for p in native.ORDERINGS] == ["fail", "fail", "pass", "fail"]
    assert native.step_adherence({}, None)["label"] == "review"
    assert native.schema_match(None, None, "{}")["construction_failure_type"] == "insufficient_schema"
    assert native.schema_match(["{}"], ["a"], "not json")["construction_failure_type"] == "invalid_call_shape"
    assert native.schema_match(None, ['{"contains": {"q": "ab"}}'], '{"q": "xaby"}')["score"] == 1.0
    assert native.final_rating("a", ["a", None], ["b", "c"], [1, 1]) == 1516.0
    made = native.simulate(lambda t, m: m.upper(), lambda t, last: "hi" if t < 2 else None, [lambda t, m: m], 5)
    assert made["ok"] and len(made["turns"]) == 2 and made["final_output"] == "HI"
    calls = [{"tool_calls": [{"name": "f", "args": {"x": 1}}]}]
    assert native.tool_call_f1(calls, [{"name": "f", "args": {"x": 1}}])["value"] == 1.0
    assert native.tool_call_accuracy(calls, [{"name": "g", "args": {}}])["value"] == 0.0


# --- contracts of the catalog ---------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "default, says",
    [
        ("{max_workers: 0}", "positive whole number"), ("{nope: 1}", "no field nope"), ("{min_workers: 3, max_workers: 2}", "above"), ("{memory_per_worker: '2x'}", "size like"),
        ("{kind: 'service'}", "can't be service"), ("5", "object of literals"), ("{max_workers: 2, memory_per_worker: '2g'}", None), ("'{max_workers: 2}'", None),
    ],
)
def test_pool_fields(default, says):
    text = f"DECLARE INPUT p POOL WITH KIND = 'executor' DEFAULT {default}; LOAD t FROM 'x.csv'"
    if says is None:
        S.check_inputs(S.parse_script(text))
        return
    with pytest.raises(ScriptError, match=says):
        S.check_inputs(S.parse_script(text))


def test_supplied_configs_aliases_and_stubs():
    @R.function()
    def slow(x: int, timeout: R.TimeoutConfig, retry: R.RetryConfig) -> str:
        return f"{x} {timeout.total} {retry.tries}"

    r = R.Registry()
    f = r.add(slow.__evalloom__)
    assert [p.name for p in f.parameters] == ["x"] and f.python(x=1) == "1 60.0 3"
    assert "local_slow" in r and r.get("local_slow") is f and "http_get" in r and "nothing_here" not in r
    r.transport("http.", R.stub)
    assert r.get("http_get").python(url="u") == "http.get(url='u')"


def test_dependencies():
    from evalloom.plans.graph import dependencies

    text = "DECLARE INPUT m AISYSTEM DEFAULT 'sys-1'; DECLARE INPUT d DATASET DEFAULT 'ds-1'; DECLARE INPUT n INT; CREATE FUNCTION l.f(x INT) RETURN x + 1; LOAD t FROM 'dataset://other'; LOAD u FROM 'a/x.csv'; CREATE BATCH TABLE q SELECT l.f(x) AS a, http.get(url = y) AS b FROM t"
    found = dependencies(S.parse_script(text))
    assert found["aisystems"] == ["sys-1"] and found["datasets"] == ["ds-1", "other"] and found["sources"] == ["a/x.csv"] and found["inputs"] == ["n"] and found["functions"] == ["http.get"]


def test_network_functions_bind_their_arguments():
    R.CATALOG["aisystems.http.get"].bind([], {"aisystem_id": "a", "url": "u", "max_bytes": 5, "allow_redirects": True})
    R.CATALOG["aisystems.llm.chat"].bind([], {"aisystem_id": "a", "messages": "m", "top_p": 1, "seed": 2, "stop": "x", "secret_id": "s"})
    R.CATALOG["aisystems.llm.responses"].bind([], {"aisystem_id": "a", "input_value": "m", "max_output_tokens": 5, "metadata": "{}"})
    with pytest.raises(R.BindError):
        R.CATALOG["http.get"].bind([], {"aisystem_id": "a", "url": "u"})


def test_objects_are_read_whole_or_not_at_all(tmp_path):
    (tmp_path / "big").write_bytes(b"x" * (native.MAX_READ_BYTES + 1))
    (tmp_path / "bad").write_bytes(b"\xff")
    entry = lambda n: [{"path": n, "object_uri": f"file://{tmp_path}/{n}", "entry_type": "file"}]
    for name, error in (("big", ValueError), ("bad", UnicodeDecodeError), ("gone", FileNotFoundError)):
        with pytest.raises(error):
            native.read_text(entry(name), name)
    with pytest.raises(FileNotFoundError):
        native.read_text(entry("big"), "other")
    (made,) = native.write_json("a/b.json", {"b": 1, "a": [2]}, root=str(tmp_path))
    assert native.read_json([made], "a/b.json") == '{"a":[2],"b":1}' and made["parent_path"] == "a" and native.write_json("a/b.json", '{"a":[2],"b":1}', root=str(tmp_path))[0] == made
    with pytest.raises(ValueError):
        native.write_text("../x", "y", root=str(tmp_path))


def test_simulations():
    from evalloom.functions import simulation

    agent = lambda request: {"response": f"re {request}"}
    more = lambda response, state, env, turn: {"request": "again", "terminate": turn == 3, "state": {"k": turn}}
    done = simulation.run("hi", more, agent)
    assert (done["ok"], done["status"], len(done["turns"]), done["final_output"]) == (True, "completed", 3, "again") and done["turns"][1]["request"] == "again"
    assert simulation.run("hi", lambda r: {"request": "x"}, agent)["turns"][0]["terminate"] is True
    out = simulation.run("hi", lambda r: {"request": "x", "terminate": False}, agent, limits={"max_turns": 2})
    assert (out["status"], out["error"]["code"], out["final_output"]) == ("max_turns", "max_turns", "re x")

    def breaks(request):
        raise KeyError("gone")

    bad = simulation.run("hi", more, breaks)
    assert (bad["ok"], bad["status"], bad["turns"][0]["error"]["code"]) == (False, "failed", "KeyError")
    assert simulation.run("hi", more, lambda r: {"no": 1})["status"] == "failed"

    async def slow(request):
        import asyncio

        await asyncio.sleep(5)

    assert simulation.run("hi", more, slow, limits='{"timeout_seconds": 0.05}')["status"] == "timeout"
    with pytest.raises(ValueError, match="unknown functions"):
        simulation.run("hi", more, agent, observers=[{"callback": "x", "schedule": ["final"]}])


@pytest.mark.parametrize("argument, says", [("local.nope", "unknown function"), ("'text'", "name of a function"), ("http.get", "needs a network")])
def test_function_arguments_are_checked(argument, says):
    from evalloom.engine import run as engine
    from evalloom.queries.stored import registry

    text = f"LOAD t FROM 'x.csv'; CREATE BATCH TABLE a SELECT simulators.run(input = x, user = local.patient_user, agent = {argument}) AS r FROM t"
    with pytest.raises((ScriptError, R.BindError), match=says):
        engine.validate(text, registry())


def test_reports_of_many_rows_are_written_by_executors(spark, tmp_path, monkeypatch):
    from evalloom.cells.frame import CellFrame

    monkeypatch.setattr(reports, "MAX_REPORT_ROWS", 5)
    df = CellFrame.wrap(spark.range(8).selectExpr("CONCAT('m', id) AS metric", "CAST(id AS DOUBLE) AS value")).df
    reports.publish_report(df, "t", {"COMPONENT": "METRIC"}, str(tmp_path))
    (found,) = json.loads((tmp_path / "metrics.json").read_text())
    assert spark.read.json(found["rows_at"]).count() == 8 and "rows in" in reports.render(str(tmp_path))
    reports.publish_report(df.limit(2), "u", {"COMPONENT": "METRIC"}, str(tmp_path))
    assert len(json.loads((tmp_path / "metrics.json").read_text())) == 3


def test_sources_behind_urls(spark, tmp_path):
    import functools
    import http.server
    import threading

    (tmp_path / "x.csv").write_text("a,b\n1,x\n2,y\n")

    class Quiet(http.server.SimpleHTTPRequestHandler):
        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), functools.partial(Quiet, directory=str(tmp_path)))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{server.server_address[1]}/x.csv"
        assert sorted(tuple(r) for r in readers.read(spark, url).collect()) == [(1, "x"), (2, "y")]
        with pytest.raises(ScriptError, match="can't be read"):
            readers.read(spark, url.replace("x.csv", "gone.csv"))
    finally:
        server.shutdown()
