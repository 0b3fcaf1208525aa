"""Recipes end to end: load, batch and stream tables, calls, publications, reuse, reruns, failures."""

import json
import os

import pytest

from evalloom.engine import manifest as M
from evalloom.engine import run as engine
from evalloom.engine.controls import LeaseTimeout, Leases, fan_out
from evalloom.functions.registry import TEST_FUNCTIONS, Registry
from evalloom.plans import graph
from evalloom.script.surface import ScriptError

TEMPLATE = "<View><Text name=\"t\" value=\"$case_id\"/></View>"

RECIPE = """
DECLARE INPUT least INT DEFAULT 2;
DECLARE INPUT calls RATELIMIT DEFAULT 3;
LOAD cases FROM '{d}/cases.csv' WITH FORMAT='csv';
LOAD policies FROM '{d}/policies.jsonl';
CREATE FUNCTION bucket(p INT) RETURNS STRING RETURN CASE WHEN p >= 4 THEN 'urgent' ELSE 'normal' END;
CREATE BATCH TABLE prepared
SELECT case_id, policy_id, CAST(priority AS INT) AS priority, bucket(CAST(priority AS INT)) AS bucket,
       normalize_text(message) AS norm, parse_json(payload) AS doc
FROM cases WHERE err_or(CAST(priority AS INT), 0) >= least;
CREATE BATCH TABLE joined
SELECT p.case_id, p.norm, q.segment, CAST(p.doc['score'] AS DOUBLE) AS score, controlled_echo(text = p.norm, limiter = calls) AS echo
FROM prepared p LEFT JOIN policies q ON p.policy_id = q.policy_id;
CREATE BATCH TABLE summary
SELECT segment, COUNT(*) AS n, AVG(err_or(score, NULL)) AS mean, SUM(CASE WHEN is_err(score) THEN 1 ELSE 0 END) AS bad
FROM joined GROUP BY segment HAVING COUNT(*) > 0 ORDER BY segment;
CREATE STREAM TABLE copied OPTIONS (BATCH_SIZE = 1) SELECT case_id, upper(norm) AS up FROM joined;
CREATE BATCH TABLE report SELECT 'mean_score' AS metric, err_or(mean, NULL) AS value, segment FROM summary;
PUBLISH report TO REPORTS WITH (COMPONENT = METRIC);
PUBLISH summary TO REPORTS WITH (COMPONENT = CHART, CHART_TYPE = 'bar', X_AXIS = 'segment', Y_AXIS = 'n');
PUBLISH joined TO DATASET 'final';
PUBLISH joined TO ANNOTATION QUEUE 'review' AS rev WITH TEMPLATE = '{template}', CONSENSUS = 'majority';
SAVE summary TO '{d}/out' WITH FORMAT = 'json';
"""


def registry():
    r = Registry()
    for f in TEST_FUNCTIONS:
        r.add(f)
    return r


@pytest.fixture
def data(tmp_path):
    (tmp_path / "cases.csv").write_text(
        'case_id,policy_id,priority,message,payload\nc1,p1,5,Hello  World,"{""score"": 0.5}"\nc2,p1,2,Second,not json\nc3,p2,1,Third,{}\nc4,p9,x,Fourth,\nc5,p2,4,Fifth,"{""score"": null}"\n'
    )
    (tmp_path / "policies.jsonl").write_text('{"policy_id": "p1", "segment": "retail"}\n{"policy_id": "p2", "segment": "public"}\n')
    return tmp_path


def text(data, extra=""):
    return RECIPE.replace("{d}", str(data)).replace("{template}", TEMPLATE) + extra


def test_recipe_end_to_end(spark, data):
    folder = str(data / "run")
    result = engine.run(spark, text(data), engine.Settings(folder), registry())
    assert result.failed == {} and result.status == "completed"
    rows = {r["case_id"]: r for r in (json.loads(x) for x in spark.read.parquet(f"{folder}/datasets/final").toJSON().collect())}
    assert set(rows) == {"c1", "c2", "c5"} and rows["c1"]["score"] == 0.5 and rows["c1"]["echo"] == "hello world"
    errors = result.manifests["joined"].errors
    assert errors["by_code"]["JSON_PARSE_ERROR"] == 1 and errors["row_count"] == 3
    metrics = json.load(open(f"{folder}/reports/metrics.json"))
    assert [(m["metric"], m["value"], m["tags"]["segment"]) for m in metrics] == [("mean_score", 0.5, "retail")]
    issues = json.load(open(f"{folder}/reports/issues.json"))
    assert issues[0]["severity"] == "medium" and issues[0]["title"] == "Metric row not published"
    assert len(json.load(open(f"{folder}/reports/charts.json"))[0]["rows"]) == 2
    assert sorted(r[0] for r in spark.read.parquet(result.tables["copied"]).select("up.value").collect()) == ["FIFTH", "HELLO WORLD", "SECOND"]
    request = open(f"{folder}/annotations/rev.alias").read()
    assert len(open(f"{folder}/annotations/{request}/tasks.jsonl").readlines()) == 3
    assert spark.read.json(str(data / "out")).count() == 2
    events = [json.loads(x)["event"] for x in open(f"{folder}/events.jsonl")]
    assert events.count("started") == events.count("completed")


def test_parallel_gives_the_same(spark, data):
    a = engine.run(spark, text(data), engine.Settings(str(data / "a")), registry())
    b = engine.run(spark, text(data), engine.Settings(str(data / "b"), parallel=3), registry())
    assert b.status == "completed" and {n: m.errors["row_count"] for n, m in a.manifests.items()} == {n: m.errors["row_count"] for n, m in b.manifests.items()}


def test_reuse_and_invalidation(spark, data):
    recipe = f"LOAD p FROM '{data}/policies.jsonl'; CREATE BATCH TABLE a SELECT policy_id, segment FROM p; CREATE BATCH TABLE b SELECT COUNT(*) AS n FROM a;"
    first, second, third = (str(data / n) for n in ("r1", "r2", "r3"))
    engine.run(spark, recipe, engine.Settings(first))
    again = engine.run(spark, recipe, engine.Settings(second, reuse_from=first))
    assert again.reused == {"p", "a", "b"}
    changed = engine.run(spark, recipe.replace("policy_id, segment FROM", "policy_id FROM"), engine.Settings(third, reuse_from=first))
    assert changed.reused == {"p"}
    from_node = engine.run(spark, recipe, engine.Settings(str(data / "r4"), reuse_from=first, policy="from_node", from_node="b"))
    assert from_node.reused == {"p", "a"}


def test_errors_make_a_stage_not_reusable(spark, data):
    recipe = f"LOAD c FROM '{data}/cases.csv'; CREATE BATCH TABLE a SELECT CAST(priority AS INT) AS p FROM c;"
    engine.run(spark, recipe, engine.Settings(str(data / "r1")))
    assert engine.run(spark, recipe, engine.Settings(str(data / "r2"), reuse_from=str(data / "r1"))).reused == {"c"}


def test_failure_blocks_descendants(spark, data):
    recipe = f"LOAD c FROM '{data}/cases.csv'; CREATE BATCH TABLE a SELECT case_id FROM c WHERE CAST(priority AS INT) > 1; CREATE BATCH TABLE b SELECT case_id FROM a; CREATE BATCH TABLE z SELECT case_id FROM c;"
    result = engine.run(spark, recipe, engine.Settings(str(data / "r")))
    assert "errored cell" in result.failed["a"] and result.blocked == {"b"} and "z" in result.tables


def test_annotation_results(spark, data):
    recipe = f"LOAD p FROM '{data}/policies.jsonl'; PUBLISH p TO ANNOTATION QUEUE 'q' AS al WITH TEMPLATE = '{TEMPLATE}'; RETRIEVE ANNOTATION RESULTS done FROM al; CREATE BATCH TABLE x SELECT label FROM done;"
    folder = str(data / "r")
    result = engine.run(spark, recipe, engine.Settings(folder))
    assert result.status == "waiting" and result.waiting == ["done"] and result.blocked == {"x"}
    request = open(f"{folder}/annotations/al.alias").read()
    with open(f"{folder}/annotations/{request}/results.jsonl", "w") as f:
        f.write('{"label": "ok"}\n')
    assert engine.run(spark, recipe, engine.Settings(folder)).status == "completed"


@pytest.mark.parametrize(
    "recipe, says",
    [
        ("SELECT 1", "outside CREATE TABLE"),
        ("DECLARE INPUT a INT; DECLARE INPUT a INT; LOAD t FROM 'x.csv'", "twice"),
        ("DECLARE INPUT a VARIANT; LOAD t FROM 'x.csv'", "not supported"),
        ("DECLARE INPUT a RATELIMIT DEFAULT 0; LOAD t FROM 'x.csv'", "positive"),
        ("DECLARE INPUT a POOL DEFAULT 'x'; LOAD t FROM 'x.csv'", "KIND"),
        ("LOAD t FROM 'x.csv' WITH WRAP = false", "WRAP"),
        ("LOAD t FROM 'x.csv' LIMIT 0", "positive"),
        ("CREATE BATCH TABLE a SELECT x FROM nowhere", "unknown relation"),
        ("CREATE BATCH TABLE a SELECT x FROM b; CREATE BATCH TABLE b SELECT x FROM a", "need each other"),
        ("LOAD t FROM 'x.csv'; CREATE BATCH TABLE a SELECT no.such(x) FROM t", "unknown function"),
        ("LOAD t FROM 'x.csv'; CREATE BATCH TABLE a SELECT data.parse_csv() FROM t", "lacks content"),
        ("LOAD t FROM 'x.csv'; CREATE BATCH TABLE a SELECT data.parse_csv(content => x) FROM t", "=>"),
        ("LOAD t FROM 'x.csv'; CREATE BATCH TABLE a SELECT x, FROM t", "FROM"),
        ("LOAD t FROM 'x.csv'; CREATE BATCH TABLE a SELECT f'{x}' FROM t", "f-strings"),
        ("LOAD t FROM 'x.csv'; PUBLISH t TO REPORTS WITH (COMPONENT = CHART)", "CHART_TYPE"),
        ("LOAD t FROM 'x.csv'; PUBLISH t TO ANNOTATION QUEUE 'q'", "TEMPLATE"),
        ("DECLARE INPUT a INT DEFAULT 1", "at least one table"),
        ("LOAD t FROM 'x.csv'; CREATE BATCH TABLE a OPTIONS (POOL = p) SELECT x FROM t", "executor pool"),
        ("LOAD t FROM 'x.csv'; CREATE BATCH TABLE a OPTIONS (COLUMN_SEMANTICS = {x: 'video'}) SELECT x FROM t", "can't be shown"),
        ("LOAD t FROM 'x.csv'; CREATE BATCH TABLE a SELECT x AS metric FROM t; PUBLISH a TO REPORTS WITH (COMPONENT = METRIC)", "metric and value"),
        ("LOAD t FROM 'x.csv'; CREATE BATCH TABLE a SELECT http.get(url = x, limiter = n) FROM t", "declared RATELIMIT"),
    ],
)
def test_refused(recipe, says):
    with pytest.raises((ScriptError, ValueError), match=says):
        engine.validate(recipe)


def test_inputs_are_coerced(spark, data):
    recipe = f"DECLARE INPUT n INT; LOAD p FROM '{data}/policies.jsonl' LIMIT n;"
    assert engine.run(spark, recipe, engine.Settings(str(data / "r"), {"n": "1"})).manifests["p"].errors["row_count"] == 1
    for bad, says in (({"n": "x"}, "is no INT"), ({}, "no value"), ({"n": 1, "m": 2}, "unknown input")):
        with pytest.raises(ScriptError, match=says):
            engine.run(spark, recipe, engine.Settings(str(data / "q"), bad))


def test_transpile_and_graph(spark, data):
    statements, steps = engine.validate(text(data), registry())
    assert [s.makes for s in steps if s.makes][:2] == ["cases", "policies"]
    g = graph.recipe_graph(statements)
    assert {"from": "cases", "to": "prepared", "kind": "reads"} in g["edges"]
    out = engine.transpile(spark, "CREATE BATCH TABLE a SELECT x + 1 AS y FROM VALUES (1), (2) AS t(x)")
    assert "plan" in out[0]


def test_rerun_feasibility():
    statements, steps = engine.validate("LOAD t FROM 'x.csv'; CREATE BATCH TABLE a SELECT x FROM t; CREATE BATCH TABLE b SELECT x FROM a")
    prints = {s.makes: s.makes for s in steps}
    found = M.analyse_rerun(steps, prints, {}, "from_node", "b")
    assert found.errors and "a" in found.errors[0]
    assert M.analyse_rerun(steps, prints, {}, "from_node", "zz").errors


def test_leases():
    leases = Leases(ttl=60)
    held = leases.acquire("k", 1)
    with pytest.raises(LeaseTimeout):
        leases.acquire("k", 1, timeout=0.05)
    assert leases.renew("k", held) and leases.release("k", held) and leases.in_use("k") == 0
    assert fan_out(lambda x: x * 2, [1, 2, 3], 2) == [2, 4, 6]
    assert os.path.exists(__file__)


def test_limits_hold_over_all_workers(spark, tmp_path):
    """Each call notes when it began and ended; no more than the limit overlap, whichever worker made them."""
    import time

    from evalloom.functions.registry import Function, parameters

    def slow(text, limiter=None):
        began = time.time()
        time.sleep(0.05)
        return f"{began} {time.time()}"

    r = Registry()
    r.add(Function("local.slow", parameters("text, limiter?"), "string", slow))
    spark.range(40).selectExpr("CAST(id AS STRING) AS t").repartition(4).write.parquet(str(tmp_path / "t"))
    recipe = f"DECLARE INPUT calls RATELIMIT DEFAULT 2; LOAD t FROM '{tmp_path}/t' WITH FORMAT = 'parquet'; CREATE BATCH TABLE a SELECT local.slow(text = t, limiter = calls) AS s FROM t;"
    result = engine.run(spark, recipe, engine.Settings(str(tmp_path / "r")), r)
    assert result.failed == {}
    rows = spark.read.parquet(result.tables["a"]).select("s.value", "s.metadata.trace.limiter_key", "s.metadata.trace.max_in_flight").collect()
    spans = [tuple(map(float, v.value.split())) for v in rows]
    assert max(sum(a <= b <= z for a, z in spans) for b, _ in spans) <= 2 and {(v.limiter_key, v.max_in_flight) for v in rows} == {("calls", 2)}
