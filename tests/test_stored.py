"""Stages read back: plans of joins and filters, errors in keys, ids, latency, and the modes of the recipe language."""

import pytest
from pyspark.sql import functions as F

from evalloom.cells import algebra as A
from evalloom.cells.frame import CellFrame
from evalloom.engine import run as engine
from evalloom.functions.registry import Registry
from evalloom.queries import stored
from evalloom.script import ast as N
from evalloom.script.lower import Context, lower_query
from evalloom.script.surface import ScriptError
from evalloom.session import scratch
from evalloom.streaming import stages as streams

D = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def tables(spark):
    """orders, customer and scores as a recipe stores them, with what the manifests know."""
    result, _ = stored.stages(spark, D, "", "orders", "customer", "scores")
    more, _ = stored.stages(spark, D, "CREATE BATCH TABLE numbers SELECT row_id, CAST(score_text AS BIGINT) AS score FROM scores;", "scores")
    context = Context(spark)
    for r in (result, more):
        for name, path in r.tables.items():
            context.tables[name] = spark.read.parquet(path)
            context.clean[name] = frozenset(c for c in context.tables[name].columns if c not in r.manifests[name].errors["by_column"])
    return context


def lowered(context, text):
    return lower_query(N.parse_query(text), context)


@pytest.mark.parametrize("how", ["JOIN", "LEFT JOIN", "RIGHT JOIN", "FULL JOIN"])
def test_stored_joins_are_equi_joins(spark, tables, how):
    p = plan(lowered(tables, f"SELECT o.o_orderkey, c.c_custkey FROM orders o {how} customer c ON o.o_custkey = c.c_custkey").df)
    assert ("SortMergeJoin" in p or "BroadcastHashJoin" in p or "ShuffledHashJoin" in p) and "Cartesian" not in p and "NestedLoop" not in p


def test_keys_that_may_be_errored_are_checked_and_still_hashed(spark, tables):
    assert "score" not in tables.clean["numbers"]
    text = "SELECT o.o_orderkey, n.row_id FROM orders o JOIN numbers n ON o.o_custkey = n.score"
    df = lowered(tables, text).df
    p = plan(df)
    assert "Cartesian" not in p and "NestedLoop" not in p
    with pytest.raises(Exception, match="JOIN ON consumed an errored cell"):
        df.collect()
    df = lowered(tables, text.replace("n.score", "err_or(n.score, -1)")).df
    assert "Cartesian" not in plan(df) and "NestedLoop" not in plan(df)
    df.collect()


def test_filters_on_stored_cells_reach_the_scan(spark, tables):
    p = plan(lowered(tables, "SELECT o_orderkey FROM orders WHERE o_custkey >= 100").df)
    assert "GreaterThanOrEqual(o_custkey.value,100)" in p
    with pytest.raises(Exception, match="WHERE consumed an errored cell"):
        lowered(tables, "SELECT row_id FROM numbers WHERE score > 1").df.collect()


def test_aggregates_of_clean_cells_collect_no_errors(spark, tables):
    assert "collect_list" not in plan(lowered(tables, "SELECT o_orderstatus, SUM(o_custkey) AS s FROM orders GROUP BY o_orderstatus").df)


def test_unmatched_rows_of_outer_joins(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string")
    b = spark.createDataFrame([(2, "x"), (2, "y"), (3, "z"), (None, "m")], "k int, w string")
    for clean in (True, False):
        context = Context(spark, tables={"a": CellFrame.wrap(a).df, "b": CellFrame.wrap(b).df})
        if clean:
            context.clean = {"a": frozenset("kv"), "b": frozenset("kw")}
        got = {}
        for how in ("INNER", "LEFT", "RIGHT", "FULL"):
            f = lowered(context, f"SELECT a.v, b.w, is_err(b.w) AS e FROM a {how} JOIN b ON a.k = b.k")
            got[how] = sorted((tuple(r) for r in CellFrame.wrap(f.df).unwrap().collect()), key=str)
        assert got["INNER"] == [("b", "x", False), ("b", "y", False)]
        assert len(got["LEFT"]) == 4 and len(got["RIGHT"]) == 4 and len(got["FULL"]) == 6
        assert all(not r[2] for r in got["FULL"])


def test_order_survives_windows(spark):
    context = Context(spark, tables={"t": spark.range(100).withColumn("g", F.col("id") % 7)})
    out = lowered(context, "SELECT id, row_number() OVER (PARTITION BY g ORDER BY id) AS rn FROM t ORDER BY id DESC").unwrap()
    assert [r.id for r in out.collect()] == list(range(99, -1, -1))


@pytest.mark.parametrize("text", ["SELECT * FROM t PIVOT (sum(id) FOR g IN (1, 2))", "WITH RECURSIVE r AS (SELECT 1) SELECT * FROM r", "SELECT (SELECT 1) AS x FROM t"])
def test_what_cells_cannot_do_is_refused_in_every_mode(spark, text):
    context = Context(spark, tables={"t": spark.range(3).withColumn("g", F.lit(1))}, strict=False)
    with pytest.raises(ScriptError):
        lowered(context, text)


def test_set_operations_fail_on_errors(spark):
    f = CellFrame.wrap(spark.createDataFrame([("1",), ("x",)], "t string"))
    f = f.select({"n": A.cast(f["t"], "int")})
    context = Context(spark, tables={"t": f.df}, strict=False)
    with pytest.raises(Exception, match="EXCEPT consumed an errored cell"):
        lowered(context, "SELECT n FROM t EXCEPT SELECT n FROM t").df.collect()


def test_expressions_grow_with_their_length(spark):
    f = CellFrame.wrap(spark.createDataFrame([("1",)], "t string"))
    sizes = []
    for depth in (2, 4, 8):
        c = f["t"]
        for _ in range(depth):
            c = A.cast(A.cast(c, "int"), "string")
        sizes.append(len(f.select({"c": c}).df._jdf.queryExecution().analyzed().toString()))
    assert sizes[2] < sizes[0] * 40


def test_errors_of_calls_keep_their_time_and_trace(spark):
    registry = Registry()
    for fn in stored.TEST_FUNCTIONS:
        registry.add(fn)
    folder = scratch(spark, "calls")
    spark.createDataFrame([("{\"score\": 1}",), ("no",)], "t string").write.parquet(f"{folder}/t")
    text = f"LOAD t FROM '{folder}/t' WITH FORMAT = 'parquet'; CREATE BATCH TABLE made SELECT extract_json_score(t) AS s, CAST(t AS INT) AS bad, extract_json_score(CAST(CAST(t AS INT) AS STRING)) AS skipped FROM t;"
    result = engine.run(spark, text, engine.Settings(f"{folder}/run"), registry)
    assert result.failed == {}
    rows = spark.read.parquet(result.tables["made"]).collect()
    seen = {(r.s.value, r.s.metadata.trace.status, r.s.metadata.latency_ms is not None, r.skipped.metadata.trace.status, r.skipped.metadata.latency_ms) for r in rows}
    assert seen == {(1.0, "ok", True, "skipped", None), (None, "error", True, "skipped", None)}
    ids = [c.cell_id for r in rows for c in r]
    assert None not in ids and len(set(ids)) == 6


def test_update_mode_keeps_the_last_row_of_a_key(spark):
    folder = scratch(spark, "update")
    for part in range(3):
        spark.range(10).withColumn("g", F.col("id") % 2).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    s = streams.source(spark, f"{folder}/in", 1).groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    assert sorted(tuple(r) for r in streams.drain_to_table(s, "update", folder=folder, keys=["g"]).collect()) == [(0, 15), (1, 15)]
    with pytest.raises(ScriptError, match="keys"):
        streams.drain_to_table(s, "update")


def test_batch_functions_give_error_payloads(spark):
    from evalloom.functions import udf as U

    def fails(values):
        raise ValueError("no")

    async def some(v):
        if v == 1:
            raise KeyError("one")
        return {"name": "Odd", "message": "payload"} if v == 3 else v

    df = spark.range(4)
    cell = U.outcome(U.batch_function(fails, "bigint", errors=True)("id"), "f")
    f = CellFrame(df).select({"id": CellFrame(df)["id"], "x": cell})
    assert {(r.x.value, r.x.metadata.errors[0].message) for r in f.df.collect()} == {(None, "no")}
    cell = U.outcome(U.async_row_function(some, "bigint", errors=True)("id"), "f")
    f = CellFrame(df).select({"id": CellFrame(df)["id"], "x": cell})
    assert sorted((r.id.value, r.x.value, [e.message for e in r.x.metadata.errors]) for r in f.df.collect()) == [(0, 0, []), (1, None, ["'one'"]), (2, 2, []), (3, None, ["payload"])]
