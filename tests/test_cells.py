"""The error algebra and the operators over cells, rule by rule."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evalloom.cells import algebra as A
from evalloom.cells import types as C
from evalloom.cells.frame import CellFrame


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(1, "7", '{"a": {"b": [10, null]}, "k": "x"}', ["p", "q"]), (2, "bad", "nope", []), (3, None, None, None), (4, "8", '{"a": null}', ["r"])]
    return CellFrame.wrap(spark.createDataFrame(rows, "id int, num string, doc string, items array<string>"))


def result(frame, cell):
    f = frame.select({"id": frame["id"], "x": cell})
    df = f.df.select("id.value", F.col("x.value").cast("string").alias("v"), F.transform("x.metadata.errors", lambda e: e["code"]).alias("codes"))
    return [(r.v, r.codes) for r in df.orderBy("value").collect()]


def test_cast(frame):
    assert result(frame, A.cast(frame["num"], "int")) == [("7", []), (None, ["CAST_ERROR"]), (None, []), ("8", [])]


def test_upstream_errors_win(frame):
    twice = A.cast(A.cast(frame["num"], "int"), "boolean")
    assert [c for _, c in result(frame, twice)][1] == ["CAST_ERROR"]


def test_json(frame):
    doc = A.parse_json(frame["doc"])
    assert [c for _, c in result(frame, A.lift(lambda v: v.cast("string"), doc))] == [[], ["JSON_PARSE_ERROR"], [], []]
    deep = A.access_json(doc, "a", "b", 0)
    assert result(frame, deep) == [("10", []), (None, ["JSON_PARSE_ERROR"]), (None, ["JSON_ACCESS_ERROR"]), (None, ["JSON_ACCESS_ERROR"])]
    # A JSON null is a value, not an error.
    assert [c for _, c in result(frame, A.lift(lambda v: F.to_json(v), A.access_json(doc, "a")))] == [[], ["JSON_PARSE_ERROR"], ["JSON_ACCESS_ERROR"], []]


def test_array_access_counts_from_zero(frame):
    at = A.access(frame["items"], A.literal(0), is_map=False)
    assert result(frame, at) == [("p", []), (None, ["ACCESS_ERROR"]), (None, ["ACCESS_ERROR"]), ("r", [])]


def test_get_is_tolerant(frame):
    at = A.get(frame["items"], A.literal(5), frame.df.schema["items"].dataType["value"].dataType)
    assert [c for _, c in result(frame, at)] == [[], [], [], []]


def test_helpers(frame):
    n = A.cast(frame["num"], "int")
    assert [v for v, _ in result(frame, A.is_err(n))] == ["false", "true", "false", "false"]
    assert result(frame, A.err_or(n, A.literal(-1))) == [("7", []), ("-1", []), (None, []), ("8", [])]
    assert [v for v, _ in result(frame, A.latency(n))] == [None] * 4


def test_untaken_branches_give_their_errors(frame):
    n = A.cast(frame["num"], "int")
    c = A.lift(lambda i, v: F.when(i > 0, F.lit(1)).otherwise(v), frame["id"], n)
    assert [c for _, c in result(frame, c)][1] == ["CAST_ERROR"]


def test_aggregate_skips_and_collects(frame):
    n = A.cast(frame["num"], "int")
    g = frame.group({}, {"s": A.aggregate(F.sum, n), "t": A.aggregate(F.sum, A.err_or(n, A.literal(None)))})
    # Errored cells are null to the aggregate; its own cell has the group's errors and so no value, unless they are taken out.
    assert g.unwrap().first().asDict() == {"s": None, "t": 15}
    assert g.df.select(F.size("s.metadata.errors"), F.size("t.metadata.errors")).first() == (1, 0)


def test_decisions_on_errors_fail(frame):
    bad = A.lift(lambda v: v > 1, A.cast(frame["num"], "int"))
    with pytest.raises(Exception, match="WHERE consumed an errored cell"):
        frame.where(bad).df.collect()


def test_passthrough_keeps_the_cell(spark):
    df = spark.sql("SELECT 1 AS a").select(F.struct(F.lit("c1").alias("cell_id"), F.lit(5).alias("value"), F.struct(A.no_errors().alias("errors"), F.lit(9).cast("bigint").alias("latency_ms"), F.lit(None).cast(C.TRACE).alias("trace")).alias("metadata"), F.lit(True).alias("marker")).alias("x"))
    f = CellFrame(df)
    row = f.select({"y": f["x"], "l": A.latency(f["x"])}).df.first()
    assert row.y.cell_id == "c1" and row.y.metadata.latency_ms == 9 and row.l.value == 9


def test_old_cells_are_refused(spark):
    with pytest.raises(ValueError, match="older layout"):
        CellFrame.wrap(spark.sql("SELECT named_struct('cell_id', 'a', 'value', 1) AS x"))


def test_ids_are_stable(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "n int, s string")
    ids = lambda: sorted(r[0] for r in CellFrame.wrap(df, "stage").df.select("n.cell_id").collect())
    assert ids() == ids() and len(set(ids())) == 2 and all(len(i) == 32 for i in ids())


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(10).withColumn("b", F.lit("x")).write.parquet(str(tmp_path / "t"))
    f = CellFrame.wrap(spark.read.parquet(str(tmp_path / "t")))
    plan = f.where(A.lift(lambda v: v > 3, f["id"])).select({"id": f["id"]}).unwrap()._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,3)" in plan and "ReadSchema: struct<id:bigint>" in plan


def test_distinct_explode_union(spark):
    f = CellFrame.wrap(spark.createDataFrame([(1, [1, 2]), (1, [1, 2]), (2, None)], "a int, xs array<int>"))
    assert f.distinct().df.count() == 2
    x = f.explode(f["xs"], "x", position="p")
    assert [tuple(r) for r in x.select({"a": x["a"], "p": x["p"], "x": x["x"]}).unwrap().distinct().orderBy("p").collect()] == [(1, 0, 1), (1, 1, 2)]
    assert f.union(f, distinct=True).df.count() == 2


def test_empty_table(spark):
    f = CellFrame.wrap(spark.createDataFrame([], "a int, b string"))
    assert f.select({"x": A.cast(f["b"], "int")}).unwrap().collect() == []
    assert f.group({"a": f["a"]}, {"n": A.Cell(F.count(F.lit(1)))}).unwrap().collect() == []


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.integers(-5, 5).map(str), st.sampled_from(["x", "", "1.5"])), min_size=1, max_size=8))
def test_value_and_error_never_both(spark, texts):
    f = CellFrame.wrap(spark.createDataFrame([(t,) for t in texts], "t string"))
    n = A.cast(f["t"], "int")
    out = f.select({"n": n, "m": A.lift(lambda a: a + 1, n)}).df.collect()
    for r in out:
        for c in (r.n, r.m):
            assert not (c.value is not None and c.metadata.errors)
        assert len(r.m.metadata.errors) == len(r.n.metadata.errors)
