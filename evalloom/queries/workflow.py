"""The engine's own products as tables: recipes, publications, stage summaries, streams, sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cells import algebra as A
from ..cells.frame import CellFrame
from ..engine import manifest as M
from ..engine import run as engine
from ..plans.graph import recipe_graph
from ..publish import reports
from ..script import ast as N
from ..script.lower import Context, Macro, check_query, lower_query
from ..script.surface import ScriptError
from ..session import scratch, table
from ..sources import readers, sinks
from ..streaming import stages as streams

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return register


def recipe(spark: SparkSession, sf_dir: str, text: str, *tables: str, **inputs) -> DataFrame:
    """Lower one query of the recipe language over driver tables, wrapped; the values."""
    context = Context(spark, tables={t: CellFrame.wrap(table(spark, sf_dir, t)).df for t in tables})
    for name, value in inputs.items():
        context.inputs[name] = A.literal(value)
    q = N.parse_query(text)
    check_query(q)
    return lower_query(q, context).unwrap()


@query("""
    WITH big AS (SELECT l_orderkey, sum(l_linenumber) AS lines FROM lineitem GROUP BY l_orderkey), top AS (SELECT l_orderkey AS k, lines FROM big WHERE lines > 10)
    SELECT o_orderpriority, count(*) AS n, sum(lines) AS lines FROM top JOIN orders ON k = o_orderkey GROUP BY o_orderpriority
""")
def cte_chain(spark, d):
    return recipe(
        spark, d,
        """WITH big AS (SELECT l_orderkey, SUM(l_linenumber) AS lines FROM lineitem GROUP BY l_orderkey),
                top AS (SELECT l_orderkey AS k, lines FROM big WHERE lines > 10)
           SELECT o_orderpriority, COUNT(*) AS n, SUM(lines) AS lines FROM top t JOIN orders o ON t.k = o.o_orderkey GROUP BY o_orderpriority""",
        "lineitem", "orders",
    )


@query("SELECT p_brand, n, n * 2 AS twice FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand) WHERE n > 3")
def derived_table(spark, d):
    return recipe(spark, d, "SELECT s.p_brand, s.n, s.n * 2 AS twice FROM (SELECT p_brand, COUNT(*) AS n FROM part GROUP BY p_brand) AS s WHERE s.n > 3", "part")


@query("SELECT p_partkey, CASE WHEN p_size >= 25 THEN 'large' ELSE 'small' END || ':' || p_brand AS label FROM part")
def macro_function(spark, d):
    context = Context(spark, tables={"part": CellFrame.wrap(table(spark, d, "part")).df})
    body = N.parse_expression("CASE WHEN size >= least THEN 'large' ELSE 'small' END || ':' || brand")
    context.macros["labels.size_label"] = Macro("labels.size_label", [("size", "INT"), ("brand", "STRING"), ("least", "INT")], body)
    return lower_query(N.parse_query("SELECT p_partkey, labels.size_label(p_size, brand = p_brand, least = 25) AS label FROM part"), context).unwrap()


@query("SELECT event_type, count(*) AS n, count(*) FILTER (k >= 50) AS high, CAST(sum(k) AS BIGINT) AS total FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) GROUP BY event_type")
def recipe_json_group(spark, d):
    return recipe(
        spark, d,
        """WITH p AS (SELECT event_type, CAST(parse_json(props)['k'] AS INT) AS k FROM events)
           SELECT event_type, COUNT(*) AS n, COUNT(*) FILTER (WHERE k >= 50) AS high, SUM(k) AS total FROM p GROUP BY event_type""",
        "events",
    )


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey >= 1490")
def recipe_declared_input(spark, d):
    return recipe(spark, d, "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey >= least_key", "orders", least_key=1490)


@query("SELECT n_nationkey, CAST(json_object('name', n_name) AS VARCHAR) AS doc, '[1,' || n_nationkey || ']' AS arr FROM nation")
def recipe_literals(spark, d):
    out = recipe(spark, d, "SELECT n_nationkey, {'name': n_name} AS doc, [1, n_nationkey] AS arr FROM nation", "nation")
    return out.select("n_nationkey", F.to_json("doc").alias("doc"), F.to_json("arr").alias("arr"))


@query("SELECT construct, true AS rejected FROM (VALUES ('cross'), ('using'), ('natural'), ('semi'), ('theta'), ('frame'), ('rollup'), ('cube'), ('sets'), ('pivot'), ('lateral'), ('scalar'), ('qualify'), ('field')) AS t(construct)")
def rejected_constructs(spark, d):
    texts = {
        "cross": "SELECT a FROM t CROSS JOIN u", "using": "SELECT a FROM t JOIN u USING (k)", "natural": "SELECT a FROM t NATURAL JOIN u", "semi": "SELECT a FROM t LEFT SEMI JOIN u ON t.k = u.k",
        "theta": "SELECT a FROM t JOIN u ON t.k < u.k", "frame": "SELECT sum(a) OVER (ORDER BY b ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) FROM t", "rollup": "SELECT a FROM t GROUP BY ROLLUP (a)",
        "cube": "SELECT a FROM t GROUP BY CUBE (a)", "sets": "SELECT a FROM t GROUP BY GROUPING SETS ((a), ())", "pivot": "SELECT * FROM t PIVOT (sum(a) FOR b IN (1, 2))",
        "lateral": "SELECT x FROM t LATERAL VIEW explode(a) e AS x", "scalar": "SELECT (SELECT 1) AS x FROM t", "qualify": "SELECT a FROM t QUALIFY a = 1", "field": "SELECT a.metadata.errors FROM t",
    }
    rows = []
    for name, text in texts.items():
        try:
            check_query(N.parse_query(text))
            rows.append((name, False))
        except ScriptError:
            rows.append((name, True))
    return spark.createDataFrame(rows, "construct string, rejected boolean")


# --- publications, manifests ---------------------------------------------------------------------------------------

_METRICS = """
    SELECT 'mean_price' AS metric, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE count(*) END AS value, o_orderstatus FROM orders GROUP BY o_orderstatus
"""


@query(f"SELECT metric, CAST(value AS DOUBLE) AS value, o_orderstatus AS status FROM ({_METRICS}) WHERE value IS NOT NULL")
def metric_report_rows(spark, d):
    o = table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    o = o.select(F.lit("mean_price").alias("metric"), F.when(F.col("o_orderstatus") != "P", F.col("n")).alias("value"), "o_orderstatus")
    metrics, _ = reports.metric_rows(CellFrame.wrap(o).df)
    return metrics.select("metric", "value", F.col("tags")["o_orderstatus"].alias("status"))


@query(f"SELECT 'Metric row not published' AS title, 'medium' AS severity, 'metric ' || metric AS detail FROM ({_METRICS}) WHERE value IS NULL")
def metric_issue_rows(spark, d):
    o = table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    o = o.select(F.lit("mean_price").alias("metric"), F.when(F.col("o_orderstatus") != "P", F.col("n")).alias("value"), "o_orderstatus")
    _, issues = reports.metric_rows(CellFrame.wrap(o).df)
    return issues


@query("SELECT r_name AS title, CASE WHEN r_regionkey = 0 THEN 'high' ELSE 'info' END AS severity FROM region")
def issue_report_rows(spark, d):
    r = table(spark, d, "region").select(F.col("r_name").alias("title"), F.when(F.col("r_regionkey") == 0, " HIGH ").otherwise("odd").alias("severity"))
    return reports.issue_rows(CellFrame.wrap(r).df)


@query("""
    SELECT task_id, CASE WHEN n0 >= 2 THEN 'a' WHEN n1 >= 2 THEN 'b' END AS result, n0 >= 2 OR n1 >= 2 AS agreed
    FROM (SELECT vec_id // 3 AS task_id, count(*) FILTER (label % 2 = 0) AS n0, count(*) FILTER (label % 2 = 1) AS n1 FROM (SELECT DISTINCT vec_id, label FROM embeddings) GROUP BY 1)
""")
def annotation_consensus(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label").distinct()
    reviews = e.select(F.floor(F.col("vec_id") / 3).alias("task_id"), F.when(F.col("label") % 2 == 0, "a").otherwise("b").alias("result"), F.col("vec_id").alias("submitted_at"))
    return reports.consensus(reviews, "majority", 3)


@query("SELECT 'CAST_ERROR' AS code, 'bad' AS column_name, (SELECT count(*) FROM events) AS n_cells, (SELECT count(*) FROM events) AS n_rows, (SELECT count(*) FROM events) AS n_bad_rows")
def stage_error_summary(spark, d):
    e = CellFrame.wrap(table(spark, d, "events").select("event_id", "event_type"))
    s = M.error_summary(e.select({"event_id": e["event_id"], "bad": A.cast(e["event_type"], "int")}).df)
    rows = [(code, column, s["cell_error_count"], s["row_count"], s["row_error_count"]) for code in s["by_code"] for column in s["by_column"]]
    return spark.createDataFrame(rows, "code string, column_name string, n_cells bigint, n_rows bigint, n_bad_rows bigint")


@query("SELECT n, name FROM (VALUES (1, 'orders'), (2, 'late'), (3, 'counts')) AS t(n, name)")
def recipe_step_order(spark, d):
    text = "CREATE BATCH TABLE counts SELECT COUNT(*) AS n FROM late; CREATE BATCH TABLE late SELECT o_orderkey FROM orders; LOAD orders FROM 'orders.parquet';"
    _, steps = engine.validate(text)
    return spark.createDataFrame([(i, s.makes) for i, s in enumerate(steps, 1)], "n int, name string")


@query("SELECT a AS from_node, b AS to_node FROM (VALUES ('orders', 'late'), ('least', 'late')) AS t(a, b)")
def recipe_graph_edges(spark, d):
    statements, _ = engine.validate("DECLARE INPUT least INT DEFAULT 3; LOAD orders FROM 'o.parquet'; CREATE BATCH TABLE late SELECT o_orderkey FROM orders WHERE o_custkey > least;")
    return spark.createDataFrame([(e["from"], e["to"]) for e in recipe_graph(statements)["edges"]], "from_node string, to_node string")


@query("SELECT c_mktsegment, count(*) AS n, 0 AS n_errors FROM customer GROUP BY c_mktsegment")
def recipe_run(spark, d):
    """A whole run: load, batch table, dataset; the published values and the manifest's error count."""
    folder = scratch(spark, "run")
    text = f"LOAD customer FROM '{d}/customer.parquet' WITH FORMAT = 'parquet'; CREATE BATCH TABLE segments SELECT c_mktsegment, COUNT(*) AS n FROM customer GROUP BY c_mktsegment; PUBLISH segments TO DATASET 'segments';"
    result = engine.run(spark, text, engine.Settings(folder))
    n = result.manifests["segments"].errors["cell_error_count"]
    return spark.read.parquet(f"{folder}/datasets/segments").withColumn("n_errors", F.lit(n))


@query("SELECT k, n_name, n_regionkey, form FROM (SELECT n_nationkey AS k, n_name, n_regionkey FROM nation), (VALUES ('csv'), ('jsonl'), ('parquet')) AS t(form)")
def source_formats(spark, d):
    folder, n = scratch(spark, "formats"), table(spark, d, "nation").withColumnRenamed("n_nationkey", "k")
    out = None
    for form in ("csv", "jsonl", "parquet"):
        sinks.save(n, f"{folder}/t.{form}", form)
        back = readers.read(spark, f"{folder}/t.{form}", {"FORMAT": form}).select(F.col("k").cast("int"), "n_name", F.col("n_regionkey").cast("int"), F.lit(form).alias("form"))
        out = back if out is None else out.unionAll(back)
    return out


# --- streams -----------------------------------------------------------------------------------------------------------


def _event_stream(spark: SparkSession, d: str, folder: str, files: int = 3) -> DataFrame:
    """The events, in order of time, as a stream of several files; TIMESTAMP, since watermarks need it."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    e.repartitionByRange(files, "ts").write.mode("overwrite").parquet(f"{folder}/in")
    return streams.source(spark, f"{folder}/in", 1)


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE event_type = 'click'")
def stream_append(spark, d):
    folder = scratch(spark, "append")
    context = Context(spark, tables={"events": _event_stream(spark, d, folder)})
    out = lower_query(N.parse_query("SELECT event_id, CAST(parse_json(props)['k'] AS INT) AS k FROM events WHERE event_type = 'click'"), context).df
    streams.drain(out, f"{folder}/out", f"{folder}/checkpoint")
    return CellFrame(spark.read.parquet(f"{folder}/out")).unwrap()


@query("SELECT count(*) AS n_rows, true AS several_batches FROM nation")
def stream_batchsize(spark, d):
    folder, sizes = scratch(spark, "batchsize"), []
    streams.in_batches(table(spark, d, "nation"), f"{folder}/in", 10, "n_nationkey")
    streams.drain(streams.source(spark, f"{folder}/in", 1), f"{folder}/out", f"{folder}/checkpoint", listener=sizes)
    return spark.read.parquet(f"{folder}/out").agg(F.count(F.lit(1)).alias("n_rows")).withColumn("several_batches", F.lit(len([s for s in sizes if s]) >= 3))


@query("SELECT count(*) AS n_rows, count(DISTINCT n_nationkey) AS n_keys FROM nation")
def stream_checkpoint_resume(spark, d):
    """A second run over the same checkpoint takes only the rows that are new."""
    folder, n = scratch(spark, "resume"), table(spark, d, "nation")
    for part in (n.where("n_nationkey < 10"), n.where("n_nationkey >= 10")):
        part.write.mode("append").parquet(f"{folder}/in")
        streams.drain(streams.source(spark, f"{folder}/in"), f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/out").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("n_nationkey").alias("n_keys"))


@query("SELECT CAST(date_trunc('day', ts) AS DATE)::VARCHAR AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_tumbling(spark, d):
    folder = scratch(spark, "tumbling")
    s = streams.tumbling(_event_stream(spark, d, folder), "ts", "1 day", ["event_type"], [F.count(F.lit(1)).alias("n")])
    out = streams.drain_to_table(s, "complete", folder=folder)
    return out.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("""
    SELECT user_id, count(*) AS n_sessions, sum(n) AS n_events FROM (
        SELECT user_id, s, count(*) AS n FROM (
            SELECT user_id, ts, sum(CASE WHEN before IS NULL OR ts - before >= INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s
            FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events)) GROUP BY user_id, s) GROUP BY user_id
""")
def stream_session(spark, d):
    folder = scratch(spark, "session")
    s = streams.sessions(_event_stream(spark, d, folder), "ts", "6 hours", ["user_id"], [F.count(F.lit(1)).alias("n")])
    out = streams.drain_to_table(s, "complete", folder=folder)
    return out.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_sessions"), F.sum("n").alias("n_events"))
