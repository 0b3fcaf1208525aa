"""Whole recipes over the driver's tables: stages that are loaded, stored as cells and read again.

Queries of the other modules wrap their tables in place; these run LOAD and CREATE TABLE through the engine, as users
do, in wrapped mode, in non-strict mode (constructs that recipes refuse by default) and in plain mode (Spark SQL
over stages without cells).
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cells.frame import CellFrame
from ..engine import run as engine
from ..functions.registry import TEST_FUNCTIONS, Function, Registry, parameters
from ..session import scratch
from ..sources import files
from ..streaming import stages as streams

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(fn):
        QUERIES[name or fn.__name__] = fn
        if sql:
            ORACLE[name or fn.__name__] = sql
        return fn

    return register


def counting_agent(request: dict, state: dict, environments: dict, turn: int) -> dict:
    """Test callback: answers with the number asked for and the turn."""
    return {"response": request["n"] * 100 + turn, "state": {"last": turn}}


def patient_user(response: int, state: dict) -> dict:
    """Test callback: asks again until the agent has answered n % 3 + 1 times."""
    n = response // 100
    return {"request": {"n": n}, "terminate": len(state["turns"]) > n % 3}


def note(event: dict, state: dict) -> dict:
    """Test observer: how many turns there have been."""
    return {"observation": len(state["turns"]), "artifacts": [event["schedule"]]}


def registry() -> Registry:
    r = Registry()
    for f in TEST_FUNCTIONS:
        r.add(f)
    for fn, params in ((counting_agent, "request variant, state variant, environments variant, turn int"), (patient_user, "response variant, state variant"), (note, "event variant, state variant")):
        r.add(Function(f"local.{fn.__name__}", parameters(params), "variant", fn))
    return r


@query("""
    SELECT n_nationkey, n_nationkey % 3 + 1 <= 2 AS ok, CASE WHEN n_nationkey % 3 < 2 THEN 'completed' ELSE 'max_turns' END AS status, least(n_nationkey % 3 + 1, 2) AS n_turns,
           n_nationkey * 100 + 1 AS first_response, least(n_nationkey % 3 + 1, 2) + 1 AS n_observed FROM nation
""")
def simulation_run(spark, d):
    """Dialogues of two project functions with an observer, of two turns at most."""
    return made(
        spark, d,
        """CREATE BATCH TABLE ran SELECT n_nationkey, simulators.run(input = parse_json('{"n":' || n_nationkey || '}'), user = local.patient_user, agent = local.counting_agent,
             observers = parse_json('[{"spec_type":"simulator_observer","callback":"local.note","schedule":["after_turn","final"],"config":{}}]'), limits = simulators.limits(max_turns = 2)) AS r FROM nation;
           CREATE BATCH TABLE made SELECT n_nationkey, CAST(r['ok'] AS BOOLEAN) AS ok, CAST(r['status'] AS STRING) AS status, array_size(r['turns']) AS n_turns,
             CAST(r['turns'][0]['response'] AS INT) AS first_response, array_size(r['observations']) AS n_observed FROM ran;""",
        "nation",
    )


def stages(spark: SparkSession, d: str, text: str, *tables: str, **settings) -> tuple[engine.Result, str]:
    """Run LOADs of the named tables and the recipe; its result and folder."""
    folder = scratch(spark, "recipe")
    loads = "".join(f"LOAD {t} FROM '{d}/{t}.parquet' WITH FORMAT = 'parquet';\n" for t in tables)
    result = engine.run(spark, loads + text, engine.Settings(folder, **settings), registry())
    if result.failed:
        raise RuntimeError(str(result.failed))
    return result, folder


def made(spark: SparkSession, d: str, text: str, *tables: str, **settings) -> DataFrame:
    """The values of the table `made` of a recipe."""
    result, _ = stages(spark, d, text, *tables, **settings)
    return CellFrame(spark.read.parquet(result.tables["made"])).unwrap()


def recipe_query(name: str, select: str, sql: str | None = None, tables: str = "", options: str = "", kind: str = "BATCH", **settings) -> None:
    """Register a query that is one CREATE TABLE over loaded tables; without SQL of its own its text is SQL already."""

    def fn(spark: SparkSession, d: str) -> DataFrame:
        return made(spark, d, f"CREATE {kind} TABLE made {options} {select};", *tables.split(), **settings)

    fn.__name__ = name
    query(sql or select, name)(fn)


# --- stored cells ---------------------------------------------------------------------------------------------------

recipe_query("stored_join", "SELECT o.o_orderkey, c.c_custkey, c.c_mktsegment FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey", tables="orders customer")
recipe_query("stored_left_join", "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey", tables="orders customer")
recipe_query("stored_right_join", "SELECT c.c_custkey, o.o_orderkey FROM orders o RIGHT JOIN customer c ON c.c_custkey = o.o_custkey", tables="orders customer")
recipe_query("stored_full_join", "SELECT c.c_custkey, s.s_suppkey, s.s_name FROM customer c FULL JOIN supplier s ON c.c_custkey = s.s_suppkey * 2", tables="customer supplier")
recipe_query(
    "stored_multi_join",
    """SELECT n.n_name, COUNT(*) AS n, SUM(l.l_linenumber) AS line_sum FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
       JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN customer c ON o.o_custkey = c.c_custkey AND s.s_nationkey = c.c_nationkey
       JOIN nation n ON s.s_nationkey = n.n_nationkey GROUP BY n.n_name""",
    tables="lineitem orders supplier customer nation",
)
recipe_query("stored_expression_key", "SELECT COUNT(*) AS n FROM customer a JOIN nation b ON lower(a.c_mktsegment) || a.c_nationkey = 'building' || b.n_nationkey", tables="customer nation")
recipe_query("stored_filter", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey >= 100 AND o_orderstatus = 'F'", tables="orders")
recipe_query("stored_group", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, SUM(l_linenumber) AS line_sum, MAX(l_extendedprice) AS most FROM lineitem GROUP BY l_returnflag, l_linestatus", tables="lineitem")
recipe_query(
    "stored_window",
    "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate) AS rk FROM orders ORDER BY o_orderkey",
    tables="orders",
)
recipe_query("stored_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders", tables="orders")
recipe_query("stored_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey AS k FROM supplier", tables="customer supplier")
recipe_query(
    "stored_errored_join",
    "SELECT s.row_id, err_or(CAST(s.score_text AS BIGINT), -1) AS score, n.n_name FROM scores s JOIN nation n ON err_or(CAST(s.score_text AS BIGINT), -1) = n.n_nationkey",
    """SELECT row_id, score, n_name FROM (SELECT row_id, CASE WHEN score_text IS NULL THEN NULL WHEN regexp_full_match(trim(score_text), '[+-]?[0-9]+') THEN coalesce(TRY_CAST(trim(score_text) AS BIGINT), -1) ELSE -1 END AS score
       FROM scores) JOIN nation ON score = n_nationkey""",
    tables="scores nation",
)
recipe_query("recipe_order_first", "SELECT o_orderpriority, COUNT(*) AS n FROM orders GROUP BY o_orderpriority ORDER BY lower(o_orderpriority) LIMIT 4", tables="orders")
recipe_query("recipe_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 15", tables="orders")
recipe_query(
    "recipe_variant_slice", "SELECT event_id, to_json(parse_json('[1,2,3,' || event_id || ']')[1:3]) AS part, array_size(split(event_type, 'i')[1:9]) AS n FROM events",
    "SELECT event_id, '[2,3]' AS part, CAST(greatest(len(string_split(event_type, 'i')) - 1, 0) AS INTEGER) AS n FROM events", tables="events",
)
recipe_query(
    "recipe_aggregates",
    """SELECT l_returnflag, ROUND(AVG(l_quantity), 6) AS mean, ROUND(STDDEV_SAMP(l_quantity), 6) AS spread, ROUND(VAR_POP(l_discount), 9) AS var, ROUND(CORR(l_quantity, l_extendedprice), 6) AS corr,
              BOOL_AND(l_quantity > 0) AS all_some, BOOL_OR(l_quantity > 49) AS any_many, BIT_OR(l_linenumber) AS bits, COUNT(DISTINCT l_suppkey) AS suppliers, MIN_BY(l_orderkey, l_orderkey * 10 + l_linenumber) AS first_key,
              MAX_BY(l_linenumber, l_orderkey * 10 + l_linenumber) AS last_line, COUNT(*) * 2 + 1 AS nested FROM lineitem GROUP BY l_returnflag HAVING COUNT(*) > 10""",
    """SELECT l_returnflag, ROUND(AVG(l_quantity), 6) AS mean, ROUND(STDDEV_SAMP(l_quantity), 6) AS spread, ROUND(VAR_POP(l_discount), 9) AS var, ROUND(CORR(l_quantity, l_extendedprice), 6) AS corr,
              BOOL_AND(l_quantity > 0) AS all_some, BOOL_OR(l_quantity > 49) AS any_many, BIT_OR(l_linenumber) AS bits, COUNT(DISTINCT l_suppkey) AS suppliers, ARG_MIN(l_orderkey, l_orderkey * 10 + l_linenumber) AS first_key,
              ARG_MAX(l_linenumber, l_orderkey * 10 + l_linenumber) AS last_line, COUNT(*) * 2 + 1 AS nested FROM lineitem GROUP BY l_returnflag HAVING COUNT(*) > 10""",
    tables="lineitem",
)
recipe_query(
    "recipe_windows",
    """SELECT o_orderkey, nth_value(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS second, SUM(o_custkey) OVER (PARTITION BY o_orderstatus) AS total,
              COUNT(*) OVER (PARTITION BY o_orderpriority) AS n, lag(o_orderkey, 1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders""",
    tables="orders",
)
recipe_query("recipe_struct_star", "SELECT t.*, named_struct('a', n_nationkey, 'b', n_name).b AS name_again FROM nation t", "SELECT *, n_name AS name_again FROM nation", tables="nation")
recipe_query("recipe_variant_path", "SELECT event_id, CAST(parse_json(props):k AS INT) AS k, CAST(parse_json('{\"a\": {\"b\": [7]}}'):a.b[0] AS INT) = 7 AS deep FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, true AS deep FROM events", tables="events")  # noqa: E501
recipe_query("recipe_triple_quotes", 'SELECT n_nationkey, """it\'s""" || n_name AS label FROM nation', "SELECT n_nationkey, 'it''s' || n_name AS label FROM nation", tables="nation")
recipe_query("recipe_explode_outer", "SELECT doc_id, explode_outer(split(recipe, '_')) AS word FROM documents", "SELECT doc_id, unnest(coalesce(string_split(recipe, '_'), [NULL])) AS word FROM documents", tables="documents")


@query("SELECT n_nationkey, CAST(NULL AS INTEGER) AS number, true AS is_err, 'CAST_ERROR' AS code FROM nation")
def macro_errors(spark, d):
    """What goes wrong inside a macro's body is an error of the call's cell."""
    text = """CREATE FUNCTION l.f(x STRING) RETURNS INT RETURN CAST(x AS INT);
              CREATE BATCH TABLE made SELECT n_nationkey, l.f(n_name) AS number, is_err(l.f(n_name)) AS is_err FROM nation;"""
    result, _ = stages(spark, d, text, "nation")
    f = CellFrame(spark.read.parquet(result.tables["made"]))
    return f.df.select("n_nationkey.value", "number.value", "is_err.value", f.first_code("number").alias("code")).toDF("n_nationkey", "number", "is_err", "code")


@query("SELECT count(*) AS n_rows, count(*) AS n_timed, count(*) AS n_null, true AS aggregate_is_null FROM customer")
def latency_helper(spark, d):
    """A Python call in one stage, its time in the next: literals, derived values and aggregates have none."""
    return made(
        spark, d,
        """CREATE BATCH TABLE called SELECT c_custkey, length(c_mktsegment) AS size, normalize_text(text = c_mktsegment) AS norm FROM customer;
           CREATE BATCH TABLE timed SELECT c_custkey, size, latency(norm) IS NOT NULL AND latency(norm) >= 0 AS has_time,
                  latency('x') IS NULL AND latency(size + 1) IS NULL AND latency(c_custkey) IS NULL AS no_time FROM called;
           CREATE BATCH TABLE made SELECT COUNT(*) AS n_rows, SUM(CASE WHEN has_time THEN 1 ELSE 0 END) AS n_timed, SUM(CASE WHEN no_time THEN 1 ELSE 0 END) AS n_null,
                  latency(AVG(size)) IS NULL AS aggregate_is_null FROM timed;""",
        "customer",
    )


@query("SELECT 'ok' AS status, 'normalize_text' AS name, count(*) AS n FROM nation")
def call_trace(spark, d):
    result, _ = stages(spark, d, "CREATE BATCH TABLE made SELECT normalize_text(n_name) AS norm FROM nation;", "nation")
    t = spark.read.parquet(result.tables["made"]).select("norm.metadata.trace.*")
    return t.groupBy("status", F.col("function_name").alias("name")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT name, n, n AS n_ids, 0 AS n_null FROM (SELECT 'loaded' AS name, 2 * count(*) AS n FROM orders UNION ALL SELECT 'batch', count(*) FROM orders UNION ALL SELECT 'stream', 2 * count(*) FROM orders)")
def cell_ids(spark, d):
    """Every cell of every kind of stage has an id of its own; equal rows of loads and batch tables differ in theirs."""
    text = """CREATE BATCH TABLE batch SELECT o_orderstatus FROM loaded; CREATE STREAM TABLE stream SELECT o_orderkey, o_orderstatus FROM loaded;"""
    folder = scratch(spark, "ids")
    spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_orderstatus").write.parquet(f"{folder}/orders")
    result = engine.run(spark, f"LOAD loaded FROM '{folder}/orders' WITH FORMAT = 'parquet'; {text}", engine.Settings(f"{folder}/run"))
    out = None
    for name in ("loaded", "batch", "stream"):
        df = spark.read.parquet(result.tables[name])
        ids = df.select(F.explode(F.array(*[F.col(f"{c}.cell_id") for c in df.columns])).alias("id"))
        one = ids.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("n_ids"), F.count_if(F.col("id").isNull()).cast("int").alias("n_null")).select(F.lit(name).alias("name"), "*")
        out = one if out is None else out.unionAll(one)
    return out


@query("SELECT count(*) AS n_rows, count(DISTINCT o_orderkey) AS n_keys FROM (SELECT o_orderkey FROM orders LIMIT 7)")
def load_limit(spark, d):
    """LOAD ... LIMIT n, here of a declared input; which rows they are is open."""
    folder = scratch(spark, "limit")
    text = f"DECLARE INPUT n INT DEFAULT 7; LOAD made FROM '{d}/orders.parquet' LIMIT n;"
    result = engine.run(spark, text, engine.Settings(folder))
    return CellFrame(spark.read.parquet(result.tables["made"])).unwrap().agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("o_orderkey").alias("n_keys"))


@query("SELECT event_id, upper(event_type) AS kind FROM events WHERE event_type <> 'view'")
def stored_stream(spark, d):
    """CREATE STREAM TABLE over a loaded stage, in small batches."""
    return made(spark, d, "CREATE STREAM TABLE made OPTIONS (BATCH_SIZE = 5000) SELECT event_id, upper(event_type) AS kind FROM events WHERE event_type <> 'view';", "events")


# --- constructs that strict recipes refuse --------------------------------------------------------------------------

LOOSE = {
    "semi": ("SELECT c.c_custkey FROM customer c LEFT SEMI JOIN orders o ON c.c_custkey = o.o_custkey", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)", "customer orders"),
    "anti": ("SELECT c.c_custkey FROM customer c LEFT ANTI JOIN supplier s ON c.c_custkey = s.s_suppkey", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)", "customer supplier"),
    "cross": ("SELECT a.r_name AS a, b.r_name AS b FROM region a CROSS JOIN region b", None, "region"),
    "theta": ("SELECT a.n_name AS a, b.r_name AS b FROM nation a JOIN region b ON a.n_regionkey < b.r_regionkey", None, "nation region"),
    "mixed": ("SELECT a.n_name AS a, b.n_name AS b FROM nation a LEFT JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", None, "nation"),
    "using": ("SELECT k, a, b FROM (SELECT n_regionkey AS k, n_name AS a FROM nation) x JOIN (SELECT r_regionkey AS k, r_name AS b FROM region) y USING (k)", None, "nation region"),
    "natural": ("SELECT * FROM (SELECT n_regionkey AS k, n_name AS a FROM nation) x NATURAL JOIN (SELECT r_regionkey AS k, r_name AS b FROM region) y", None, "nation region"),
    "full_using": ("SELECT k, a, b FROM (SELECT n_nationkey AS k, n_name AS a FROM nation) x FULL JOIN (SELECT r_regionkey + 23 AS k, r_name AS b FROM region) y USING (k)", None, "nation region"),
    "rollup": ("SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)", None, "lineitem"),
    "cube": ("SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)", None, "lineitem"),
    "sets": ("SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())", None, "lineitem"),
    "qualify": ("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1", None, "orders"),
    "frames": ("SELECT event_id, SUM(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS last3 FROM events", None, "events"),
    "lateral": ("SELECT n_nationkey, x FROM nation LATERAL VIEW explode(array(1, 2)) t AS x", "SELECT n_nationkey, x FROM nation, (VALUES (1), (2)) AS t(x)", "nation"),
    "intersect": ("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey AS k FROM supplier", None, "customer supplier"),
    "except_all": ("SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey AS k FROM supplier", None, "customer supplier"),
}
for _name, (_text, _sql, _tables) in LOOSE.items():
    recipe_query(f"loose_{_name}", _text, _sql, _tables, strict=False)

# --- plain mode -----------------------------------------------------------------------------------------------------

PLAIN = {
    "semi": ("SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON o_custkey = c_custkey", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)", "customer orders"),
    "anti": ("SELECT c_custkey FROM customer LEFT ANTI JOIN (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT') o ON o_custkey = c_custkey",
             "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')", "customer orders"),
    "theta": ("SELECT a.n_name AS a, b.r_name AS b FROM nation a JOIN region b ON a.n_regionkey < b.r_regionkey", None, "nation region"),
    "cross": ("SELECT a.r_name AS a, b.r_name AS b FROM region a CROSS JOIN region b", None, "region"),
    "using": ("SELECT k, n_name, r_name FROM (SELECT n_regionkey AS k, n_name FROM nation) a JOIN (SELECT r_regionkey AS k, r_name FROM region) b USING (k)", None, "nation region"),
    "natural": ("SELECT * FROM (SELECT n_regionkey AS k, n_name FROM nation) a NATURAL JOIN (SELECT r_regionkey AS k, r_name FROM region) b", None, "nation region"),
    "rollup": ("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)", None, "lineitem"),
    "cube": ("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)", None, "lineitem"),
    "grouping_sets": ("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())", None, "lineitem"),
    "pivot": ("SELECT * FROM (SELECT l_returnflag, l_linestatus FROM lineitem) PIVOT (count(*) FOR l_linestatus IN ('F', 'O'))",
              "SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS \"F\", count(*) FILTER (l_linestatus = 'O') AS \"O\" FROM lineitem GROUP BY l_returnflag", "lineitem"),
    "unpivot": ("SELECT * FROM (SELECT r_regionkey, r_name FROM region) UNPIVOT (v FOR field IN (r_name))", "SELECT r_regionkey, 'r_name' AS field, r_name AS v FROM region", "region"),
    "frames": ("""SELECT event_id, sum(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS last3,
                  count(*) OVER (PARTITION BY event_type ORDER BY event_id RANGE BETWEEN 100 PRECEDING AND 100 FOLLOWING) AS near FROM events""", None, "events"),
    "intersect": ("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey AS k FROM supplier", None, "customer supplier"),
    "intersect_all": ("SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey AS k FROM supplier", None, "customer supplier"),
    "except": ("SELECT c_custkey AS k FROM customer EXCEPT SELECT s_suppkey AS k FROM supplier", None, "customer supplier"),
    "except_all": ("SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey AS k FROM supplier", None, "customer supplier"),
    "scalar": ("SELECT n_nationkey, (SELECT max(r_regionkey) FROM region) - n_regionkey AS gap FROM nation WHERE n_regionkey < (SELECT max(r_regionkey) FROM region)", None, "nation region"),
    "exists": ("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')", None, "customer orders"),
    "lateral": ("SELECT n_nationkey, x FROM nation LATERAL VIEW explode(array(1, 2)) t AS x", "SELECT n_nationkey, x FROM nation, (VALUES (1), (2)) AS t(x)", "nation"),
    "recursive": ("WITH RECURSIVE steps(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM steps WHERE n < 12) SELECT n, r_name FROM steps JOIN region ON n % 5 = r_regionkey", None, "region"),
    "order_offset": ("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5", None, "orders"),
}
for _name, (_text, _sql, _tables) in PLAIN.items():
    recipe_query(f"plain_{_name}", _text, _sql, _tables, wrapped=False)


@query("SELECT n_nationkey, lower(n_name) AS norm, CASE WHEN n_nationkey >= 10 THEN 'high' ELSE 'low' END AS size FROM nation WHERE n_regionkey >= 1")
def plain_calls(spark, d):
    """Declared inputs, macros and Python functions in plain mode."""
    return made(
        spark, d,
        """DECLARE INPUT least INT DEFAULT 1; CREATE FUNCTION m.size(k INT) RETURNS STRING RETURN CASE WHEN k >= 10 THEN 'high' ELSE 'low' END;
           CREATE BATCH TABLE made SELECT n_nationkey, normalize_text(n_name) AS norm, m.size(k = n_nationkey) AS size FROM nation WHERE n_regionkey >= least;""",
        "nation", wrapped=False,
    )


# --- names that pass through to Spark -------------------------------------------------------------------------------

recipe_query(
    "recipe_more_aggregates",
    """SELECT o_orderpriority, COUNT_IF(o_orderstatus = 'F') AS n_f, BIT_AND(o_orderkey) AS b_and, BIT_XOR(o_orderkey) AS b_xor, ROUND(COVAR_POP(o_custkey, o_orderkey), 3) AS cov_p,
              ROUND(COVAR_SAMP(o_custkey, o_orderkey), 3) AS cov_s, ROUND(MEDIAN(o_custkey), 3) AS middle, ROUND(PERCENTILE(o_custkey, 0.25), 3) AS quarter, REGR_COUNT(o_custkey, o_orderkey) AS pairs,
              ROUND(VAR_SAMP(o_custkey), 2) AS var_s, ROUND(STDDEV_POP(o_custkey), 4) AS dev_p, EVERY(o_custkey > 0) AS every_one, SOME(o_custkey = 1) AS some_one, MIN(o_orderdate) AS first_day,
              array_size(ARRAY_AGG(o_orderkey)) AS n_items, array_size(COLLECT_SET(o_orderstatus)) AS n_states, ANY_VALUE(o_orderpriority) AS any_p, MEAN(o_custkey) = AVG(o_custkey) AS same FROM orders GROUP BY o_orderpriority""",
    """SELECT o_orderpriority, COUNT_IF(o_orderstatus = 'F') AS n_f, BIT_AND(o_orderkey) AS b_and, BIT_XOR(o_orderkey) AS b_xor, ROUND(COVAR_POP(o_custkey, o_orderkey), 3) AS cov_p,
              ROUND(COVAR_SAMP(o_custkey, o_orderkey), 3) AS cov_s, ROUND(MEDIAN(o_custkey), 3) AS middle, ROUND(QUANTILE_CONT(o_custkey, 0.25), 3) AS quarter, REGR_COUNT(o_custkey, o_orderkey) AS pairs,
              ROUND(VAR_SAMP(o_custkey), 2) AS var_s, ROUND(STDDEV_POP(o_custkey), 4) AS dev_p, BOOL_AND(o_custkey > 0) AS every_one, BOOL_OR(o_custkey = 1) AS some_one, MIN(o_orderdate) AS first_day,
              CAST(COUNT(*) AS INTEGER) AS n_items, CAST(COUNT(DISTINCT o_orderstatus) AS INTEGER) AS n_states, o_orderpriority AS any_p, true AS same FROM orders GROUP BY o_orderpriority""",
    tables="orders",
)
recipe_query(
    "recipe_math_names",
    """SELECT c_custkey, abs(-c_custkey) AS a, ceil(c_acctbal) AS c, floor(c_acctbal) AS f, round(sqrt(c_custkey), 6) AS s, round(ln(c_custkey + 1), 6) AS l, round(log10(c_custkey + 1), 6) AS l10, round(power(c_nationkey, 2), 6) AS p,
              sign(c_nationkey - 5) AS sg, round(degrees(c_nationkey), 6) AS dg, round(sin(c_custkey), 6) AS sn, round(cos(c_custkey), 6) AS cs, round(atan2(c_custkey, 7), 6) AS at, greatest(c_nationkey, 7) AS g,
              least(c_nationkey, 7) AS ls, round(cbrt(c_custkey), 6) AS cb, round(pi(), 6) AS pi, round(exp(c_nationkey / 10.0), 6) AS e FROM customer""",
    tables="customer",
)
recipe_query(
    "recipe_string_names",
    """SELECT c_custkey, left(c_name, 3) AS l, right(c_name, 3) AS r, rpad(c_mktsegment, 12, '.') AS rp, ltrim('  ' || c_mktsegment) AS lt, rtrim(c_mktsegment || '  ') AS rt, split_part(c_name, '#', 2) AS part,
              char_length(c_name) AS n, concat(c_name, '-', c_mktsegment) AS both, replace(c_name, '0', 'o') AS o, upper(substring(c_mktsegment, 2, 3)) AS up, c_mktsegment LIKE 'B%' AS b, c_name RLIKE '1$' AS one,
              coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS seg, CASE c_nationkey WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE 'many' END AS words FROM customer""",
    """SELECT c_custkey, left(c_name, 3) AS l, right(c_name, 3) AS r, rpad(c_mktsegment, 12, '.') AS rp, ltrim('  ' || c_mktsegment) AS lt, rtrim(c_mktsegment || '  ') AS rt, split_part(c_name, '#', 2) AS part,
              length(c_name) AS n, concat(c_name, '-', c_mktsegment) AS both, replace(c_name, '0', 'o') AS o, upper(substring(c_mktsegment, 2, 3)) AS up, c_mktsegment LIKE 'B%' AS b, regexp_matches(c_name, '1$') AS one,
              coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS seg, CASE c_nationkey WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE 'many' END AS words FROM customer""",
    tables="customer",
)
recipe_query(
    "recipe_date_names",
    """SELECT event_id, year(ts) AS y, month(ts) AS m, day(ts) AS d, hour(ts) AS h, minute(ts) AS mi, quarter(ts) AS q, dayofyear(ts) AS doy, last_day(ts) AS ld, CAST(ts AS DATE) AS dt,
              ts >= TIMESTAMP_NTZ '2024-01-15 00:00:00' AS late, datediff(CAST(ts AS DATE), DATE '2024-01-01') AS days FROM events""",
    """SELECT event_id, year(ts) AS y, month(ts) AS m, day(ts) AS d, hour(ts) AS h, minute(ts) AS mi, quarter(ts) AS q, dayofyear(ts) AS doy, last_day(ts) AS ld, CAST(ts AS DATE) AS dt,
              ts >= TIMESTAMP '2024-01-15 00:00:00' AS late, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS days FROM events""",
    tables="events",
)


# --- what a run leaves behind ----------------------------------------------------------------------------------------


@query("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority ORDER BY n DESC, o_orderpriority LIMIT 3")
def report_chart(spark, d):
    """A CHART's rows: sorted and limited as its options say, the aggregation only noted."""
    text = """CREATE BATCH TABLE counts SELECT o_orderpriority, COUNT(*) AS n FROM orders GROUP BY o_orderpriority;
              PUBLISH counts TO REPORTS WITH (COMPONENT = CHART, CHART_TYPE = 'bar', X_AXIS = 'o_orderpriority', Y_AXIS = 'n', AGGREGATION = 'sum', SORT = 'desc', LIMIT = 3);"""
    _, folder = stages(spark, d, text, "orders")
    (chart,) = json.loads(files.read_text(f"{folder}/reports/charts.json"))
    return spark.createDataFrame([(r["o_orderpriority"], r["n"]) for r in chart["rows"]], "o_orderpriority string, n bigint")


@query("SELECT n_nationkey, n_name, 'majority' AS consensus, (SELECT count(*) FROM nation) AS task_count FROM nation")
def annotation_tasks(spark, d):
    """Tasks that a queue gets, each with an id of its own."""
    text = "PUBLISH nation TO ANNOTATION QUEUE 'review' AS rev WITH TEMPLATE = '<View><Text name=\"t\" value=\"$n_name\"/></View>', CONSENSUS = 'majority', REVIEWERS_PER_TASK = 3;"
    _, folder = stages(spark, d, text, "nation")
    request = files.read_text(f"{folder}/annotations/rev.alias")
    manifest = json.loads(files.read_text(f"{folder}/annotations/{request}/manifest.json"))
    tasks = spark.read.json(f"{folder}/annotations/{request}/tasks.jsonl").dropDuplicates(["task_id"])
    return tasks.select("data.n_nationkey", "data.n_name", F.lit(manifest["consensus"]).alias("consensus"), F.lit(manifest["task_count"]).cast("bigint").alias("task_count"))


@query("SELECT n_nationkey AS k, 'label ' || n_name AS label FROM nation WHERE n_nationkey < 10")
def annotation_results(spark, d):
    """Results that reviewers leave beside a request, retrieved by its alias in a second run over the same folder."""
    folder = scratch(spark, "annotations")
    text = f"LOAD nation FROM '{d}/nation.parquet'; PUBLISH nation TO ANNOTATION QUEUE 'review' AS rev WITH TEMPLATE = '<View/>'; RETRIEVE ANNOTATION RESULTS made FROM rev;"
    first = engine.run(spark, text, engine.Settings(folder))
    if first.status != "waiting":
        raise RuntimeError(f"results before there are any: {first.status}")
    request = files.read_text(f"{folder}/annotations/rev.alias")
    n = spark.read.parquet(f"{d}/nation.parquet").where("n_nationkey < 10")
    n.select(F.col("n_nationkey").alias("k"), F.concat(F.lit("label "), "n_name").alias("label")).write.parquet(f"{folder}/annotations/{request}/results.parquet")
    again = engine.run(spark, text, engine.Settings(folder))
    return CellFrame(spark.read.parquet(again.tables["made"])).unwrap()


@query("SELECT name, reused FROM (VALUES ('nation', true), ('a', true), ('b', false), ('c', false)) AS t(name, reused)")
def run_reuse(spark, d):
    """A second run takes over the stages that are the same and clean; what an error or a change touches runs again."""
    text = "CREATE BATCH TABLE a SELECT n_nationkey, n_name FROM nation; CREATE BATCH TABLE b SELECT CAST(n_name AS INT) AS bad FROM a; CREATE BATCH TABLE c SELECT COUNT(*) AS n FROM b;"
    _, before = stages(spark, d, text, "nation")
    result, _ = stages(spark, d, text, "nation", reuse_from=before)
    return spark.createDataFrame([(n, n in result.reused) for n in result.tables], "name string, reused boolean")


@query("SELECT event, n FROM (VALUES ('started', 3), ('completed', 2), ('failed', 1), ('blocked', 1)) AS t(event, n)")
def run_events(spark, d):
    """Events of a run in which one stage fails and another one waits for it in vain."""
    folder = scratch(spark, "events")
    text = f"LOAD nation FROM '{d}/nation.parquet'; CREATE BATCH TABLE ok SELECT n_name FROM nation; CREATE BATCH TABLE bad SELECT n_name FROM nation WHERE CAST(n_name AS INT) > 1; CREATE BATCH TABLE after SELECT n_name FROM bad;"
    engine.run(spark, text, engine.Settings(folder))
    kinds = [json.loads(line)["event"] for line in files.read_text(f"{folder}/events.jsonl").splitlines()]
    return spark.createDataFrame([(k, kinds.count(k)) for k in dict.fromkeys(kinds)], "event string, n int")


@query("SELECT 'bad' AS column_name, 'CAST_ERROR' AS code, count(*) AS n_cells, count(*) AS n_rows FROM nation")
def run_manifest(spark, d):
    """What a stage's manifest counts."""
    _, folder = stages(spark, d, "CREATE BATCH TABLE made SELECT n_nationkey, CAST(n_name AS INT) AS bad FROM nation;", "nation")
    e = json.loads(files.read_text(f"{folder}/manifests/made.json"))["errors"]
    return spark.createDataFrame([(c, k, e["by_code"][k], e["row_count"]) for c in e["by_column"] for k in e["by_code"]], "column_name string, code string, n_cells bigint, n_rows bigint")


@query("SELECT n_name AS line, form FROM nation, (VALUES ('text'), ('dataset'), ('csv.gz')) AS t(form)")
def load_forms(spark, d):
    """LOAD of a text file, of a DATASET input, and of a compressed file whose format its name tells."""
    folder = scratch(spark, "forms")
    n = spark.read.parquet(f"{d}/nation.parquet").select("n_name")
    n.write.text(f"{folder}/t.txt")
    n.withColumnRenamed("n_name", "value").write.parquet(f"{folder}/datasets/names")
    n.withColumnRenamed("n_name", "value").coalesce(1).write.option("header", True).option("compression", "gzip").csv(f"{folder}/t.csv.gz")
    text = f"DECLARE INPUT ds DATASET DEFAULT 'names'; LOAD a FROM '{folder}/t.txt'; LOAD b FROM ds; LOAD c FROM '{folder}/t.csv.gz';"
    result = engine.run(spark, text, engine.Settings(f"{folder}/run", datasets=f"{folder}/datasets"))
    if result.failed:
        raise RuntimeError(str(result.failed))
    out = None
    for name, form in (("a", "text"), ("b", "dataset"), ("c", "csv.gz")):
        one = CellFrame(spark.read.parquet(result.tables[name])).unwrap().select(F.col("value").alias("line"), F.lit(form).alias("form"))
        out = one if out is None else out.unionAll(one)
    return out


@query("SELECT CAST(ts AS DATE)::VARCHAR AS day, count(*) AS n FROM events GROUP BY 1")
def stream_late_rows(spark, d):
    """Windows with a watermark in update mode: the delay covers all lateness, so no row is lost, and each window's last count stands."""
    folder = scratch(spark, "late")
    e = spark.read.parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.repartition(3, F.pmod("event_id", F.lit(3))).write.parquet(f"{folder}/in")
    windows = streams.tumbling(streams.source(spark, f"{folder}/in", 1), "ts", "1 day", [], [F.count(F.lit(1)).alias("n")], delay="3650 days")
    flat = windows.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "n")
    return streams.drain_to_table(flat, "update", folder=folder, keys=["day"])



@query("SELECT event_id, n_same FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id) AS n_same, event_type FROM events) WHERE event_type = 'click'")
def stream_static_join(spark, d):
    """A stream of events joined to a stored table of their users."""
    folder = scratch(spark, "static")
    e = spark.read.parquet(f"{d}/events.parquet")
    e.select("event_id", "user_id", "event_type").write.parquet(f"{folder}/in")
    users = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_same"))
    joined = streams.source(spark, f"{folder}/in").where("event_type = 'click'").join(users, "user_id").select("event_id", "n_same")
    streams.drain(joined, f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/out")
