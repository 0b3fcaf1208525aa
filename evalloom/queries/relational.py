"""Relational operators over cells: projections, joins, aggregates, windows, ordering, set operations, generators.

Queries return unwrapped values, and errors as counts or codes. Money is summed as DECIMAL, so that results do
not depend on the order of addition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..cells import algebra as A
from ..cells.frame import CellFrame
from ..session import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None):
    """Register a query under its function's name with the SQL that gives the same rows."""

    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return register


def cells(spark: SparkSession, d: str, name: str, *columns: str) -> CellFrame:
    df = table(spark, d, name)
    return CellFrame.wrap(df.select(*columns) if columns else df)


def money(c: Column) -> Column:
    return c.cast("decimal(18,2)")


def lift(fn, *c):
    return A.lift(fn, *c)


COUNT = lambda *_: F.count(F.lit(1))


# --- sources, wrapping ---------------------------------------------------------------------------------------


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def wrap_unwrap_roundtrip(spark, d):
    return CellFrame.wrap(table(spark, d, "nation"), "load_nation").unwrap()


@query("SELECT count(DISTINCT n_nationkey) AS n_rows, count(DISTINCT n_nationkey) AS n_ids, 32 AS id_length FROM nation")
def wrap_cell_ids(spark, d):
    df = CellFrame.wrap(table(spark, d, "nation"), "load_nation").df
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("n_name.cell_id").alias("n_ids"), F.max(F.length("n_name.cell_id")).alias("id_length"))


@query("SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) AS t(a, b)")
def values_scan(spark, d):
    return CellFrame.wrap(spark.sql("SELECT * FROM VALUES (1, 'a'), (2, 'b'), (3, NULL) AS t(a, b)")).unwrap()


# --- projection, filter -----------------------------------------------------------------------------------------


@query("""
    SELECT o_orderkey, CASE WHEN o_totalprice >= 200000 THEN 'large' WHEN o_totalprice >= 50000 THEN 'middle' ELSE 'small' END AS size,
           o_orderstatus || '/' || o_orderpriority || '/' || CAST(o_custkey AS VARCHAR) AS label
    FROM orders WHERE o_orderstatus IN ('O', 'F') AND o_totalprice BETWEEN 1000 AND 400000 AND o_orderpriority LIKE '%-%'
""")
def project_filter_case(spark, d):
    o = cells(spark, d, "orders")
    keep = lift(lambda s, p, r: s.isin("O", "F") & p.between(1000, 400000) & r.like("%-%"), o["o_orderstatus"], o["o_totalprice"], o["o_orderpriority"])
    o = o.where(keep)
    size = lift(lambda p: F.when(p >= 200000, "large").when(p >= 50000, "middle").otherwise("small"), o["o_totalprice"])
    slash = A.literal("/")
    label = A.concat(o["o_orderstatus"], slash, o["o_orderpriority"], slash, o["o_custkey"])
    return o.select({"o_orderkey": o["o_orderkey"], "size": size, "label": label}).unwrap()


@query("""
    SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS segment, -c_nationkey AS negated, c_nationkey % 7 AS part, NOT (c_nationkey > 10) AS low
    FROM customer WHERE c_acctbal IS NOT NULL
""")
def project_null_arithmetic(spark, d):
    c = cells(spark, d, "customer")
    c = c.where(lift(lambda v: v.isNotNull(), c["c_acctbal"]))
    return c.select(
        {
            "c_custkey": c["c_custkey"],
            "segment": lift(lambda s: F.coalesce(F.nullif(s, F.lit("BUILDING")), F.lit("none")), c["c_mktsegment"]),
            "negated": lift(lambda k: -k, c["c_nationkey"]),
            "part": lift(lambda k: k % 7, c["c_nationkey"]),
            "low": lift(lambda k: ~(k > 10), c["c_nationkey"]),
        }
    ).unwrap()


# --- recoverable errors ------------------------------------------------------------------------------------------


@query("""
    SELECT row_id, score, score_text IS NOT NULL AND score IS NULL AS is_err, coalesce(score, CASE WHEN score_text IS NOT NULL THEN -1 END) AS score_or,
           CASE WHEN score_text IS NOT NULL AND score IS NULL THEN 'CAST_ERROR' END AS code
    FROM (SELECT row_id, score_text, CASE WHEN regexp_full_match(trim(score_text), '[+-]?[0-9]+') THEN TRY_CAST(trim(score_text) AS BIGINT) END AS score FROM (SELECT DISTINCT row_id, score_text FROM scores))
""")
def cast_recover(spark, d):
    s = CellFrame.wrap(table(spark, d, "scores").select("row_id", "score_text").distinct())
    score = A.cast(s["score_text"], "bigint")
    out = s.select({"row_id": s["row_id"], "score": score, "is_err": A.is_err(score), "score_or": A.err_or(score, A.literal(F.lit(-1).cast("bigint")))})
    return out.unwrap().withColumn("code", F.when(F.col("is_err"), "CAST_ERROR"))


@query("SELECT event_type, count(*) AS n, count(*) AS n_errors, CAST(NULL AS BIGINT) AS total FROM events GROUP BY event_type")
def cast_error_flatten(spark, d):
    e = cells(spark, d, "events", "event_type")
    e = e.select({"event_type": e["event_type"], "bad": A.cast(e["event_type"], "int")})
    g = e.group({"event_type": e["event_type"]}, {"n": A.Cell(F.count(F.lit(1))), "total": A.aggregate(F.sum, e["bad"])})
    return g.df.select(F.col("event_type.value").alias("event_type"), F.col("n.value").alias("n"), g.error_count("total").cast("bigint").alias("n_errors"), F.col("total.value").alias("total"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_access(spark, d):
    e = cells(spark, d, "events", "event_id", "props")
    return e.select({"event_id": e["event_id"], "k": A.cast(A.access_json(A.parse_json(e["props"]), "k"), "int")}).unwrap()


@query("SELECT event_id, 'JSON_ACCESS_ERROR' AS code, true AS is_err, 'none' AS fallback, CAST(NULL AS VARCHAR) AS tolerant FROM events")
def json_missing_path(spark, d):
    e = cells(spark, d, "events", "event_id", "props")
    gone = A.access_json(A.parse_json(e["props"]), "absent", 0)
    text = A.lift(lambda v: v.cast("string"), gone)
    tolerant = A.lift(lambda v: A.variant_get(v, "$.absent", "string"), A.parse_json(e["props"]))
    f = e.select({"event_id": e["event_id"], "gone": text, "is_err": A.is_err(gone), "fallback": A.err_or(text, A.literal("none")), "tolerant": tolerant})
    return f.df.select(
        F.col("event_id.value").alias("event_id"), f.first_code("gone").alias("code"), F.col("is_err.value").alias("is_err"), F.col("fallback.value").alias("fallback"), F.col("tolerant.value").alias("tolerant")
    )


@query("SELECT event_id, json_extract_string(props, '$.k') AS v FROM events")
def json_dynamic_key(spark, d):
    e = cells(spark, d, "events", "event_id", "props")
    key = A.lift(lambda i: F.when(i >= 0, "k"), e["event_id"])
    v = A.access_json_key(A.parse_json(e["props"]), key)
    return e.select({"event_id": e["event_id"], "v": A.lift(lambda x: x.cast("string"), v)}).unwrap()


@query("SELECT count(*) AS n, count(DISTINCT doc_id) AS n_docs, count(CASE WHEN NOT json_valid(text) THEN 1 END) AS n_errors FROM documents WHERE text IS NOT NULL")
def json_bad_parse(spark, d):
    """All texts, whatever they begin with."""
    t = CellFrame.wrap(table(spark, d, "documents").select("doc_id", "text").where(F.col("text").isNotNull()))
    f = t.select({"doc_id": t["doc_id"], "doc": A.lift(lambda v: v.cast("string"), A.parse_json(t["text"]))})
    bad = F.count(F.when(f.first_code("doc") == "JSON_PARSE_ERROR", 1))
    return f.df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id.value").alias("n_docs"), bad.alias("n_errors"))


@query("""
    SELECT case_id, CASE WHEN chosen_pos < len(parts) AND chosen_pos >= 0 THEN parts[chosen_pos + 1] END AS label,
           chosen_pos IS NULL OR chosen_pos >= len(parts) OR parts IS NULL AS is_err
    FROM (SELECT DISTINCT case_id, chosen_pos, string_split(labels, '|') AS parts FROM metadata_cases)
""")
def array_access(spark, d):
    m = CellFrame.wrap(table(spark, d, "metadata_cases").select("case_id", "labels", "chosen_pos").distinct())
    label = A.access(A.lift(lambda v: F.split(v, r"\|"), m["labels"]), m["chosen_pos"], is_map=False)
    return m.select({"case_id": m["case_id"], "label": label, "is_err": A.is_err(label)}).unwrap()


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'even' END AS v, n_nationkey % 2 = 1 AS is_err FROM nation")
def map_access(spark, d):
    n = cells(spark, d, "nation")
    names = A.lift(lambda k: F.create_map(F.lit(0), F.lit("even")), n["n_nationkey"])
    v = A.access(names, A.lift(lambda k: k % 2, n["n_nationkey"]), is_map=True)
    return n.select({"n_nationkey": n["n_nationkey"], "v": v, "is_err": A.is_err(v)}).unwrap()


@query("SELECT n_nationkey, CAST(NULL AS VARCHAR) AS taken, 1 AS n_errors, CAST(NULL AS BIGINT) AS latency FROM nation")
def untaken_branch_errors(spark, d):
    n = cells(spark, d, "nation")
    bad = A.cast(n["n_name"], "int")
    taken = A.lift(lambda k, b, s: F.when(k >= 0, s).otherwise(b.cast("string")), n["n_nationkey"], bad, n["n_name"])
    f = n.select({"n_nationkey": n["n_nationkey"], "taken": taken, "latency": A.latency(taken)})
    return f.df.select(F.col("n_nationkey.value").alias("n_nationkey"), F.col("taken.value").alias("taken"), f.error_count("taken").alias("n_errors"), F.col("latency.value").alias("latency"))


# --- joins -----------------------------------------------------------------------------------------------------


def _orders_customers(spark, d, how):
    o = cells(spark, d, "orders", "o_orderkey", "o_custkey", "o_totalprice")
    c = cells(spark, d, "customer", "c_custkey", "c_mktsegment")
    return o.join(c, lambda a, b: A.lift(lambda x, y: x == y, a["o_custkey"], b["c_custkey"]), how)


def _join_sql(how):
    return f"SELECT o_orderkey, c_custkey, c_mktsegment FROM orders {how} JOIN customer ON o_custkey = c_custkey"


def _join_columns(j: CellFrame) -> DataFrame:
    return j.select({n: j[n] for n in ("o_orderkey", "c_custkey", "c_mktsegment")}).unwrap()


@query(_join_sql("INNER"))
def join_inner(spark, d):
    return _join_columns(_orders_customers(spark, d, "inner"))


@query(_join_sql("LEFT"))
def join_left(spark, d):
    return _join_columns(_orders_customers(spark, d, "left"))


@query(_join_sql("RIGHT"))
def join_right(spark, d):
    return _join_columns(_orders_customers(spark, d, "right"))


@query(_join_sql("FULL"))
def join_full(spark, d):
    return _join_columns(_orders_customers(spark, d, "full"))


@query("""
    SELECT n_name, p_brand, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey JOIN nation ON s_nationkey = n_nationkey
    WHERE p_size < 10 GROUP BY n_name, p_brand
""")
def join_multi_way(spark, d):
    eq = lambda x, y: x == y
    li = cells(spark, d, "lineitem", "l_suppkey", "l_partkey", "l_extendedprice")
    p = CellFrame.wrap(table(spark, d, "part").where("p_size < 10").select("p_partkey", "p_brand"))
    j = li.join(p, lambda a, b: lift(eq, a["l_partkey"], b["p_partkey"]))
    j = j.join(cells(spark, d, "supplier", "s_suppkey", "s_nationkey"), lambda a, b: lift(eq, a["l_suppkey"], b["s_suppkey"]))
    j = j.join(cells(spark, d, "nation", "n_nationkey", "n_name"), lambda a, b: lift(eq, a["s_nationkey"], b["n_nationkey"]))
    keys = {"n_name": j["n_name"], "p_brand": j["p_brand"]}
    total = A.aggregate(lambda v: F.sum(money(v)).cast("double"), j["l_extendedprice"])
    return j.group(keys, {"n": A.Cell(F.count(F.lit(1))), "revenue": total}).unwrap()


@query("""
    SELECT count(*) AS n, sum(l_linenumber) AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_linenumber % 7 = o_custkey % 7
""")
def join_multi_key(spark, d):
    li, o = cells(spark, d, "lineitem", "l_orderkey", "l_linenumber"), cells(spark, d, "orders", "o_orderkey", "o_custkey")
    on = lambda a, b: lift(lambda k, n, x, c: (k == x) & (n % 7 == c % 7), a["l_orderkey"], a["l_linenumber"], b["o_orderkey"], b["o_custkey"])
    j = li.join(o, on)
    return j.group({}, {"n": A.Cell(F.count(F.lit(1))), "lines": A.aggregate(F.sum, j["l_linenumber"])}).unwrap()


@query("SELECT count(*) AS n FROM customer WHERE lower(c_mktsegment) IN (SELECT lower(c_mktsegment) FROM customer WHERE c_custkey = 1)")
def join_expression_key(spark, d):
    c = cells(spark, d, "customer", "c_custkey", "c_mktsegment")
    one = CellFrame.wrap(table(spark, d, "customer").where("c_custkey = 1").select(F.col("c_mktsegment").alias("seg")))
    j = c.join(one, lambda a, b: lift(lambda x, y: F.lower(x) == F.lower(y), a["c_mktsegment"], b["seg"]))
    return j.group({}, {"n": A.Cell(F.count(F.lit(1)))}).unwrap()


@query("SELECT n_nationkey, r_name, 0 AS n_errors FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey > 2) r ON n_regionkey = r_regionkey")
def join_unmatched_is_no_error(spark, d):
    n = cells(spark, d, "nation")
    r = CellFrame.wrap(table(spark, d, "region").where("r_regionkey > 2"))
    j = n.join(r, lambda a, b: lift(lambda x, y: x == y, a["n_regionkey"], b["r_regionkey"]), "left")
    f = j.select({"n_nationkey": j["n_nationkey"], "r_name": j["r_name"]})
    return f.df.select(F.col("n_nationkey.value").alias("n_nationkey"), F.col("r_name.value").alias("r_name"), f.error_count("r_name").alias("n_errors"))


# --- aggregates --------------------------------------------------------------------------------------------------


@query("""
    SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity,
           CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2)))) AS DOUBLE) AS revenue,
           CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS mean_quantity, min(l_extendedprice) AS least, max(l_extendedprice) AS most
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10
""")
def group_having(spark, d):
    li = cells(spark, d, "lineitem", "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate")
    li = li.where(lift(lambda s: s <= F.lit("1998-09-02").cast("timestamp_ntz"), li["l_shipdate"]))
    quantity = lambda v: F.sum(money(v)).cast("double")
    return li.group(
        {"l_returnflag": li["l_returnflag"], "l_linestatus": li["l_linestatus"]},
        {
            "n": A.Cell(F.count(F.lit(1))),
            "quantity": A.aggregate(quantity, li["l_quantity"]),
            "revenue": A.aggregate(lambda p, x: F.sum(money(p) * (1 - money(x))).cast("double"), li["l_extendedprice"], li["l_discount"]),
            "mean_quantity": A.aggregate(lambda v: quantity(v) / F.count(F.lit(1)), li["l_quantity"]),
            "least": A.aggregate(F.min, li["l_extendedprice"]),
            "most": A.aggregate(F.max, li["l_extendedprice"]),
        },
        having=lambda g: lift(lambda n: n > 10, g["n"]),
    ).unwrap()


@query("SELECT count(*) AS n, count(DISTINCT o_custkey) AS customers, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders")
def global_agg(spark, d):
    o = cells(spark, d, "orders", "o_custkey", "o_totalprice")
    return o.group(
        {}, {"n": A.Cell(F.count(F.lit(1))), "customers": A.aggregate(F.count_distinct, o["o_custkey"]), "total": A.aggregate(lambda v: F.sum(money(v)).cast("double"), o["o_totalprice"])}
    ).unwrap()


@query("""
    SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderstatus) AS states, count(*) FILTER (o_orderstatus = 'F') AS n_f,
           bool_and(o_totalprice > 0) AS all_priced, bool_or(o_totalprice > 400000) AS any_large, min(o_orderkey) AS first_key
    FROM orders GROUP BY o_orderpriority
""")
def count_distinct(spark, d):
    o = cells(spark, d, "orders", "o_orderpriority", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderkey")
    return o.group(
        {"o_orderpriority": o["o_orderpriority"]},
        {
            "customers": A.aggregate(F.count_distinct, o["o_custkey"]),
            "states": A.aggregate(F.count_distinct, o["o_orderstatus"]),
            "n_f": A.aggregate(lambda s: F.count_if(s == "F"), o["o_orderstatus"]),
            "all_priced": A.aggregate(lambda p: F.bool_and(p > 0), o["o_totalprice"]),
            "any_large": A.aggregate(lambda p: F.bool_or(p > 400000), o["o_totalprice"]),
            "first_key": A.aggregate(F.min, o["o_orderkey"]),
        },
    ).unwrap()


@query("SELECT lower(substr(c_mktsegment, 1, 3)) AS segment, count(*) AS n, count(*) * 2 + 1 AS nested FROM customer GROUP BY 1")
def expr_group_key(spark, d):
    c = cells(spark, d, "customer", "c_mktsegment")
    key = lift(lambda s: F.lower(F.substring(s, 1, 3)), c["c_mktsegment"])
    return c.group({"segment": key}, {"n": A.Cell(F.count(F.lit(1))), "nested": A.Cell(F.count(F.lit(1)) * 2 + 1)}).unwrap()


@query("""
    SELECT CASE WHEN regexp_matches(score_text, '^[0-9]$') THEN score_text END AS score, count(*) AS n, count(CASE WHEN score_text IS NOT NULL AND NOT regexp_matches(score_text, '^[0-9]$') THEN 1 END) AS n_errors
    FROM (SELECT DISTINCT row_id, CASE WHEN regexp_matches(score_text, '^[0-9]$') OR regexp_matches(score_text, '^[a-z/]+$') THEN score_text END AS score_text FROM scores) GROUP BY 1
""")
def errored_key_groups_as_null(spark, d):
    s = table(spark, d, "scores")
    s = s.select("row_id", F.when(F.col("score_text").rlike("^[0-9]$") | F.col("score_text").rlike("^[a-z/]+$"), F.col("score_text")).alias("score_text")).distinct()
    s = CellFrame.wrap(s)
    g = s.group({"score": A.cast(s["score_text"], "int")}, {"n": A.Cell(F.count(F.lit(1)))})
    return g.df.select(F.col("score.value").cast("string").alias("score"), F.col("n.value").alias("n"), g.error_count("score").cast("bigint").alias("n_errors"))


# --- windows -----------------------------------------------------------------------------------------------------


@query("""
    SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER v AS rk, dense_rank() OVER v AS dr, percent_rank() OVER v AS pr, ntile(4) OVER w AS quarter, cume_dist() OVER v AS cd
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey), v AS (PARTITION BY o_custkey ORDER BY o_orderpriority)
""")
def win_rank(spark, d):
    o = cells(spark, d, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    part = o["o_custkey"]
    w = Window.partitionBy(part.value).orderBy(o["o_totalprice"].value.desc(), o["o_orderkey"].value)
    v = Window.partitionBy(part.value).orderBy(o["o_orderpriority"].value)
    over = lambda fn, win: A.over(fn, win, [], [part])
    return o.select(
        {
            "o_orderkey": o["o_orderkey"], "rn": over(F.row_number, w), "rk": over(F.rank, v), "dr": over(F.dense_rank, v), "pr": over(F.percent_rank, v),
            "quarter": over(lambda: F.ntile(4), w), "cd": over(F.cume_dist, v),
        }
    ).unwrap()


@query("""
    SELECT o_orderkey, lag(o_orderkey) OVER w AS before, lead(o_orderkey, 2, -1) OVER w AS after, first_value(o_orderkey) OVER w AS first_key
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
""")
def win_lag_lead(spark, d):
    o = cells(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    w = Window.partitionBy(o["o_custkey"].value).orderBy(o["o_orderdate"].value, o["o_orderkey"].value)
    key = [o["o_custkey"], o["o_orderdate"]]
    return o.select(
        {
            "o_orderkey": o["o_orderkey"], "before": A.over(F.lag, w, [o["o_orderkey"]], key), "after": A.over(lambda c: F.lead(c, 2, -1), w, [o["o_orderkey"]], key),
            "first_key": A.over(F.first, w, [o["o_orderkey"]], key),
        }
    ).unwrap()


@query("""
    SELECT event_id, CAST(sum(CAST(value AS DECIMAL(18,2))) OVER (PARTITION BY user_id) AS DOUBLE) AS total, count(*) OVER (PARTITION BY event_type) AS n FROM events
""")
def win_agg(spark, d):
    e = cells(spark, d, "events", "event_id", "user_id", "event_type", "value")
    by_user, by_type = Window.partitionBy(e["user_id"].value), Window.partitionBy(e["event_type"].value)
    total = A.over(lambda v: F.sum(money(v)), by_user, [e["value"]], [e["user_id"]])
    n = A.over(lambda: F.count(F.lit(1)), by_type, [], [e["event_type"]])
    return e.select({"event_id": e["event_id"], "total": lift(lambda t: t.cast("double"), total), "n": n}).unwrap()


# --- order, limit, sets ------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def order_limit_topk(spark, d):
    o = cells(spark, d, "orders", "o_orderkey", "o_totalprice")
    return o.order((o["o_totalprice"], "desc"), (o["o_orderkey"], "asc")).limit(25).unwrap()


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 10")
def order_alias(spark, d):
    o = cells(spark, d, "orders", "o_custkey")
    g = o.group({"o_custkey": o["o_custkey"]}, {"n": A.Cell(F.count(F.lit(1)))})
    return g.order((g["n"], "desc"), (g["o_custkey"], "asc")).limit(10).unwrap()


@query("SELECT case_id, priority FROM (SELECT DISTINCT case_id, priority FROM cases) ORDER BY priority DESC NULLS LAST, case_id LIMIT 30")
def order_nulls_last(spark, d):
    c = CellFrame.wrap(table(spark, d, "cases").select("case_id", "priority").distinct())
    return c.order((c["priority"], "desc_nulls_last"), (c["case_id"], "asc")).limit(30).unwrap()


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 5")
def limit_input(spark, d):
    """LIMIT from a declared input, a session variable."""
    spark.sql("DECLARE OR REPLACE VARIABLE evalloom_limit_rows INT DEFAULT 5")
    n = spark.sql("SELECT evalloom_limit_rows").first()[0]
    o = cells(spark, d, "orders", "o_orderkey")
    return o.order((o["o_orderkey"], "asc")).limit(n).unwrap()




@query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey AS k FROM supplier")
def union_all(spark, d):
    c, s = cells(spark, d, "customer", "c_nationkey"), cells(spark, d, "supplier", "s_nationkey")
    return c.select({"k": c["c_nationkey"]}).union(s.select({"k": s["s_nationkey"]})).unwrap()


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey AS k FROM supplier")
def union_distinct(spark, d):
    c, s = cells(spark, d, "customer", "c_nationkey"), cells(spark, d, "supplier", "s_nationkey")
    return c.select({"k": c["c_nationkey"]}).union(s.select({"k": s["s_nationkey"]}), distinct=True).unwrap()


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def select_distinct(spark, d):
    o = cells(spark, d, "orders", "o_orderstatus", "o_orderpriority")
    return o.distinct().unwrap()


@query("SELECT DISTINCT props AS doc FROM events")
def distinct_variant(spark, d):
    e = cells(spark, d, "events", "props")
    out = e.select({"doc": A.parse_json(e["props"])}).distinct().unwrap()
    return out.select(F.regexp_replace("doc", '":', '": ').alias("doc"))


# --- generators --------------------------------------------------------------------------------------------------


@query("SELECT doc_id, unnest(string_split(recipe, '_')) AS word FROM documents WHERE recipe IS NOT NULL")
def explode_array(spark, d):
    t = CellFrame.wrap(table(spark, d, "documents").select("doc_id", "recipe"))
    x = t.explode(lift(lambda v: F.split(v, "_"), t["recipe"]), "word")
    return x.select({"doc_id": x["doc_id"], "word": x["word"]}).unwrap()


@query("""
    SELECT case_id, pos - 1 AS pos, parts[pos] AS label, length(parts[pos]) + chosen_pos AS mixed
    FROM (SELECT DISTINCT case_id, chosen_pos, string_split(labels, '|') AS parts FROM metadata_cases), unnest(range(1, len(parts) + 1)) AS t(pos)
""")
def posexplode_lateral_ref(spark, d):
    m = CellFrame.wrap(table(spark, d, "metadata_cases").select("case_id", "labels", "chosen_pos").distinct())
    x = m.explode(lift(lambda v: F.split(v, r"\|"), m["labels"]), "label", position="pos")
    mixed = lift(lambda a, b: (F.length(a) + b).cast("bigint"), x["label"], x["chosen_pos"])
    return x.select({"case_id": x["case_id"], "pos": lift(lambda p: p.cast("bigint"), x["pos"]), "label": x["label"], "mixed": mixed}).unwrap()


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) + pos AS v FROM events, (VALUES (0), (1)) AS t(pos)")
def explode_variant(spark, d):
    e = cells(spark, d, "events", "event_id", "props")
    pair = lift(lambda p: F.parse_json(F.concat(F.lit("["), p, F.lit(","), p, F.lit("]"))), e["props"])
    f = e.select({"event_id": e["event_id"], "items": A.Cell(pair.value, pair.errors)})
    x = f.explode(f["items"], "item", position="pos")
    v = lift(lambda a, b: a + b, A.cast(A.access_json(x["item"], "k"), "int"), x["pos"])
    return x.select({"event_id": x["event_id"], "v": v}).unwrap()


@query("SELECT DISTINCT case_id, coalesce(len(string_split(labels, '|')), -1) AS n FROM metadata_cases")
def array_size(spark, d):
    m = CellFrame.wrap(table(spark, d, "metadata_cases").select("case_id", "labels").distinct())
    return m.select({"case_id": m["case_id"], "n": lift(lambda v: F.coalesce(F.array_size(F.split(v, r"\|")).cast("bigint"), F.lit(-1)), m["labels"])}).unwrap()
