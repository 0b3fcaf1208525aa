"""Functions over cells: Spark's own families lifted to cells, the deterministic catalog, and Python functions."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F

from ..cells import algebra as A
from ..cells.frame import CellFrame
from ..functions import columns as K
from ..functions import registry as R
from ..functions import udf as U
from ..script import ast as N
from ..script.lower import Context, lower_query
from ..session import table
from . import stored

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return register


def _lifted(frame: CellFrame, key: str, **columns) -> CellFrame:
    """columns: name -> (function over values, column names...)."""
    return frame.select({key: frame[key], **{n: A.lift(fn, *[frame[c] for c in names]) for n, (fn, *names) in columns.items()}})


@query("""
    SELECT c_custkey, upper(c_name) AS up, lower(c_mktsegment) AS low, length(c_name) AS len, substr(c_name, 3, 4) AS sub, lpad(CAST(c_nationkey AS VARCHAR), 4, '0') AS padded,
           replace(c_name, '_', '-') AS replaced, reverse(c_mktsegment) AS reversed, trim('  ' || c_mktsegment || ' ') AS trimmed, md5(c_name) AS digest, contains(c_name, '7') AS has7,
           starts_with(c_name, 'C') AS starts, levenshtein(c_mktsegment, 'BUILDING') AS distance, regexp_replace(c_name, '[0-9]+', '#') AS masked, instr(c_mktsegment, 'E') AS first_e,
           repeat('ab', c_nationkey % 3) AS repeated, concat_ws('/', c_name, c_mktsegment) AS joined, translate(c_mktsegment, 'AB', 'xy') AS translated, ascii(c_mktsegment) AS code
    FROM customer
""")
def fn_string(spark, d):
    c = CellFrame.wrap(table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey"))
    return _lifted(
        c, "c_custkey",
        up=(F.upper, "c_name"), low=(F.lower, "c_mktsegment"), len=(F.length, "c_name"), sub=(lambda v: F.substring(v, 3, 4), "c_name"),
        padded=(lambda v: F.lpad(v.cast("string"), 4, "0"), "c_nationkey"), replaced=(lambda v: F.replace(v, F.lit("_"), F.lit("-")), "c_name"), reversed=(F.reverse, "c_mktsegment"),
        trimmed=(lambda v: F.trim(F.concat(F.lit("  "), v, F.lit(" "))), "c_mktsegment"), digest=(F.md5, "c_name"), has7=(lambda v: F.contains(v, F.lit("7")), "c_name"),
        starts=(lambda v: F.startswith(v, F.lit("C")), "c_name"), distance=(lambda v: F.levenshtein(v, F.lit("BUILDING")), "c_mktsegment"),
        masked=(lambda v: F.regexp_replace(v, "[0-9]+", "#"), "c_name"), first_e=(lambda v: F.instr(v, "E"), "c_mktsegment"), repeated=(lambda k: F.repeat(F.lit("ab"), k % 3), "c_nationkey"),
        joined=(lambda a, b: F.concat_ws("/", a, b), "c_name", "c_mktsegment"), translated=(lambda v: F.translate(v, "AB", "xy"), "c_mktsegment"), code=(F.ascii, "c_mktsegment"),
    ).unwrap()


@query("""
    SELECT o_orderkey, abs(o_custkey - 700) AS a, ceil(o_totalprice) AS c, floor(o_totalprice) AS f, round(o_totalprice / 3, 2) AS r, sqrt(o_custkey) AS s, power(o_custkey, 2) AS p,
           ln(o_custkey + 1) AS l, exp(o_custkey / 10000.0) AS e, sign(o_custkey - 700) AS sg, greatest(o_custkey, 500) AS g, least(o_custkey, 500) AS le, bit_count(o_custkey) AS bits,
           o_custkey % 13 AS m, sin(o_custkey) AS sn, cos(o_custkey) AS cs, radians(o_custkey) AS rad, log10(o_custkey + 1) AS lg, factorial(CAST(o_custkey % 10 AS INTEGER)) AS fact FROM orders
""")
def fn_math(spark, d):
    o = CellFrame.wrap(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"))
    k, t = "o_custkey", "o_totalprice"
    return _lifted(
        o, "o_orderkey",
        a=(lambda v: F.abs(v - 700), k), c=(F.ceil, t), f=(F.floor, t), r=(lambda v: F.round(v / 3, 2), t), s=(F.sqrt, k), p=(lambda v: F.pow(v, F.lit(2)), k), l=(lambda v: F.ln(v + 1), k),
        e=(lambda v: F.exp(v / 10000.0), k), sg=(lambda v: F.signum(v - 700), k), g=(lambda v: F.greatest(v, F.lit(500)), k), le=(lambda v: F.least(v, F.lit(500)), k),
        bits=(F.bit_count, k), m=(lambda v: v % 13, k), sn=(F.sin, k), cs=(F.cos, k), rad=(F.radians, k), lg=(lambda v: F.log10(v + 1), k), fact=(lambda v: F.factorial((v % 10).cast("int")), k),
    ).unwrap()


@query("""
    SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, quarter(o_orderdate) AS q, dayofyear(o_orderdate) AS doy, weekofyear(o_orderdate) AS w,
           hour(o_orderdate) AS h, strftime(o_orderdate, '%Y-%m') AS ym, CAST(CAST(o_orderdate AS DATE) + 10 AS VARCHAR) AS plus10, date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS days,
           CAST(last_day(o_orderdate) AS VARCHAR) AS ld, CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS VARCHAR) AS tm, dayofweek(o_orderdate) + 1 AS dow,
           CAST(epoch(o_orderdate) AS BIGINT) AS unix, CAST(CAST(CAST(o_orderdate AS DATE) + INTERVAL 2 MONTH AS DATE) AS VARCHAR) AS am
    FROM orders
""")
def fn_date(spark, d):
    o = CellFrame.wrap(table(spark, d, "orders").select("o_orderkey", "o_orderdate"))
    t = "o_orderdate"
    return _lifted(
        o, "o_orderkey",
        y=(F.year, t), m=(F.month, t), d=(F.dayofmonth, t), q=(F.quarter, t), doy=(F.dayofyear, t), w=(F.weekofyear, t), h=(F.hour, t),
        ym=(lambda v: F.date_format(v, "yyyy-MM"), t), plus10=(lambda v: F.date_add(v.cast("date"), 10).cast("string"), t),
        days=(lambda v: F.datediff(v.cast("date"), F.lit("1992-01-01").cast("date")), t), ld=(lambda v: F.last_day(v.cast("date")).cast("string"), t),
        tm=(lambda v: F.trunc(v.cast("date"), "month").cast("string"), t), dow=(F.dayofweek, t), unix=(lambda v: F.unix_timestamp(v.cast("timestamp")), t),
        am=(lambda v: F.add_months(v.cast("date"), 2).cast("string"), t),
    ).unwrap()


@query("""
    SELECT doc_id, len(p) AS n, list_contains(p, 'eval') AS has, array_to_string(list_sort(p), ',') AS sorted, array_to_string(list_distinct_sorted, ',') AS uniq, p[1] AS first, p[-1] AS last,
           array_to_string(p[1:2], ',') AS head, list_position(p, 'eval') AS at, array_to_string(list_filter(p, lambda x: length(x) > 4), ',') AS longer, list_max(p) AS mx, list_min(p) AS mn
    FROM (SELECT doc_id, string_split(recipe, '_') AS p, list_sort(list_distinct(string_split(recipe, '_'))) AS list_distinct_sorted FROM documents WHERE recipe IS NOT NULL)
""")
def fn_array(spark, d):
    t = CellFrame.wrap(table(spark, d, "documents").where("recipe IS NOT NULL").select("doc_id", F.split("recipe", "_").alias("p")))
    p, text = "p", lambda v: F.array_join(v, ",")
    return _lifted(
        t, "doc_id",
        n=(F.size, p), has=(lambda v: F.array_contains(v, "eval"), p), sorted=(lambda v: text(F.sort_array(v)), p), uniq=(lambda v: text(F.sort_array(F.array_distinct(v))), p),
        first=(lambda v: F.element_at(v, 1), p), last=(lambda v: F.element_at(v, -1), p), head=(lambda v: text(F.slice(v, 1, 2)), p),
        at=(lambda v: F.when(F.array_position(v, "eval") > 0, F.array_position(v, "eval")), p), longer=(lambda v: text(F.filter(v, lambda x: F.length(x) > 4)), p), mx=(F.array_max, p), mn=(F.array_min, p),
    ).unwrap()


@query("""
    SELECT n_nationkey, 2 AS size, array_to_string(['name', 'region'], ',') AS keys, n_name AS name, CAST(n_regionkey AS VARCHAR) AS region, n_nationkey AS a, n_name || '!' AS b FROM nation
""")
def fn_map_struct(spark, d):
    n = CellFrame.wrap(table(spark, d, "nation"))
    m = A.lift(lambda a, r: F.create_map(F.lit("name"), a, F.lit("region"), r.cast("string")), n["n_name"], n["n_regionkey"])
    s = A.lift(lambda k, a: F.named_struct(F.lit("a"), k, F.lit("b"), F.concat(a, F.lit("!"))), n["n_nationkey"], n["n_name"])
    return n.select(
        {
            "n_nationkey": n["n_nationkey"], "size": A.lift(F.size, m), "keys": A.lift(lambda v: F.array_join(F.map_keys(v), ","), m), "name": A.lift(lambda v: v["name"], m),
            "region": A.lift(lambda v: F.try_element_at(v, F.lit("region")), m), "a": A.lift(lambda v: v["a"], s), "b": A.lift(lambda v: v["b"], s),
        }
    ).unwrap()


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(json_extract(props, '$.k') AS INTEGER) AS typed, 1 AS n_keys, event_type = 'click' AS flag, coalesce(nullif(event_type, 'view'), 'seen') AS c FROM events")
def fn_json_conditional(spark, d):
    e = CellFrame.wrap(table(spark, d, "events").select("event_id", "props", "event_type"))
    return _lifted(
        e, "event_id",
        k=(lambda v: F.get_json_object(v, "$.k"), "props"), typed=(lambda v: F.from_json(v, "k int")["k"], "props"), n_keys=(lambda v: F.size(F.json_object_keys(v)), "props"),
        flag=(lambda v: v == "click", "event_type"), c=(lambda v: F.coalesce(F.nullif(v, F.lit("view")), F.lit("seen")), "event_type"),
    ).unwrap()


# --- catalog -----------------------------------------------------------------------------------------------------

_PAIRS = "SELECT o_orderkey, 1000 + (o_custkey % 1000) AS ra, 1000 + (o_orderkey % 1000) AS rb, (o_custkey % 3) / 2.0 AS outcome FROM orders"


def _pairs(spark, d):
    o = table(spark, d, "orders")
    return CellFrame.wrap(
        o.select("o_orderkey", (1000 + F.col("o_custkey") % 1000).alias("ra"), (1000 + F.col("o_orderkey") % 1000).alias("rb"), ((F.col("o_custkey") % 3) / 2.0).alias("outcome"))
    )


@query(f"SELECT o_orderkey, 1 / (1 + power(10.0, (rb - ra) / 400.0)) AS expected FROM ({_PAIRS})")
def elo_expected(spark, d):
    p = _pairs(spark, d)
    return p.select({"o_orderkey": p["o_orderkey"], "expected": A.lift(K.elo_expected_score, p["ra"], p["rb"])}).unwrap()


@query(f"SELECT o_orderkey, 24 * (outcome - 1 / (1 + power(10.0, (rb - ra) / 400.0))) AS delta FROM ({_PAIRS})")
def elo_delta(spark, d):
    p = _pairs(spark, d)
    k = A.literal(24)
    return p.select({"o_orderkey": p["o_orderkey"], "delta": A.lift(K.elo_rating_delta, p["ra"], p["rb"], p["outcome"], k)}).unwrap()


_REPLAY = """
    WITH RECURSIVE games AS (
        SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i, o_orderstatus AS a, CASE WHEN o_orderstatus = 'F' THEN 'O' ELSE 'F' END AS b, (o_custkey % 3) / 2.0 AS won FROM orders
    ), played AS (
        SELECT DISTINCT o_custkey, CAST(0 AS BIGINT) AS i, 1500.0::DOUBLE AS f, 1500.0::DOUBLE AS o, 1500.0::DOUBLE AS p FROM orders
        UNION ALL
        SELECT g.o_custkey, g.i, f + CASE 'F' WHEN a THEN d WHEN b THEN -d ELSE 0 END, o + CASE 'O' WHEN a THEN d WHEN b THEN -d ELSE 0 END, p + CASE 'P' WHEN a THEN d ELSE 0 END
        FROM (SELECT g.*, r.f, r.o, r.p, 24.0 * (won - 1 / (1 + power(10.0, (CASE b WHEN 'F' THEN f ELSE o END - CASE a WHEN 'F' THEN f WHEN 'O' THEN o ELSE p END) / 400.0))) AS d
              FROM played r JOIN games g ON g.o_custkey = r.o_custkey AND g.i = r.i + 1) g
    )
    SELECT o_custkey, round(arg_max(f, i), 6) AS rating FROM played GROUP BY o_custkey
"""


@query(_REPLAY)
def elo_final(spark, d):
    """The final rating of each customer's status F against status O, replayed over the customer's orders."""
    o = table(spark, d, "orders").withColumn("other", F.when(F.col("o_orderstatus") == "F", "O").otherwise("F"))
    game = F.struct("o_orderdate", "o_orderkey", F.col("o_orderstatus").alias("a"), F.col("other").alias("b"), ((F.col("o_custkey") % 3) / 2.0).alias("o"))
    g = o.groupBy("o_custkey").agg(F.sort_array(F.collect_list(game)).alias("g"))
    return g.select("o_custkey", F.round(K.elo_final_rating(F.lit("F"), F.col("g.a"), F.col("g.b"), F.col("g.o"), F.lit(24.0)), 6).alias("rating"))


def _call(frame: CellFrame, name: str, keep: list[str], result: str = "result", **arguments) -> CellFrame:
    """Call a catalog function: its hidden column first, then the projection that reads it."""
    f = R.CATALOG[name]
    hidden, cell = U.prepare(f, f.bind([], arguments))
    called = CellFrame(frame.df.withColumn("__call", hidden))
    return called.select({**{k: called[k] for k in keep}, result: cell(F.col("__call"))})


@query()
def fence_extract(spark, d):
    """Code blocks in agents' outputs."""
    runs = CellFrame.wrap(table(spark, d, "agent_runs").select("run_id", F.col("harness_result.final_output").alias("content")).distinct())
    f = _call(runs, "string.extract_from_fence", ["run_id"], content=runs["content"])
    return f.unwrap().select("run_id", F.to_json("result").alias("blocks"))


@query()
def schema_match(spark, d):
    """Do the judges' verdicts have the fields that are expected of them?"""
    s = table(spark, d, "small_responses").select("sample_id", "passage_id", "small_response").distinct()
    s = s.withColumn("call", F.get_json_object("small_response", "$.choices[0].message.content"))
    s = CellFrame.wrap(s)
    schema = A.literal(F.array(F.lit('{"properties": {"confidence": {"type": "number"}, "passage_id": {"type": "string"}}, "required": ["passage_id"]}')))
    wanted = A.literal(F.array(F.lit("relevance_label"), F.lit("support_label")))
    f = _call(s, "agent.tool.schema_match", ["sample_id", "passage_id"], tool_schema=schema, expected_call_properties=wanted, tool_call=s["call"])
    v = F.col("result")
    return f.unwrap().select(
        "sample_id", "passage_id", F.try_variant_get(v, "$.score", "double").alias("score"), F.try_variant_get(v, "$.construction_failure_type", "string").alias("failure")
    )


@query("""
    SELECT run_id, CASE WHEN len(t) > 0 AND places = list_sort(places) THEN 1.0 ELSE 0.0 END AS score, CASE WHEN len(t) = 0 THEN 'review' WHEN places = list_sort(places) THEN 'pass' ELSE 'fail' END AS label
    FROM (SELECT DISTINCT run_id, t, list_transform(list_sort(list_distinct(t)), lambda x: list_position(t, x)) AS places
          FROM (SELECT run_id, list_filter(list_transform(simulator_result.turns, lambda u: u.turn), lambda x: x IS NOT NULL) AS t FROM agent_runs WHERE simulator_result.turns IS NOT NULL))
""")
def step_adherence(spark, d):
    """Do the turns of a simulation come in order?"""
    runs = table(spark, d, "agent_runs").select("run_id", F.col("simulator_result.turns.turn").alias("turns")).distinct().where("turns IS NOT NULL")
    steps = F.transform(F.array_sort(F.array_distinct(F.filter("turns", lambda t: t.isNotNull()))), lambda t: F.struct(t.cast("string").alias("id"), F.lit(True).alias("required")))
    observed = F.transform(F.filter("turns", lambda t: t.isNotNull()), lambda t: F.struct(F.concat(F.lit("o"), t.cast("string")).alias("id"), F.array(t.cast("string")).alias("matches_expected_ids")))
    a = runs.select("run_id", F.to_json(F.struct(steps.alias("expected_steps"), observed.alias("observed_steps"))).alias("alignment"))
    a = CellFrame.wrap(a)
    f = _call(a, "agent.trajectory.step_adherence", ["run_id"], alignment=a["alignment"], ordering_policy=A.literal("in_order"))
    v = F.col("result")
    return f.unwrap().select("run_id", F.try_variant_get(v, "$.score", "double").alias("score"), F.try_variant_get(v, "$.label", "string").alias("label"))


@query("SELECT n_nationkey, 2 AS row_count, 'name,key' AS columns FROM nation")
def parse_csv_function(spark, d):
    n = CellFrame.wrap(table(spark, d, "nation").select("n_nationkey", F.concat(F.lit("name,key\n"), "n_name", F.lit(","), F.col("n_nationkey").cast("string"), F.lit("\nx,1\n")).alias("content")))
    f = _call(n, "data.parse_csv", ["n_nationkey"], content=n["content"])
    return f.unwrap().select("n_nationkey", F.get_json_object("result", "$.row_count").cast("int").alias("row_count"), F.expr("array_join(from_json(get_json_object(result, '$.columns'), 'array<string>'), ',')").alias("columns"))


@query("SELECT n_nationkey, 'RUNTIME_PYTHON_ERROR' AS code, true AS value_is_null FROM nation")
def call_error_marks_cell(spark, d):
    n = CellFrame.wrap(table(spark, d, "nation").select("n_nationkey", "n_name"))
    f = _call(n, "data.parse_json", ["n_nationkey"], content=n["n_name"])
    return f.df.select(F.col("n_nationkey.value").alias("n_nationkey"), f.first_code("result").alias("code"), F.col("result.value").isNull().alias("value_is_null"))


@query("SELECT n_nationkey, 'CAST_ERROR' AS code, 1 AS n_errors FROM nation")
def call_skipped_on_input_error(spark, d):
    n = CellFrame.wrap(table(spark, d, "nation").select("n_nationkey", "n_name"))
    f = _call(n, "data.parse_json", ["n_nationkey"], content=A.cast(n["n_name"], "int"))
    return f.df.select(F.col("n_nationkey.value").alias("n_nationkey"), f.first_code("result").alias("code"), f.error_count("result").alias("n_errors"))


@query("SELECT n_nationkey, 'UNAVAILABLE' AS code FROM nation")
def call_unavailable(spark, d):
    n = CellFrame.wrap(table(spark, d, "nation").select("n_nationkey", "n_name"))
    f = _call(n, "http.get", ["n_nationkey"], url=n["n_name"])
    return f.df.select(F.col("n_nationkey.value").alias("n_nationkey"), f.first_code("result").alias("code"))


_ENTRIES = "(SELECT n_regionkey AS r, list('data/' || n_name || '.json') AS paths FROM nation GROUP BY n_regionkey)"


@query(f"SELECT r, list_contains(paths, 'data/NATION_3.json') AS has, len(list_filter(paths, lambda p: p LIKE 'data/NATION\\_1%' ESCAPE '\\')) AS n_glob FROM {_ENTRIES}")
def objectstore_listing(spark, d):
    path = F.concat(F.lit("data/"), "n_name", F.lit(".json"))
    e = K.entry(path=path, dataset_path=path, name=F.col("n_name"), entry_type=F.lit("file"))
    g = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("r")).agg(F.collect_list(e).alias("entries"))
    return g.select("r", K.entries_exist(F.col("entries"), F.lit("data/NATION_3.json")).alias("has"), F.size(K.entries_glob(F.col("entries"), "data/NATION_1*")).alias("n_glob"))


@query("SELECT n_name FROM nation WHERE regexp_matches('data/' || n_name, '_1') AND NOT regexp_matches('data/' || n_name, '_12$')")
def directory_filters(spark, d):
    n = table(spark, d, "nation")
    return n.where(K.filter_paths(F.concat(F.lit("data/"), F.col("n_name")), ["_1"], ["_12$"])).select("n_name")


# --- Python functions --------------------------------------------------------------------------------------------


@query("SELECT doc_id, length(text) AS n FROM documents WHERE text IS NOT NULL")
def udf_batch(spark, d):
    size = U.batch_function(lambda texts: [None if t is None else len(t) for t in texts], "bigint")
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", size("text").alias("n"))


@query("SELECT doc_id, unnest(string_split(recipe, '_')) AS word FROM documents WHERE recipe IS NOT NULL")
def udf_row_explode(spark, d):
    words = U.explode_function(lambda t: t.split("_"), "string")
    return table(spark, d, "documents").where("recipe IS NOT NULL").select("doc_id", F.explode(words("recipe")).alias("word"))


@query("SELECT label, CAST(max(vec_id) - min(vec_id) AS DOUBLE) AS spread FROM embeddings GROUP BY label")
def udf_agg(spark, d):
    @F.pandas_udf("double")
    def spread(v: pd.Series) -> float:
        return float(v.max() - v.min())

    return table(spark, d, "embeddings").groupBy("label").agg(spread("vec_id").alias("spread"))


@query("SELECT n_nationkey, lower(n_name) AS v FROM nation")
def udf_async(spark, d):
    async def low(text):
        return text.lower()

    return table(spark, d, "nation").select("n_nationkey", U.async_row_function(low, "string")("n_name").alias("v"))


# --- catalog functions over fixed arguments ------------------------------------------------------------------------

_ZIP = "UEsDBBQAAAAAAAAAIQCsKpPYAgAAAAIAAAAFAAAAYS50eHRoaVBLAQIUAxQAAAAAAAAAIQCsKpPYAgAAAAIAAAAFAAAAAAAAAAAAAACAAQAAAABhLnR4dFBLBQYAAAAAAQABADMAAAAlAAAAAAA="
_CALLS = '[{"tool_calls": [{"name": "f", "args": {"x": 1}}, {"name": "g", "args": {}}]}]'
_WANTED = '[{"name": "f", "args": {"x": 1}}, {"name": "h", "args": {}}]'
#: (label, call, its result as compact JSON with sorted keys).
FIXED = [
    ("observer", "simulators.observer('local.look')", {"spec_type": "simulator_observer", "callback": "local.look", "schedule": ["final"], "config": {}}),
    ("observer both", """simulators.observer('f', schedule = array('after_turn', 'final'), config = parse_json('{"k": 1}'))""",
     {"spec_type": "simulator_observer", "callback": "f", "schedule": ["after_turn", "final"], "config": {"k": 1}}),
    ("limits", "simulators.limits()", {"spec_type": "simulator_limits", "max_turns": 32, "timeout_seconds": 300.0}),
    ("limits given", "simulators.limits(max_turns = 5, timeout_seconds = 1.5)", {"spec_type": "simulator_limits", "max_turns": 5, "timeout_seconds": 1.5}),
    ("browser", "envs.browser.spec(session_id = 's', start_url = 'https://x.example')", {"spec_type": "environment", "kind": "browser", "env_id": "s", "config": {"start_url": "https://x.example"}}),
    ("shell", "envs.shell.spec(session_id = 's', cwd = '/w')", {"spec_type": "environment", "kind": "shell", "env_id": "s", "config": {"cwd": "/w"}}),
    ("harness", "agent_harness.spec(session_id = 's', aisystem = 'a', workdir = 'w')",
     {"spec_type": "environment", "kind": "agent_harness", "env_id": "s", "config": {"session_id": "s", "aisystem": "a", "workdir": "w"}}),
    ("mcp http", "mcps.http.spec(name = 'n', endpoint = 'https://x.example', allow_tools = array('t'))",
     {"spec_type": "mcp", "transport": "http", "name": "n", "endpoint": "https://x.example", "required": False, "secret_id": None, "allow_tools": ["t"], "deny_tools": [], "headers": {}, "start_mode": "lazy"}),
    ("mcp stdio", "envs.mcp.stdio.spec(name = 'n', command = 'c', args = array('-v'), required = true)",
     {"spec_type": "mcp", "transport": "stdio", "name": "n", "command": "c", "args": ["-v"], "required": True, "allow_tools": [], "deny_tools": [], "env": {}, "default_tools_approval_mode": None, "start_mode": "lazy"}),
    ("playwright", "mcps.playwright.spec(output_dir = '/o', headless = false)",
     {"spec_type": "mcp", "transport": "stdio", "name": "playwright", "command": "playwright-mcp", "args": ["--isolated", "--allowed-hosts", "*", "--no-sandbox", "--output-dir", "/o"], "required": True,
      "allow_tools": [], "deny_tools": ["browser_install"], "env": {}, "default_tools_approval_mode": "approve", "start_mode": "lazy",
      "playwright": {"output_dir": "/o", "capture_final_screenshot": False, "final_screenshot_filename": "fixture-final.png"}}),
    ("schema", """agent.tool.schema_match(array('{"properties": {"q": {"type": "string"}}, "required": ["q"]}'), array('q=x'), '{"q": 3}')""",
     {"score": 0.0, "construction_failure_type": "wrong_argument_value", "malformed_fields": ["q"], "actual_call": '{"q": 3}', "reason": "The tool call does not match the structured schema and expected properties.",
      "expected_call": '{"contains": {}, "equals": {"q": "x"}, "properties": {"q": {"type": "string"}}, "required": ["q"]}'}),
    ("steps", """agent.trajectory.step_adherence(parse_json('{"expected_steps": [{"id": "a"}, {"id": "b"}], "observed_steps": [{"id": "1", "matches_expected_ids": ["b"]}, {"id": "2", "matches_expected_ids": ["a"]}]}'), 'in_order')""",
     {"score": 0.0, "label": "fail", "ordering_policy": "in_order", "matched_steps": ["a", "b"], "missing_steps": [], "out_of_order_steps": ["b"], "extra_steps": [], "reason": "Observed steps do not satisfy the in_order expected-step policy."}),
    ("fence", "string.extract_from_fence('x\\n```json\\n{}\\n```\\n```\\nb\\n```', NULL)", [["json", "{}"], ["", "b"]]),
    ("fence kind", "string.extract_from_fence('```sql\\nSELECT 1\\n```', 'SQL')", ["SELECT 1"]),
    ("f1", f"agent.ragas.tool_call_f1('{_CALLS}', '{_WANTED}')", {"value": 0.5, "reason": "1 of 2 calls are among the 2 wanted"}),
    ("accuracy", f"agent.ragas.tool_call_accuracy('{_CALLS}', '{_WANTED}', false)", {"value": 0.0, "reason": "1 of 2 calls agree, in another order"}),
    ("datacompy", "agent.ragas.execution_based_datacompy_score('a,b\\n1,2\\n3,4', 'a,b\\n1,2\\n5,6', 'rows', 'precision')", {"value": 0.5, "reason": "1 rows are the same"}),
    ("unzip", f"zip.unzip('{_ZIP}', '[\"a.txt\"]')", "BEGIN DOCUMENT 1:\nhi\nEND DOCUMENT 1"),
    ("unzip cut", f"zip.unzip('{_ZIP}', '[\"a.txt\"]', 8)", "BEGIN DO"),
    ("json", "data.parse_json('{\"b\":1,\"a\":[true]}')", '{"b": 1, "a": [true]}'),
    ("json empty", "data.parse_json('')", None),
    ("csv", "data.parse_csv('a;b\\n1;2', ';', NULL, true, 5)", '{"columns": ["a", "b"], "rows": [{"a": "1", "b": "2"}], "row_count": 1, "truncated": false}'),
]


def _as_variant(value):
    """A value as a VARIANT writes it: whole numbers without a fraction."""
    if isinstance(value, float) and value.is_integer():
        return int(value)
    if isinstance(value, list):
        return [_as_variant(v) for v in value]
    return {k: _as_variant(v) for k, v in value.items()} if isinstance(value, dict) else value


def _fixed_sql() -> str:
    text = lambda v: "NULL" if v is None else "'" + (v if isinstance(v, str) else json.dumps(_as_variant(v), sort_keys=True, separators=(",", ":"))).replace("'", "''") + "'"
    return "SELECT * FROM (VALUES " + ", ".join(f"('{name}', {text(want)})" for name, _, want in FIXED) + ") AS t(name, result)"


@query(_fixed_sql())
def catalog_fixed(spark, d):
    """Deterministic functions of the catalog, called from a recipe's query, against the results that they must have."""
    context = Context(spark, tables={"one": CellFrame.wrap(spark.range(1)).df})
    out = None
    for name, call, _ in FIXED:
        value = lower_query(N.parse_query(f"SELECT {call} AS r FROM one"), context).unwrap()
        kind = value.schema["r"].dataType.simpleString()
        row = value.select(F.lit(name).alias("name"), (F.to_json("r") if kind == "variant" else F.col("r").cast("string")).alias("result"))
        out = row if out is None else out.unionAll(row)
    return out


@query("SELECT n_nationkey, '{\"a\":[1,2],\"n\":' || n_nationkey || '}' AS content, 'nations/' || n_name || '.json' AS path, true AS same_size FROM nation")
def objectstore_round_trip(spark, d):
    """Write JSON objects into the run's folder, and read them back through their entries."""
    text = """CREATE BATCH TABLE written SELECT n_nationkey, objectstore.write_json('nations/' || n_name || '.json', parse_json('{"n":' || n_nationkey || ',"a":[1,2]}')) AS e, 'nations/' || n_name || '.json' AS path FROM nation;
              CREATE BATCH TABLE made SELECT n_nationkey, objectstore.read_json(e, path) AS content, e[0].path AS path, e[0].size_bytes = length(objectstore.read_text(e, path)) AS same_size FROM written;"""
    return stored.made(spark, d, text, "nation")


@query("SELECT n_nationkey, 'RUNTIME_PYTHON_ERROR' AS code FROM nation")
def objectstore_missing(spark, d):
    """Reading what isn't there is an error of the cell."""
    n = CellFrame.wrap(table(spark, d, "nation").select("n_nationkey", F.array(K.entry(path=F.lit("a"), object_uri=F.lit("file:///nowhere"))).alias("e")))
    f = _call(n, "objectstore.read_text", ["n_nationkey"], entries=n["e"], path=A.literal("b"))
    return f.df.select("n_nationkey.value", f.first_code("result").alias("code")).toDF("n_nationkey", "code")
