"""The stored form of a cell: a value with its errors, latency and call trace."""

from __future__ import annotations

from pyspark.sql import types as T

ERROR = T.StructType(
    [
        T.StructField("code", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("recoverable", T.BooleanType()),
        T.StructField("cause_code", T.StringType()),
        T.StructField("cause_message", T.StringType()),
        T.StructField("details", T.MapType(T.StringType(), T.StringType())),
    ]
)
ERRORS = T.ArrayType(ERROR)

#: Fields of a call trace, in their order: a fixed layout.
TRACE_FIELDS = [
    ("schema_version", "string"), ("call_id", "string"), ("parent_call_id", "string"), ("trace_id", "string"), ("span_id", "string"), ("parent_span_id", "string"),
    ("function_name", "string"), ("runtime_alias", "string"), ("backend", "string"), ("fixture_id", "string"), ("image_id", "string"), ("execution_runtime", "string"),
    ("status", "string"), ("duration_ms", "bigint"), ("cache_hit", "boolean"), ("limiter_key", "string"), ("max_in_flight", "bigint"), ("pool_name", "string"),
    ("pool_kind", "string"), ("pool_node_id", "string"), ("http_status", "bigint"), ("error_code", "string"), ("error_message", "string"), ("error_type", "string"),
    ("artifact_count", "bigint"), ("summary", "string"), ("top_error", "string"), ("span_count", "bigint"), ("error_count", "bigint"),
    ("trace_summary_path", "string"), ("trace_spans_path", "string"),
]
TRACE = T.StructType([T.StructField(name, {"string": T.StringType(), "bigint": T.LongType(), "boolean": T.BooleanType()}[kind]) for name, kind in TRACE_FIELDS])

METADATA = T.StructType([T.StructField("errors", ERRORS), T.StructField("latency_ms", T.LongType()), T.StructField("trace", TRACE)])


def cell_type(value: T.DataType) -> T.StructType:
    return T.StructType(
        [T.StructField("cell_id", T.StringType()), T.StructField("value", value), T.StructField("metadata", METADATA), T.StructField("marker", T.BooleanType())]
    )


def is_cell(kind: T.DataType) -> bool:
    """A cell of the present layout."""
    return isinstance(kind, T.StructType) and kind.fieldNames() == ["cell_id", "value", "metadata", "marker"]


def is_old_cell(kind: T.DataType) -> bool:
    """A struct that has a cell's value and id but not the present layout; loading it is refused."""
    return isinstance(kind, T.StructType) and {"cell_id", "value"} <= set(kind.fieldNames()) and not is_cell(kind)


#: Codes of the errors that expressions raise.
CAST_ERROR = "CAST_ERROR"
JSON_PARSE_ERROR = "JSON_PARSE_ERROR"
JSON_ACCESS_ERROR = "JSON_ACCESS_ERROR"
ACCESS_ERROR = "ACCESS_ERROR"
PYTHON_ERROR = "RUNTIME_PYTHON_ERROR"
LOCAL_ERROR = "RUNTIME_LOCAL_FIXTURE_ERROR"
HTTP_ERROR = "RUNTIME_HTTP_ERROR"
NETWORK_ERROR = "RUNTIME_NETWORK_ERROR"
TIMEOUT_ERROR = "RUNTIME_TIMEOUT"
REMOTE_ERROR = "RUNTIME_REMOTE_ERROR"
STUB_ERROR = "RUNTIME_STUB_ERROR"
UNAVAILABLE = "UNAVAILABLE"
