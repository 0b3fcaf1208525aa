"""The function catalog, project functions, and the binding of call arguments."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import partial
from typing import Any, get_args, get_type_hints

from pyspark.sql import Column
from pyspark.sql import types as T

from . import columns, native, simulation, specs

REQUIRED = object()


@dataclass(frozen=True)
class TimeoutConfig:
    """Seconds that a call, and its connecting, may take; given to project functions that have a parameter of this type."""

    total: float = 60.0
    connect: float = 20.0


@dataclass(frozen=True)
class RetryConfig:
    """How often a call is tried, the growth of the waits between and the longest wait; given in the same way."""

    tries: int = 3
    backoff: float = 1.1
    longest_wait: float = 600.0


class BindError(ValueError):
    """A call whose arguments don't fit its function."""


@dataclass(frozen=True)
class Parameter:
    name: str
    kind: str = "string"
    default: Any = REQUIRED


@dataclass(frozen=True)
class Function:
    """A callable of the catalog.

    python: over plain values, row by row in Arrow batches. column: builds a Spark expression. Neither: the
    function needs a network, and its calls give errored cells unless a transport is installed.
    """

    name: str
    parameters: tuple[Parameter, ...]
    returns: str = "string"
    python: Callable[..., Any] | None = None
    column: Callable[..., Column] | None = None
    needs: str = ""
    version: str = "1"
    controls: frozenset[str] = field(default_factory=lambda: frozenset(("limiter", "pool")))

    def bind(self, positional: list[Any], named: dict[str, Any]) -> dict[str, Any]:
        """Arguments by parameter: positional ones first, then named; absent optional ones are left out."""
        names = [p.name for p in self.parameters]
        if len(positional) > len(names):
            raise BindError(f"{self.name} takes {len(names)} arguments, {len(positional)} were given")
        bound = dict(zip(names, positional))
        for name, value in named.items():
            if name not in names:
                raise BindError(f"{self.name} has no argument {name}")
            if name in bound:
                raise BindError(f"{self.name} got {name} twice")
            bound[name] = value
        missing = [p.name for p in self.parameters if p.default is REQUIRED and p.name not in bound]
        if missing:
            raise BindError(f"{self.name} lacks {', '.join(missing)}")
        return bound


def parameters(text: str) -> tuple[Parameter, ...]:
    """`name type, name? type, ...`; a question mark makes an argument optional, the type is string if not given."""
    out = []
    for part in filter(None, (p.strip() for p in _split(text))):
        name, _, kind = part.partition(" ")
        optional = name.endswith("?")
        out.append(Parameter(name.rstrip("?"), kind.strip() or "string", None if optional else REQUIRED))
    return tuple(out)


def _split(text: str) -> list[str]:
    out, depth, at = [], 0, 0
    for i, ch in enumerate(text):
        depth += (ch in "<(") - (ch in ">)")
        if ch == "," and not depth:
            out.append(text[at:i])
            at = i + 1
    return [*out, text[at:]]


class Registry:
    """Functions by name; names of the catalog can't be taken by others."""

    def __init__(self, catalog: bool = True) -> None:
        self.functions: dict[str, Function] = {}
        self.builtin = frozenset(CATALOG) if catalog else frozenset()
        self.transports: dict[str, Callable[..., Any]] = {}
        self.object_folder: str | None = None
        self._aliases: dict[str, str] = {}
        self._aliased = 0
        if catalog:
            self.functions |= CATALOG

    def add(self, function: Function) -> Function:
        if function.name in self.builtin:
            raise ValueError(f"{function.name} is a function of the catalog")
        if function.name in self.functions:
            raise ValueError(f"{function.name} is registered already")
        self.functions[function.name] = function
        return function

    def transport(self, prefix: str, call: Callable[..., Any]) -> None:
        """What calls of network functions whose names start with a prefix go to: call(name, arguments)."""
        self.transports[prefix] = call

    def objects(self, folder: str) -> None:
        """Where objectstore.write_* put what they store: a folder that all executors share."""
        self.object_folder = folder

    def get(self, name: str) -> Function:
        name = self.named(name)
        if name not in self.functions:
            raise BindError(f"unknown function {name}")
        f = self.functions[name]
        if name in STORING and self.object_folder:
            return replace(f, python=partial(STORING[name], root=self.object_folder), needs="")
        if f.python is None and f.column is None:
            for prefix, call in self.transports.items():
                if name.startswith(prefix):
                    return Function(f.name, f.parameters, f.returns, lambda _name=name, _call=call, **kw: _call(_name, kw), None, "", f.version)
        return f

    def named(self, name: str) -> str:
        """A function's own name: `ns_f` is another one for `ns.f`."""
        if name in self.functions or "." in name:
            return name
        if self._aliased != len(self.functions):
            self._aliases, self._aliased = {n.replace(".", "_"): n for n in self.functions if "." in n}, len(self.functions)
        return self._aliases.get(name, name)

    def __contains__(self, name: str) -> bool:
        return self.named(name) in self.functions

    def callback(self, name: str, least: int = 1) -> Callable[..., Any]:
        """A function that another one is given, by its name: it must be written in Python and take enough arguments."""
        f = self.get(name)
        if f.python is None:
            raise BindError(f"{name} can't be called back: it needs a {f.needs}")
        if len(f.parameters) < least:
            raise BindError(f"{name} takes no argument; what is called back takes {least} at least")
        return f.python

    def own(self) -> dict[str, Callable[..., Any]]:
        """The Python functions that are no part of the catalog."""
        return {n: f.python for n, f in self.functions.items() if n not in self.builtin and f.python is not None}

    def keywords(self) -> frozenset[str]:
        """Names without a point, which take `name = value` arguments too."""
        return frozenset(n if "." not in n else n.replace(".", "_") for n in self.functions)


def stub(name: str, arguments: dict[str, Any]) -> str:
    """A transport for tests: the call as text."""
    return f"{name}({', '.join(f'{k}={v!r}' for k, v in arguments.items())})"


_SPARK_OF = {str: "string", int: "bigint", float: "double", bool: "boolean", bytes: "binary", dict: "variant", list: "array<string>", Any: "variant"}


def spark_kind(annotation: Any) -> str:
    """The Spark type of a Python annotation; Optional[T] is T."""
    if annotation in _SPARK_OF:
        return _SPARK_OF[annotation]
    args = [a for a in get_args(annotation) if a is not type(None)]
    origin = getattr(annotation, "__origin__", None)
    if origin is list and args:
        return f"array<{spark_kind(args[0])}>"
    if origin is dict and len(args) == 2:
        return f"map<{spark_kind(args[0])},{spark_kind(args[1])}>"
    if len(args) == 1:
        return spark_kind(args[0])
    if inspect.isclass(annotation) and getattr(annotation, "__annotations__", None):
        return "struct<" + ",".join(f"{k}:{spark_kind(v)}" for k, v in get_type_hints(annotation).items()) + ">"
    return "variant"


def function(name: str | None = None, version: str = "1"):
    """Decorator: a Python function with annotations as a catalog function `local.<name>`."""

    def wrap(fn: Callable[..., Any]) -> Callable[..., Any]:
        hints = get_type_hints(fn)
        own = inspect.signature(fn).parameters.values()
        # Timeouts and retries aren't arguments of the call: the framework supplies them.
        supplied = {p.name: hints[p.name]() for p in own if hints.get(p.name) in (TimeoutConfig, RetryConfig)}
        params = tuple(Parameter(p.name, spark_kind(hints.get(p.name, str)), REQUIRED if p.default is inspect.Parameter.empty else p.default) for p in own if p.name not in supplied)
        call = partial(fn, **supplied) if supplied else fn
        fn.__evalloom__ = Function(f"local.{name or fn.__name__}", params, spark_kind(hints.get("return", str)), call, None, "", version)
        return fn

    return wrap


# JSON-schema types to Spark, for functions described by manifests.
_SCHEMA_KINDS = {"string": "string", "integer": "int", "number": "double", "boolean": "boolean", "null": "string", "json": "variant", "variant": "variant"}


def schema_kind(schema: dict | None) -> str:
    if not isinstance(schema, dict):
        return "string"
    kind = schema.get("type")
    if kind == "integer" and schema.get("format") == "int64":
        return "bigint"
    if kind == "array":
        return f"array<{schema_kind(schema.get('items'))}>"
    if kind == "object":
        if isinstance(schema.get("additionalProperties"), dict):
            return f"map<string,{schema_kind(schema['additionalProperties'])}>"
        inner = ",".join(f"{k}:{schema_kind(v)}" for k, v in (schema.get("properties") or {}).items())
        return f"struct<{inner}>" if inner else "variant"
    return _SCHEMA_KINDS.get(kind, "string")


def from_manifest(manifest: dict, python: Callable[..., Any] | None = None) -> Function:
    """A function described by a JSON manifest {name, arguments: [{name, schema, required}], returns}."""
    if not isinstance(manifest.get("name"), str) or not isinstance(manifest.get("arguments", []), list):
        raise ValueError("a manifest needs a name and a list of arguments")
    params = tuple(Parameter(a["name"], schema_kind(a.get("schema")), REQUIRED if a.get("required", True) else None) for a in manifest.get("arguments", []))
    return Function(manifest["name"], params, schema_kind(manifest.get("returns")), python, None, "" if python else "transport", str(manifest.get("version", "1")))


# --- the catalog --------------------------------------------------------------------------------------------------

CATALOG: dict[str, Function] = {}


def _add(name: str, params: str, returns: str = "string", python=None, column=None, needs: str = "") -> None:
    CATALOG[name] = Function(name, parameters(params), returns, python, column, needs)


_ENTRIES = "array<struct<" + ",".join(f"{n}:{ {'is_empty_dir': 'boolean', 'size_bytes': 'bigint'}.get(n, 'string')}" for n in native.ENTRY_FIELDS) + ">>"
_ENTRY = _ENTRIES[6:-1]

_add("ranking.elo_expected_score", "rating_a double, rating_b double", "double", native.expected_score, columns.elo_expected_score)
_add("ranking.elo_rating_delta", "rating_a double, rating_b double, outcome_a? double, k_factor? double", "double", native.rating_delta, columns.elo_rating_delta)
_add(
    "ranking.elo_final_rating", "target_model, model_a_seq array<string>, model_b_seq array<string>, outcome_a_seq array<double>, k_factor? double, initial_rating? double",
    "double", native.final_rating, columns.elo_final_rating,
)
_add("string.extract_from_fence", "content, fence_type?", "variant", native.fenced_blocks)
_add("agent.tool.schema_match", "tool_schema array<string>, expected_call_properties array<string>, tool_call", "variant", native.schema_match)
_add("agent.trajectory.step_adherence", "alignment variant, ordering_policy?", "variant", native.step_adherence)
_add("data.parse_json", "content", "string", native.parse_json)
_add("data.parse_csv", "content, delimiter?, quotechar?, has_header? boolean, max_rows? int", "string", native.parse_csv)
_add("data.parse_parquet", "content_base64, columns_csv?, max_rows? int", "string", native.parse_parquet)
_add("data.parse_pdf", "content_base64, max_pages? int, max_chars? int", "string", native.parse_pdf)
_add("zip.unzip", "content_base64, member_paths_json, max_chars? int", "string", native.unzip)
_add("zip.untar", "content_base64, member_paths_json, max_chars? int", "string", native.untar)
_add(
    "objectstore.entry",
    "dataset_path, name, parent_path?, entry_type?, size_bytes? bigint, content_type?, sha256?, object_uri?, is_empty_dir? boolean",
    _ENTRY, None, columns.entry,
)
_add("objectstore.exists", f"entries {_ENTRIES}, path", "boolean", native.exists, columns.entries_exist)
_add("objectstore.find", f"entries {_ENTRIES}, path", _ENTRY, native.find_entry, columns.entries_find)
_add("objectstore.glob", f"entries {_ENTRIES}, pattern", _ENTRIES, native.glob_entries)
_add("objectstore.read_text", f"entries {_ENTRIES}, path", "string", native.read_text)
_add("objectstore.read_json", f"entries {_ENTRIES}, path", "string", native.read_json)
# These store into the run's object folder, which Registry.objects() names.
_add("objectstore.write_text", "path, content, content_type?", _ENTRIES, needs="object folder")
_add("objectstore.write_json", "path, value variant", _ENTRIES, needs="object folder")
STORING = {"objectstore.write_text": native.write_text, "objectstore.write_json": native.write_json}
# Between an executor's own disk and the object folder: calls of Python projects, not of SQL.
_add("objectstore.upload", "local_path, artifact_path?, content_type?", _ENTRY, needs="local disk")
_add("objectstore.upload_all", "local_root, artifact_prefix?", _ENTRIES, needs="local disk")
_add("objectstore.download", f"entry {_ENTRY}, local_path", "string", needs="local disk")
_add("objectstore.download_all", f"entries {_ENTRIES}, local_root", "string", needs="local disk")
_add("agent.ragas.tool_call_accuracy", "user_input, reference_tool_calls, strict_order? boolean", "variant", native.tool_call_accuracy)
_add("agent.ragas.tool_call_f1", "user_input, reference_tool_calls, batch_size? int, is_multi_turn? boolean", "variant", lambda user_input, reference_tool_calls, **_: native.tool_call_f1(user_input, reference_tool_calls))
_add("agent.ragas.execution_based_datacompy_score", "reference, response, mode?, metric_name?", "variant", lambda reference, response, mode=None, metric_name=None: native.datacompy_score(reference, response, mode or "rows", metric_name or "f1"))
#: Judged by a language model; arguments beside the judge's own two.
JUDGED = {
    "agent_goal_accuracy": "user_input, reference?",
    "aspect_critic": "user_input, response, reference?, retrieved_contexts? array<string>, reference_contexts? array<string>, definition?, strictness? int, rubrics?",
    "simple_criteria_scoring": "user_input, response, reference?, retrieved_contexts? array<string>, reference_contexts? array<string>, definition?, strictness? int, rubrics?",
    "rubrics_based_scoring": "user_input, response, reference?, retrieved_contexts? array<string>, reference_contexts? array<string>, rubrics?",
    "instance_specific_rubrics_scoring": "user_input, response, reference?, retrieved_contexts? array<string>, reference_contexts? array<string>, rubrics?",
    "context_entities_recall": "reference, retrieved_contexts array<string>",
    "context_precision": "user_input, reference, retrieved_contexts array<string>",
    "context_recall": "user_input, retrieved_contexts array<string>, reference",
    "faithfulness": "user_input, response, retrieved_contexts array<string>",
    "multimodal_faithfulness": "response, retrieved_contexts array<string>",
    "multimodal_relevance": "user_input, response, retrieved_contexts array<string>",
    "noise_sensitivity": "user_input, response, reference, retrieved_contexts array<string>, mode?",
    "response_relevancy": "user_input, response, strictness? int",
    "sql_query_equivalence": "response, reference, reference_contexts? array<string>",
    "summarization": "response, reference, length_penalty? boolean, coeff? double",
    "topic_adherence": "user_input, reference_topics array<string>, mode?",
}
for _name, _params in JUDGED.items():
    _add(f"agent.ragas.{_name}", f"{_params}, aisystem_id?, aisystem_parameters?, limiter?", "variant", needs="language model")
_add("agent.simple_agent.chat", "initial_data_json, tools_json?, user_simulator_json?, user_prompt?, max_turns? int, options?", "string", needs="language model")
#: Optional arguments of model calls, in their order: fixed names.
_CHAT = (
    "request_timeout? double, temperature? double, top_p? double, n? int, stream? boolean, stream_options? variant, stop? variant, max_completion_tokens? int, max_tokens? int, "
    "reasoning_effort?, presence_penalty? double, frequency_penalty? double, logit_bias? variant, user?, response_format? variant, seed? int, tools? variant, tool_choice?, "
    "parallel_tool_calls? boolean, logprobs? boolean, top_logprobs? int, safety_identifier?, deployment_id?, functions? variant, function_call?, base_url?, api_version?, api_key?, "
    "model_list? variant, api_base?, extra_headers? variant, secret_id?, limiter?, pool?"
)
_RESPONSES = (
    "input_value? variant, instructions?, request_timeout? double, temperature? double, top_p? double, max_output_tokens? int, stream? boolean, tools? variant, tool_choice? variant, user?, "
    "metadata? variant, response_format? variant, base_url?, api_base?, api_key?, extra_headers? variant, secret_id?, limiter?, pool?"
)
for _name in ("chat", "messages"):
    _add(f"aisystems.llm.{_name}", f"aisystem_id, messages variant, {_CHAT}", "variant", needs="language model")
_add("aisystems.llm.responses", f"prompt?, aisystem_id, {_RESPONSES}", "variant", needs="language model")
_add("aisystems.a2a.send_message", "aisystem_id, message, metadata?, context_id?, task_id?, secret_id?, limiter?", "variant", needs="network")
_LIMITS = "allow_redirects? boolean, max_bytes? int, limiter?"
_REQUEST = f"headers_json?, params_json?, {_LIMITS}"
_add("aisystems.http.get", f"aisystem_id, url, {_REQUEST}", "string", needs="network")
_add("aisystems.http.post", f"aisystem_id, url, headers_json?, params_json?, body?, json_body?, {_LIMITS}", "string", needs="network")
_add("http.get", f"url, {_REQUEST}", "string", needs="network")
_add("http.post", f"url, headers_json?, params_json?, body?, json_body?, {_LIMITS}", "string", needs="network")
_add("http.request", f"method, url, headers_json?, params_json?, body?, json_body?, {_LIMITS}", "string", needs="network")
_add("simulators.run", "input variant, user function, agent function, observers? variant, environments? variant, reuse?, limits? variant, limiter?", "variant", simulation.run)
_add("simulators.observer", "callback, schedule? array<string>, config? variant", "variant", specs.observer)
_add("simulators.limits", "max_turns? int, timeout_seconds? double", "variant", specs.limits)


def _spec(names: str, params: str, make: Callable[..., dict]) -> None:
    for name in names.split():
        _add(name, params, "variant", make)


_spec("envs.browser.spec", "session_id, start_url?, policy? variant, viewport? variant, locale?, timezone_id?, storage_state_path?", partial(specs.environment, "browser"))
_spec("envs.shell.spec", "session_id, cwd?, policy? variant, env? variant", partial(specs.environment, "shell"))
_spec("envs.agent_harness.spec agent_harness.spec", "session_id, aisystem, workdir, secret_id?, mcps? variant", partial(specs.environment, "agent_harness"))
_spec(
    "envs.mcp.http.spec mcps.http.spec", "name, endpoint, required? boolean, secret_id?, allow_tools? array<string>, deny_tools? array<string>, headers? variant, start_mode?",
    partial(specs.server, "http"),
)
_spec(
    "envs.mcp.stdio.spec mcps.stdio.spec",
    "name, command, args? array<string>, required? boolean, allow_tools? array<string>, deny_tools? array<string>, env? variant, default_tools_approval_mode?, start_mode?",
    partial(specs.server, "stdio"),
)
_spec(
    "envs.mcp.playwright.spec mcps.playwright.spec",
    "output_dir?, name?, headless? boolean, isolated? boolean, allowed_hosts? array<string>, allow_tools? array<string>, deny_tools? array<string>, capture_final_screenshot? boolean, "
    "final_screenshot_filename?, start_mode?, command?, args? array<string>",
    specs.playwright,
)
_spec("mcps.spec", "mcps variant", specs.servers)
for _name in ("navigate", "wait_for", "screenshot", "tabs", "call_tool"):
    _add(f"mcps.playwright.browser.{_name}", "spec variant, target?, arguments?", "variant", needs="browser")
for _name in ("envs.agent_harness.run_task", "agent_harness.run_task"):
    _add(_name, "env variant, task, timeout_seconds? double, transcript_file?, pool?, limiter?", "variant", needs="agent process")

#: Functions of tests.
TEST_FUNCTIONS = (
    Function("normalize_text", parameters("text"), "string", native.normalize_text),
    Function("extract_json_score", parameters("text"), "double", native.extract_json_score),
    Function("controlled_echo", parameters("text, limiter?"), "string", native.controlled_echo),
)

VARIANT = T.VariantType()
