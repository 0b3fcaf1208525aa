"""The fields of POOL inputs and the values that they take."""

from __future__ import annotations

import re
from typing import Any

from . import ast as N
from .surface import ScriptError

#: Fields by kind, with the form of their values: fixed names.
_WHOLE, _FROM_ZERO, _CPU, _MEMORY = "a positive whole number", "a whole number from 0", "a positive number", "a size like 2g or 512m"
EXECUTOR = {
    "min_workers": _FROM_ZERO, "max_workers": _WHOLE, "cores_per_worker": _WHOLE, "memory_per_worker": _MEMORY, "task_cpus": _WHOLE, "max_parallel_stages": _WHOLE,
}
INSTANCES = {
    "min_instances": _FROM_ZERO, "min_warm": _FROM_ZERO, "max_instances": _WHOLE, "cpu_per_instance": _CPU, "memory_per_instance": _MEMORY, "timeout_seconds": _WHOLE,
    "lease_ttl_seconds": _WHOLE, "reset_timeout_seconds": _WHOLE, "idle_ttl_seconds": _WHOLE,
}
FIELDS = {"executor": EXECUTOR, "service": INSTANCES, "session": INSTANCES, "sandbox": INSTANCES}
#: Fields of which the first may not be above the second.
BOUNDS = (("min_workers", "max_workers"), ("min_instances", "max_instances"), ("min_warm", "max_instances"))


def _fits(form: str, value: Any) -> bool:
    if form == _MEMORY:
        return isinstance(value, str) and re.fullmatch(r"[1-9]\d*\s*[kmgt]i?b?", value.strip().lower()) is not None
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return False
    if form == _CPU:
        return value > 0
    return isinstance(value, int) and value >= (0 if form == _FROM_ZERO else 1)


def check(kind: str, values: dict[str, Any]) -> dict[str, Any]:
    """The given fields of a pool of a kind; nulls are left out."""
    given = {str(k).strip().lower(): v for k, v in values.items() if v is not None}
    own = str(given.pop("kind", kind)).strip().lower()
    if own != kind:
        raise ScriptError(f"a pool of kind {kind} can't be {own}")
    for name, value in given.items():
        form = FIELDS[kind].get(name)
        if form is None:
            raise ScriptError(f"a pool of kind {kind} has no field {name}")
        if not _fits(form, value):
            raise ScriptError(f"{name} is {form}, not {value!r}")
    for low, high in BOUNDS:
        if low in given and high in given and given[low] > given[high]:
            raise ScriptError(f"{low} is above {high}")
    return {"kind": kind, **given}


def value_of(e: N.Expr | None) -> dict[str, Any]:
    """A default written as an object of literals, or as its text."""
    if e is None:
        return {}
    if isinstance(e, N.Literal) and isinstance(e.value, str):
        e = N.parse_expression(e.value)
    if not isinstance(e, N.MapLiteral) or not all(isinstance(v, N.Literal) for _, v in e.items):
        raise ScriptError("a POOL default is an object of literals")
    return {k: v.value for k, v in e.items}
