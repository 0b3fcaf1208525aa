"""Records that describe what a simulation needs: observers, limits, environments, tool servers.

Each kind is a table of its fields: how a value is read, and what it is if absent. The record names and defaults are
fixed values.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from .agents import as_json

REQUIRED = object()


def text(value: Any) -> str | None:
    """Trimmed text; null for blank."""
    return (str(value).strip() or None) if value is not None else None


def texts(value: Any) -> list[str]:
    value = as_json(value) if isinstance(value, str) and value.lstrip().startswith("[") else value
    if value is None:
        return []
    items = value if isinstance(value, (list, tuple)) else [value]
    return [t for t in (text(i) for i in items) if t]


def record(value: Any) -> dict:
    found = as_json(value) if isinstance(value, str) else value
    if found is None and text(value) is None:
        return {}
    if isinstance(found, list) and all(isinstance(p, (list, tuple)) and len(p) == 2 for p in found):
        return dict(found)
    if not isinstance(found, dict):
        raise ValueError("an object is needed")
    return found


def plain(value: Any) -> Any:
    """JSON text as its value, all else as it is."""
    found = as_json(value) if isinstance(value, str) else None
    return value if found is None else found


def flag(value: Any) -> bool:
    return bool(value) if not isinstance(value, str) else value.strip().lower() == "true"


def start_mode(value: Any) -> str:
    mode = (text(value) or "lazy").lower()
    if mode not in ("lazy", "eager"):
        raise ValueError(f"start mode {value} is not lazy or eager")
    return mode


Field = tuple[str, Callable[[Any], Any], Any]


def _read(kind: str, fields: tuple[Field, ...], given: dict[str, Any]) -> dict[str, Any]:
    out = {}
    for name, read, default in fields:
        value = given.get(name)
        value = read(value) if value is not None else None
        if value is None:
            if default is REQUIRED:
                raise ValueError(f"{kind} needs {name}")
            value = default() if callable(default) else default
        out[name] = value
    return out


#: Environments: their fields beside session_id; absent ones are left out of the config.
ENVIRONMENTS: dict[str, tuple[Field, ...]] = {
    "browser": (("start_url", str, None), ("policy", plain, None), ("viewport", plain, None), ("locale", str, None), ("timezone_id", str, None), ("storage_state_path", str, None)),
    "shell": (("cwd", str, None), ("policy", plain, None), ("env", plain, None)),
    "agent_harness": (("session_id", text, REQUIRED), ("aisystem", text, REQUIRED), ("workdir", text, "."), ("secret_id", text, None), ("mcps", lambda v: servers(v), None)),
}
#: Tool servers: all fields are part of the record.
SERVERS: dict[str, tuple[Field, ...]] = {
    "http": (
        ("name", text, REQUIRED), ("endpoint", text, REQUIRED), ("required", flag, False), ("secret_id", text, None), ("allow_tools", texts, list), ("deny_tools", texts, list),
        ("headers", record, dict), ("start_mode", start_mode, "lazy"),
    ),
    "stdio": (
        ("name", text, REQUIRED), ("command", text, REQUIRED), ("args", texts, list), ("required", flag, False), ("allow_tools", texts, list), ("deny_tools", texts, list),
        ("env", record, dict), ("default_tools_approval_mode", text, None), ("start_mode", start_mode, "lazy"),
    ),
}
SCHEDULES = ("after_turn", "final")
MAX_TURNS, TIMEOUT_SECONDS = 32, 300.0


def environment(kind: str, **given: Any) -> dict:
    session = text(given.get("session_id"))
    if session is None:
        raise ValueError(f"{kind} needs session_id")
    config = {k: v for k, v in _read(kind, ENVIRONMENTS[kind], given).items() if v is not None}
    return {"spec_type": "environment", "kind": kind, "env_id": session, "config": config}


def server(transport: str, **given: Any) -> dict:
    return {"spec_type": "mcp", "transport": transport, **_read(transport, SERVERS[transport], given)}


def playwright(**given: Any) -> dict:
    """A browser's tool server: a stdio server whose arguments follow from the options."""
    # (is it asked for, what the command line gets)
    hosts = texts(given.get("allowed_hosts")) or ["*"]
    place = text(given.get("output_dir"))
    options = [(given.get("headless") is not False, ["--headless"]), (given.get("isolated") is not False, ["--isolated"])]
    options += [(True, ["--allowed-hosts", h]) for h in hosts]
    options += [(True, ["--no-sandbox"]), (place is not None, ["--output-dir", place])]
    line = texts(given.get("args")) + [part for asked, parts in options if asked for part in parts]
    deny = given.get("deny_tools")
    made = server(
        "stdio", name=text(given.get("name")) or "playwright", command=text(given.get("command")) or "playwright-mcp", args=line, required=True, allow_tools=given.get("allow_tools"),
        deny_tools=["browser_install"] if deny is None else deny, default_tools_approval_mode="approve", start_mode=given.get("start_mode"),
    )
    shots = {"capture_final_screenshot": flag(given.get("capture_final_screenshot")), "final_screenshot_filename": text(given.get("final_screenshot_filename")) or "fixture-final.png"}
    return {**made, "playwright": {"output_dir": place, **shots}}


def servers(mcps: Any) -> dict:
    """Tool server records by name, from a map or a list of them."""
    found = plain(mcps)
    items = found.values() if isinstance(found, dict) and found.get("spec_type") != "mcp" else found if isinstance(found, list) else [found]
    out: dict[str, dict] = {}
    for item in map(plain, items):
        if not isinstance(item, dict) or item.get("spec_type") != "mcp" or not text(item.get("name")):
            raise ValueError("tool servers are records made by the mcps functions")
        if item["name"] in out:
            raise ValueError(f"tool server {item['name']} is given twice")
        out[item["name"]] = item
    return out


def observer(callback: Any, schedule: Any = None, config: Any = None) -> dict:
    wanted = texts(schedule) or ["final"]
    unknown = set(wanted) - set(SCHEDULES)
    if unknown:
        raise ValueError(f"an observer runs {' or '.join(SCHEDULES)}, not {', '.join(sorted(unknown))}")
    return {"spec_type": "simulator_observer", "callback": callback, "schedule": list(dict.fromkeys(wanted)), "config": record(config) if config is not None else {}}


def limits(max_turns: Any = None, timeout_seconds: Any = None) -> dict:
    turns = MAX_TURNS if max_turns is None else int(max_turns)
    seconds = TIMEOUT_SECONDS if timeout_seconds is None else float(timeout_seconds)
    if turns < 1 or seconds <= 0:
        raise ValueError("limits are positive")
    return {"spec_type": "simulator_limits", "max_turns": turns, "timeout_seconds": seconds}
