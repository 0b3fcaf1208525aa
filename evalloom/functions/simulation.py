"""Simulated dialogues: an agent and a user answer each other until the user ends it or a limit is reached.

agent(request, state, environments, turn) gives {response, state?}; user(response, state, environments, turn) gives
{request, terminate?, state?}, and ends the dialogue unless terminate is false. Observers look on after each turn or
at the end: callback(event, state, environments) gives {observation, artifacts?, state?}. Callbacks may be async, and
may leave out parameters from the right.
"""

from __future__ import annotations

import asyncio
import inspect
import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from . import specs

#: Status words and error codes of results: fixed values.
COMPLETED, FAILED, TIMED_OUT, OUT_OF_TURNS = "completed", "failed", "timeout", "max_turns"


class Ended(Exception):
    """The dialogue can't go on; why, as status and error."""

    def __init__(self, status: str, code: str, message: str, retryable: bool = False) -> None:
        super().__init__(message)
        self.status, self.error = status, {"code": code, "message": message, "retryable": retryable}


@dataclass
class Dialogue:
    """One run: its callbacks, what has been said, and when it has to be over."""

    agent: Callable[..., Any]
    user: Callable[..., Any]
    observers: list[tuple[Callable[..., Any], dict]]
    environments: Any
    deadline: float
    state: dict[str, Any] = field(default_factory=dict)
    turns: list[dict] = field(default_factory=list)
    observations: list[dict] = field(default_factory=list)
    artifacts: list[Any] = field(default_factory=list)

    def seen(self) -> dict[str, Any]:
        return {**self.state, "turns": list(self.turns), "observations": list(self.observations)}

    def ask(self, callback: Callable[..., Any], wanted: str, *given: Any) -> dict[str, Any]:
        """A callback's answer, which must have the wanted field; its state is taken over."""
        if time.monotonic() > self.deadline:
            raise Ended(TIMED_OUT, TIMED_OUT, "the simulation ran out of time", True)
        parameters = inspect.signature(callback).parameters.values()
        many = any(p.kind is inspect.Parameter.VAR_POSITIONAL for p in parameters)
        answer = callback(*(given if many else given[: len(parameters)]))
        if inspect.isawaitable(answer):
            try:
                answer = asyncio.run(asyncio.wait_for(_own(answer), max(0.01, self.deadline - time.monotonic())))
            except TimeoutError as e:
                raise Ended(TIMED_OUT, TIMED_OUT, "the simulation ran out of time", True) from e
        if not isinstance(answer, Mapping) or wanted not in answer:
            raise ValueError(f"a callback gave no {wanted}")
        if isinstance(answer.get("state"), Mapping):
            self.state.update({k: v for k, v in answer["state"].items() if k not in ("turns", "observations")})
        return dict(answer)

    def turn(self, no: int, request: Any) -> tuple[bool, Any]:
        """One exchange: is it the last one, and the next request or what came out in the end."""
        record = {"turn": no, "request": request, "response": None, "user_request": None, "terminate": None, "error": None}
        self.turns.append(record)
        try:
            said = self.ask(self.agent, "response", request, self.seen(), self.environments, no)
            record["response"] = said["response"]
            answer = self.ask(self.user, "request", said["response"], self.seen(), self.environments, no)
        except Ended as e:
            record["error"] = e.error
            raise
        except Exception as e:
            record["error"] = {"code": type(e).__name__, "message": str(e), "retryable": False}
            raise
        last = answer.get("terminate")
        record["user_request"], record["terminate"] = answer["request"], True if last is None else bool(last)
        self.look("after_turn", no)
        return record["terminate"], answer["request"]

    def look(self, when: str, no: int) -> None:
        for callback, spec in self.observers:
            if when in spec["schedule"]:
                event = {"schedule": when, "turn": no, "config": spec.get("config") or {}}
                got = self.ask(callback, "observation", event, self.seen(), self.environments)
                made = list(got.get("artifacts") or ())
                self.observations.append({"turn": no, "schedule": when, "callback": spec.get("callback"), "observation": got["observation"], "artifacts": made})
                self.artifacts += made


async def _own(awaitable):
    return await awaitable


def run(
    input: Any, user: Callable[..., Any], agent: Callable[..., Any], observers: Any = None, environments: Any = None, reuse: Any = None, limits: Any = None, limiter: Any = None,
    functions: dict[str, Callable] | None = None,
) -> dict[str, Any]:
    """The record of a dialogue: ok, status, final_output, turns, observations, artifacts, error, duration_ms.

    functions: what observers' callbacks may name.
    """
    began = time.monotonic()
    bounds = specs.record(limits) if limits is not None else {}
    bounds = specs.limits(bounds.get("max_turns"), bounds.get("timeout_seconds"))
    looked = specs.plain(observers) or []
    looked = [specs.plain(o) for o in (looked if isinstance(looked, list) else [looked])]
    unknown = [o.get("callback") for o in looked if o.get("callback") not in (functions or {})]
    if unknown:
        raise ValueError(f"observers call unknown functions: {', '.join(map(str, unknown))}")
    if specs.plain(environments):
        raise ValueError("environments need their processes, which this engine doesn't start")
    talk = Dialogue(agent, user, [(functions[o["callback"]], o) for o in looked], {}, began + bounds["timeout_seconds"])
    talk.state["metadata"] = {"reuse": reuse}
    request, out, status, error = specs.plain(input), None, OUT_OF_TURNS, None
    try:
        for no in range(1, bounds["max_turns"] + 1):
            last, request = talk.turn(no, request)
            out = request if last else talk.turns[-1]["response"]
            if last:
                status = COMPLETED
                break
        else:
            error = {"code": OUT_OF_TURNS, "message": f"no end within {bounds['max_turns']} turns", "retryable": False}
    except Ended as e:
        status, error = e.status, e.error
    except Exception as e:  # noqa: BLE001
        status, error = FAILED, {"code": type(e).__name__, "message": str(e), "retryable": False}
    if status != TIMED_OUT:
        try:
            talk.look("final", talk.turns[-1]["turn"] if talk.turns else 0)
        except Exception as e:  # noqa: BLE001
            status, error = FAILED, {"code": type(e).__name__, "message": str(e), "retryable": False}
    return {
        "ok": status == COMPLETED, "status": status, "final_output": out, "turns": talk.turns, "observations": talk.observations, "artifacts": talk.artifacts, "error": error,
        "duration_ms": int((time.monotonic() - began) * 1000),
    }
