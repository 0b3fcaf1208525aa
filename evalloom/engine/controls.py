"""Runtime controls: leases on named limits, thread-safe, with expiry and timeouts."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from typing import Any


class LeaseTimeout(TimeoutError):
    """No permit came free in time."""


class Leases:
    """Permits by key: at most so many at once; a lease that isn't returned in time lapses."""

    def __init__(self, ttl: float = 1200.0, clock=time.monotonic) -> None:
        self.ttl, self.clock = ttl, clock
        self._held: dict[str, dict[str, float]] = {}
        self._change = threading.Condition()

    def _lapse(self, key: str) -> dict[str, float]:
        held, now = self._held.setdefault(key, {}), self.clock()
        for lease in [k for k, until in held.items() if until <= now]:
            del held[lease]
        return held

    def acquire(self, key: str, most: int, timeout: float = 1200.0) -> str:
        if most < 1:
            raise ValueError("a limit is a positive number")
        end = self.clock() + timeout
        with self._change:
            while len(self._lapse(key)) >= most:
                left = end - self.clock()
                if left <= 0 or not self._change.wait(min(left, 0.5)) and self.clock() >= end:
                    raise LeaseTimeout(f"no permit for {key} within {timeout:g} s")
            lease = uuid.uuid4().hex
            self._held[key][lease] = self.clock() + self.ttl
            return lease

    def renew(self, key: str, lease: str) -> bool:
        with self._change:
            held = self._lapse(key)
            if lease in held:
                held[lease] = self.clock() + self.ttl
            return lease in held

    def release(self, key: str, lease: str) -> bool:
        with self._change:
            found = self._held.get(key, {}).pop(lease, None) is not None
            self._change.notify_all()
            return found

    def in_use(self, key: str) -> int:
        with self._change:
            return len(self._lapse(key))

    @contextmanager
    def permit(self, key: str, most: int, timeout: float = 1200.0) -> Iterator[str]:
        lease = self.acquire(key, most, timeout)
        try:
            yield lease
        finally:
            self.release(key, lease)


def fan_out(fn, items: list[Any], most: int, leases: Leases | None = None, key: str = "") -> list[Any]:
    """fn over the items in at most `most` threads, each call under its own lease; results in order."""
    leases = leases or Leases()

    def one(item):
        with leases.permit(key, most):
            return fn(item)

    with ThreadPoolExecutor(max(1, most)) as pool:
        return list(pool.map(one, items))
