"""Permits across executors: the driver holds the leases, Python workers ask for them over a socket.

One line of JSON each way per request. A lease that a lost worker can't return lapses after its time.
"""

from __future__ import annotations

import json
import secrets
import socket
import socketserver
import threading
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import SparkSession

from .controls import Leases, LeaseTimeout


@dataclass(frozen=True)
class Permits:
    """The address that workers get; it travels with the functions that need permits."""

    host: str
    port: int
    token: str

    def _ask(self, timeout: float, **request) -> dict:
        with socket.create_connection((self.host, self.port), timeout=timeout + 10) as s:
            s.sendall((json.dumps({**request, "token": self.token, "timeout": timeout}) + "\n").encode())
            with s.makefile("r") as f:
                return json.loads(f.readline())

    @contextmanager
    def permit(self, key: str, most: int, timeout: float = 1200.0) -> Iterator[None]:
        """At most `most` holders of a key at once, wherever they run."""
        answer = self._ask(timeout, op="acquire", key=key, most=most)
        if "lease" not in answer:
            raise LeaseTimeout(answer.get("error", "no permit"))
        try:
            yield
        finally:
            self._ask(10.0, op="release", key=key, lease=answer["lease"])


class PermitServer:
    """Serves a run's leases from the driver while the run lasts."""

    def __init__(self, spark: SparkSession, leases: Leases | None = None) -> None:
        self.leases, token = leases or Leases(), secrets.token_hex(16)
        leases = self.leases

        class Handler(socketserver.StreamRequestHandler):
            def handle(self) -> None:
                request = json.loads(self.rfile.readline())
                if not secrets.compare_digest(str(request.get("token")), token):
                    return
                try:
                    if request["op"] == "acquire":
                        answer = {"lease": leases.acquire(request["key"], int(request["most"]), float(request["timeout"]))}
                    else:
                        answer = {"returned": leases.release(request["key"], request["lease"])}
                except (LeaseTimeout, ValueError) as e:
                    answer = {"error": str(e)}
                self.wfile.write((json.dumps(answer) + "\n").encode())

        class Server(socketserver.ThreadingTCPServer):
            daemon_threads = True
            request_queue_size = 1024

        host = spark.sparkContext.getConf().get("spark.driver.host", "localhost")
        local = spark.sparkContext.master.startswith("local")
        self._server = Server(("127.0.0.1" if local else "0.0.0.0", 0), Handler)
        self.permits = Permits("127.0.0.1" if local else host, self._server.server_address[1], token)
        threading.Thread(target=self._server.serve_forever, daemon=True).start()

    def close(self) -> None:
        self._server.shutdown()
        self._server.server_close()
