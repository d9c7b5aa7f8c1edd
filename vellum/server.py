"""A line protocol for sessions: an engine behind a TCP port, and its client.

A request is one line of JSON, {"do": "query" | "execute" | "ping", "sql": ..., "args": [...]}. A query is answered by a line with its
columns, lines of rows, and a line with their number; rows are text, as CAST(x AS CHAR) gives it, and null. execute is answered by the number of
changed rows, and a statement that fails by the kind and text of its error. A connection is a session; what is open when it
closes is rolled back. There is no authentication: serve on a port that only trusted hosts reach.
"""

from __future__ import annotations

import json
import socket
import socketserver
import threading
from collections.abc import Iterator, Sequence
from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.session import Engine

#: Rows of a line.
ROWS = 1000


class ServerError(RuntimeError):
    """What the server says of a statement that failed."""


def as_text(df: DataFrame) -> DataFrame:
    """All columns as text."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        kind = f.dataType.simpleString()
        if kind == "interval hour to second":
            text = F.regexp_extract(c.cast("string"), "'([^']*)'", 1)
        elif kind == "binary":
            text = F.hex(c)
        else:
            text = F.to_json(c) if kind.startswith(("array", "map", "struct")) else c.cast("string")
        out.append(text.alias(f.name))
    return df.select(*out)


class _Handler(socketserver.StreamRequestHandler):
    def say(self, **what) -> None:
        self.wfile.write(json.dumps(what).encode() + b"\n")

    def handle(self) -> None:
        session = self.server.engine.session()
        try:
            for line in self.rfile:
                try:
                    self.answer(session, json.loads(line))
                except (BrokenPipeError, ConnectionError):
                    return
                except Exception as e:  # noqa: BLE001  the client is told what went wrong, whatever it is
                    self.say(error=type(e).__name__, message=str(e).splitlines()[0] if str(e) else "")
        finally:
            session.rollback()

    def answer(self, session, request: dict) -> None:
        if request["do"] == "ping":
            self.say(pong=session.store.ref("data"))
        elif request["do"] == "execute":
            if self.server.read_only and request["sql"].split()[0].upper() in ("INSERT", "UPDATE", "DELETE", "CREATE", "ALTER", "DROP"):
                raise PermissionError("the server is read only")
            self.say(changed=session.execute(request["sql"], request.get("args")))
        else:
            df = as_text(session.query(request["sql"], request.get("args")))
            self.say(columns=df.columns)
            rows, n = df.toLocalIterator(), 0
            while some := [list(r) for r in islice(rows, ROWS)]:
                n += len(some)
                self.say(rows=some)
            self.say(end=n)


class Server(socketserver.ThreadingTCPServer):
    """Serves an engine until it is closed. Port 0 takes a free one."""

    allow_reuse_address = daemon_threads = True

    def __init__(self, engine: Engine, host: str = "127.0.0.1", port: int = 0, read_only: bool = False):
        super().__init__((host, port), _Handler)
        self.engine, self.read_only = engine, read_only

    @property
    def port(self) -> int:
        return self.server_address[1]

    def start(self) -> Server:
        threading.Thread(target=self.serve_forever, daemon=True).start()
        return self

    def close(self) -> None:
        self.shutdown()
        self.server_close()


class Client:
    """A connection to a server."""

    def __init__(self, host: str, port: int, timeout: float | None = None):
        self.socket = socket.create_connection((host, port), timeout)
        self.file = self.socket.makefile("rb")
        self.columns: list[str] = []

    def _ask(self, **request) -> None:
        self.socket.sendall(json.dumps(request).encode() + b"\n")

    def _hear(self) -> dict:
        line = self.file.readline()
        if not line:
            raise ConnectionError("the server has closed the connection")
        answer = json.loads(line)
        if "error" in answer:
            raise ServerError(f"{answer['error']}: {answer['message']}")
        return answer

    def ping(self) -> str:
        self._ask(do="ping")
        return self._hear()["pong"]

    def execute(self, sql: str, args: Sequence | None = None) -> int:
        self._ask(do="execute", sql=sql, args=list(args or ()))
        return self._hear()["changed"]

    def rows(self, sql: str, args: Sequence | None = None) -> Iterator[tuple[str | None, ...]]:
        """Rows as they come; all of them must be taken before the next statement."""
        self._ask(do="query", sql=sql, args=list(args or ()))
        self.columns = self._hear()["columns"]
        while "end" not in (answer := self._hear()):
            yield from map(tuple, answer["rows"])

    def query(self, sql: str, args: Sequence | None = None) -> list[tuple[str | None, ...]]:
        return list(self.rows(sql, args))

    def close(self) -> None:
        self.file.close()
        self.socket.close()
