"""A small client of the service: one connection, retries, rows as dictionaries."""

from __future__ import annotations

import base64
import json
import socket
import time

import pyarrow as pa

from tessera.errors import EngineError
from tessera.sources.ingest import from_arrow_stream


class Client:
    def __init__(self, host: str, port: int, key: str | None = None, retries: int = 3, wait: float = 0.1):
        self.key, self.number = key, 0
        for attempt in range(retries + 1):
            try:
                self.socket = socket.create_connection((host, port))
                break
            except OSError:
                if attempt == retries:
                    raise
                time.sleep(wait * 2**attempt)
        self.reader = self.socket.makefile("rb")

    def call(self, method: str, **params) -> dict:
        self.number += 1
        self.socket.sendall(json.dumps({"id": self.number, "method": method, "params": params, "key": self.key}).encode() + b"\n")
        answer = json.loads(self.reader.readline())
        if "error" in answer:
            raise EngineError(answer["error"])
        return answer["result"]

    def query(self, sql: str, **options) -> list[dict]:
        return self.call("query", sql=sql, **options)["rows"]

    def query_arrow(self, sql: str) -> pa.Table:
        return from_arrow_stream(base64.b64decode(self.call("query", sql=sql, arrow=True)["arrow"]))

    def health(self) -> dict:
        return self.call("health")

    def close(self) -> None:
        self.socket.close()
