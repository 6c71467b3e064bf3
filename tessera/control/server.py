"""A service over a session: JSON lines on TCP, or the same messages as WebSocket text frames, with keys, limits and metering.

A request is ``{"id": .., "method": .., "params": {..}, "key": ".."}``. Methods: query, register_table, register_rule,
load_model, health. Results are sent as rows up to ``limit``, and as an Arrow stream (base64) if asked for.
"""

from __future__ import annotations

import base64
import hashlib
import json
import socketserver
import struct
import threading
from dataclasses import asdict

from tessera.control.limits import TIERS, Meter, TokenBucket, tier_of
from tessera.errors import EngineError
from tessera.hitl import explainer
from tessera.session import QueryResult, Session
from tessera.sources.ingest import arrow_stream

ROW_LIMIT = 1000
_WEBSOCKET = "258EAFA5-E914-47DA-95CA-C5AB0DC85B11"  # fixed by the protocol


class Service:
    """Dispatch of requests; one lock, as a session's rules and tables are shared by its callers."""

    def __init__(self, session: Session, keys_required: bool = False):
        self.session, self.keys_required = session, keys_required
        self.meter, self.buckets, self.lock = Meter(), {}, threading.Lock()

    def _admit(self, key: str | None) -> str:
        tier = tier_of(key)
        if tier is None:
            if self.keys_required:
                raise EngineError("a valid key is required")
            return "anonymous"
        if not self.buckets.setdefault(key, TokenBucket(*TIERS[tier])).allow():
            raise EngineError("rate limit exceeded")
        return key

    def handle(self, request: dict) -> dict:
        try:
            tenant = self._admit(request.get("key"))
            method = getattr(self, f"do_{request.get('method')}", None)
            if method is None:
                raise EngineError(f"no method {request.get('method')!r}")
            with self.lock:
                result = method(request.get("params") or {})
            self.meter.record(tenant, int(result.get("row_count", 0)))
            return {"id": request.get("id"), "result": result}
        except Exception as e:  # every failure is an answer; the connection stays
            return {"id": request.get("id"), "error": f"{type(e).__name__}: {e}"[:2000]}

    def do_query(self, p: dict) -> dict:
        """One run: rows and provenance come from it, and the monitor's verdict on them rides along."""
        result = self.session.sql(p["sql"])
        limit = int(p.get("limit", ROW_LIMIT))
        frame, verdict = QueryResult(result.frame.limit(limit), result.mode, result.monitor, result.model).observed()
        table = frame.toArrow()
        if p.get("arrow"):
            data = arrow_stream(table)
            body = {"arrow": base64.b64encode(data).decode(), "ipc_bytes": len(data), "row_count": table.num_rows}
        else:
            body = {"rows": table.to_pylist(), "row_count": table.num_rows}
        told = table["provenance"].slice(0, 20).to_pylist() if "provenance" in table.column_names else []
        return {"columns": frame.columns, "reasoning": explainer.told(told, result.mode), "anomalies": [asdict(a) for a in verdict()], "model": result.model} | body

    def do_register_table(self, p: dict) -> dict:
        self.session.register_table(p["name"], p["path"])
        return {"table": p["name"]}

    def do_register_rule(self, p: dict) -> dict:
        return {"rule": p["name"], "class": self.session.register_rule(p["name"], p["source"]).klass}

    def do_load_model(self, p: dict) -> dict:
        options = {k: p[k] for k in ("version", "latency_ms", "accuracy", "features") if k in p}
        return {"model_id": self.session.load_model(p["function_id"], p["path"], **options)}

    def do_health(self, p: dict) -> dict:
        s = self.session
        return {"status": "ok", "table_count": len(s.tables), "rule_count": len(s.rules), "model_count": len(s.registry.models)}


def _encode(message: dict) -> bytes:
    return json.dumps(message, default=lambda v: base64.b64encode(v).decode() if isinstance(v, (bytes, bytearray)) else str(v)).encode()


class _Handler(socketserver.StreamRequestHandler):
    def handle(self) -> None:
        first = self.rfile.readline()
        if first.startswith(b"GET "):
            return self._websocket()
        line = first
        while line:
            if line.strip():
                self.wfile.write(self._answer(line) + b"\n")
            line = self.rfile.readline()

    def _answer(self, data: bytes) -> bytes:
        try:
            return _encode(self.server.service.handle(json.loads(data)))
        except ValueError as e:
            return _encode({"id": None, "error": f"not JSON: {e}"})

    def _websocket(self) -> None:
        key = ""
        while (line := self.rfile.readline().strip()) != b"":
            name, _, value = line.decode("latin-1").partition(":")
            if name.lower() == "sec-websocket-key":
                key = value.strip()
        token = base64.b64encode(hashlib.sha1((key + _WEBSOCKET).encode()).digest()).decode()
        self.wfile.write(f"HTTP/1.1 101 Switching Protocols\r\nUpgrade: websocket\r\nConnection: Upgrade\r\nSec-WebSocket-Accept: {token}\r\n\r\n".encode())
        while (frame := self._frame()) is not None:
            data = self._answer(frame)
            size = len(data)
            head = bytes([0x81, size]) if size < 126 else bytes([0x81, 126]) + struct.pack(">H", size) if size < 65536 else bytes([0x81, 127]) + struct.pack(">Q", size)
            self.wfile.write(head + data)

    def _frame(self) -> bytes | None:
        head = self.rfile.read(2)
        if len(head) < 2 or head[0] & 15 == 8:
            return None
        size = head[1] & 127
        if size >= 126:
            size = struct.unpack(">H", self.rfile.read(2))[0] if size == 126 else struct.unpack(">Q", self.rfile.read(8))[0]
        mask = self.rfile.read(4) if head[1] & 128 else b"\0\0\0\0"
        return bytes(b ^ mask[i % 4] for i, b in enumerate(self.rfile.read(size)))


class Server(socketserver.ThreadingTCPServer):
    allow_reuse_address, daemon_threads = True, True

    def __init__(self, session: Session, host: str = "127.0.0.1", port: int = 0, keys_required: bool = False):
        self.service = Service(session, keys_required)
        super().__init__((host, port), _Handler)
        self.port = self.server_address[1]
