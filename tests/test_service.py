"""Server, client, command line, distillation, measured pipelines."""

import base64
import json
import os
import socket
import struct
import threading

import pytest

from tessera.cli import Repl, main
from tessera.control.client import Client
from tessera.control.packs import Hub
from tessera.control.pipeline import PipelineReport
from tessera.control.server import Server
from tessera.errors import EngineError
from tessera.hitl import lineage
from tessera.models.distill import distill
from tessera.models.operators import LinearOperator
from tessera.session import Config, Session


@pytest.fixture()
def session(spark):
    s = Session(spark, Config(provenance="polynomial"))
    s.register_table("t", spark.sql("SELECT id, id / 10D AS score FROM range(10)"))
    return s


@pytest.fixture()
def server(session):
    with Server(session) as found:
        threading.Thread(target=found.serve_forever, daemon=True).start()
        yield found
        found.shutdown()


def test_server_and_client(server, spark, tmp_path):
    c = Client("127.0.0.1", server.port, key="sk-team-x")
    assert c.health()["table_count"] == 1
    assert c.call("register_rule", name="r", source="score > 0.65")["class"] == "A"
    assert len(c.query("SELECT * FROM t")) == 3
    assert c.query_arrow("SELECT id FROM t").num_rows == 10
    spark.range(4).write.parquet(f"{tmp_path}/n")
    c.call("register_table", name="n", path=f"{tmp_path}/n")
    assert c.query("SELECT count(*) AS c FROM n")[0]["c"] == 4
    for bad in (lambda: c.call("nothing"), lambda: c.query("SELECT no FROM t")):
        with pytest.raises(EngineError):
            bad()
    assert server.service.meter.read_and_reset("sk-team-x")[0] >= 5
    c.close()


def test_websocket(server):
    s = socket.create_connection(("127.0.0.1", server.port))
    s.sendall(b"GET / HTTP/1.1\r\nUpgrade: websocket\r\nSec-WebSocket-Key: " + base64.b64encode(os.urandom(16)) + b"\r\n\r\n")
    f = s.makefile("rb")
    while f.readline().strip():
        pass
    data, mask = json.dumps({"id": 1, "method": "health"}).encode(), b"abcd"
    s.sendall(bytes([0x81, 0x80 | len(data)]) + mask + bytes(b ^ mask[i % 4] for i, b in enumerate(data)))
    head = f.read(2)
    size = head[1] if head[1] < 126 else struct.unpack(">H", f.read(2))[0]
    assert json.loads(f.read(size))["result"]["status"] == "ok"
    s.close()


def test_keys_and_limits(session):
    from tessera.control.server import Service

    service = Service(session, keys_required=True)
    assert "key" in service.handle({"id": 1, "method": "health"})["error"]
    answers = [service.handle({"id": i, "method": "health", "key": "sk-free"}) for i in range(12)]
    assert "result" in answers[0] and "rate limit" in answers[-1]["error"]


def test_repl(session, tmp_path):
    repl = Repl(session, Hub(str(tmp_path / "hub")), model=lambda prompt: "r(X) :- t(X), X.score > 0.75.")
    assert "10 row(s)" in repl.run("SELECT id FROM t")
    assert "class A" in repl.run(".logic low score < 0.25") and "3 row(s)" in repl.run("SELECT * FROM t;")
    assert repl.run(".drop low") == "dropped" and "event-quality" in repl.run(".hub search stream")
    assert "2 row(s)" in repl.run(".refine only the high ones") and "refinement" in repl.run(".rules")
    (tmp_path / "c.csv").write_text("a,b\n1,x\n")
    assert repl.run(f".ingest {tmp_path}/c.csv {tmp_path}/c") == "1 row(s)"
    assert "Provenance" in repl.run(".explain fine") and ".load" in repl.run(".help") and "no command" in repl.run(".zzz")
    assert "cpu" in repl.run(".devices") and repl.run(".models") == "" and repl.run(".quit") is None


def test_command_line(tmp_path, capsys):
    assert main(["init", "--home", str(tmp_path / "h")]) == 0 and main(["status", "--home", str(tmp_path / "h")]) == 0
    assert "0 tables" in capsys.readouterr().out


def test_distillation_is_trained_and_measured(spark):
    rows = spark.sql("SELECT (id % 100) / 100D AS a, (id * 7 % 100) / 100D AS b FROM range(1000)")
    teacher = LinearOperator("t", [6.0, -3.0], -1.0, features=["a", "b"], accuracy=0.9)
    found = distill(rows, teacher, "s", ["a", "b"])
    assert found.agreement > 0.98 and found.rows == 1000 and abs(found.student.weights[0] - 6) < 1


def test_pipeline_report(spark):
    p = PipelineReport()
    with p.step("scan", 10):
        spark.range(10).count()
    with p.step("nothing"):
        pass
    assert p.slowest == "scan" and lineage.trace(p.segments(spark, "run"), "run")["hops"] == 2
