"""Command line: ``python -m tessera.cli [-e SQL] [serve|init|status]``, and an interactive loop with dot commands."""

from __future__ import annotations

import argparse
import shlex
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from tessera.control.packs import Hub
from tessera.control.server import Server
from tessera.errors import EngineError
from tessera.session import Config, Session
from tessera.sources.catalog import Catalog
from tessera.sources.ingest import ingest_csv, pretty

HELP = """.load NAME PATH · .ingest CSV OUT · .logic NAME RULE · .rules · .drop NAME · .nl NAME TEXT · .refine TEXT · .model NAME PATH
.models · .operators · .devices · .hub search WORD | install NAME | list · .explain · .help · .quit · anything else is SQL"""


class Repl:
    def __init__(self, session: Session, hub: Hub, model=None):
        self.session, self.hub, self.model, self.last = session, hub, model, None

    def run(self, line: str) -> str | None:
        """The answer to a line, or None to quit."""
        line = line.strip()
        if not line.startswith("."):
            self.last = self.session.sql(line.rstrip(";")) if line else None
            return pretty(self.last.frame) if self.last else ""
        command, _, rest = line[1:].partition(" ")
        method = getattr(self, f"do_{command}", None)
        if command == "quit":
            return None
        return method(rest.strip()) if method else f"no command .{command}; .help lists them"

    def do_help(self, rest: str) -> str:
        return HELP

    def do_load(self, rest: str) -> str:
        name, path = shlex.split(rest)
        self.session.register_table(name, path)
        return f"table {name}"

    def do_ingest(self, rest: str) -> str:
        source, out = shlex.split(rest)
        frame = ingest_csv(self.session.spark, source, out)
        self.session.register_table(Path(out.rstrip("/")).name, out)
        return f"{frame.count()} row(s)"

    def do_logic(self, rest: str) -> str:
        name, _, source = rest.partition(" ")
        return f"rule {name} of class {self.session.register_rule(name, source).klass}"

    def do_rules(self, rest: str) -> str:
        return "\n".join(f"{n}: {r.source} (class {r.klass})" for n, r in self.session.rules.items())

    def do_drop(self, rest: str) -> str:
        return "dropped" if self.session.remove_rule(rest) else "no such rule"

    def _text_model(self):
        if self.model is None:
            raise EngineError("no text model is configured")
        return self.model

    def do_nl(self, rest: str) -> str:
        name, _, request = rest.partition(" ")
        return self.session.register_rule_from_text(name, request, self._text_model()).source

    def do_refine(self, rest: str) -> str:
        self.last = self.session.refine(rest, self._text_model())
        return pretty(self.last.frame)

    def do_model(self, rest: str) -> str:
        name, path = shlex.split(rest)
        return self.session.load_model(name, path)

    def do_models(self, rest: str) -> str:
        return "\n".join(f"{m['name']} v{m['version']} {m['avg_latency_ms']} ms, accuracy {m['accuracy']}" for m in self.session.registry.models.values())

    def do_operators(self, rest: str) -> str:
        return "\n".join(f"{f}@{v}" for f, v in self.session.registry.operators)

    def do_devices(self, rest: str) -> str:
        return self.session.devices.summary()

    def do_hub(self, rest: str) -> str:
        action, _, word = rest.partition(" ")
        if action == "install":
            done = self.session.load_pack(self.hub.install(word))
            return f"{done['rules']} rule(s), {done['models']} model(s)"
        found = self.hub.search(word) if action == "search" else self.hub.packs()
        return "\n".join(f"{p.name} {p.version}: {p.description}" for p in found)

    def do_explain(self, rest: str) -> str:
        if self.last is None:
            return "no query yet"
        told = self.session.explain(self.last, rest or "coarse")
        return "\n".join([told.summary, *told.rows])


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tessera")
    parser.add_argument("command", nargs="?", choices=("serve", "start", "init", "status"))
    parser.add_argument("-e", "--execute")
    parser.add_argument("--home", default="tessera-home")
    parser.add_argument("--config")
    parser.add_argument("--port", type=int, default=7474)
    args = parser.parse_args(argv)
    home = Path(args.home)
    if args.command == "init":
        home.mkdir(parents=True, exist_ok=True)
        Catalog(str(home / "catalog.json"))._flush()
        Hub(str(home / "hub"))
        print(f"initialised {home}")
        return 0
    if args.command == "status":
        data = Catalog(str(home / "catalog.json")).data
        print(", ".join(f"{len(v)} {k}" for k, v in data.items()))
        return 0
    spark = SparkSession.builder.appName("tessera").getOrCreate()
    session = Session(spark, Config.from_toml(args.config) if args.config else None, catalog=str(home / "catalog.json"), hub=str(home / "hub"))
    if args.command in ("serve", "start"):
        with Server(session, port=args.port) as server:
            print(f"listening on {server.port}")
            server.serve_forever()
        return 0
    repl = Repl(session, session.hub)
    lines = [args.execute] if args.execute else sys.stdin
    for line in lines:
        try:
            answer = repl.run(line)
        except Exception as e:
            answer = f"{type(e).__name__}: {e}"
        if answer is None:
            break
        print(answer)
    return 0


if __name__ == "__main__":
    sys.exit(main())
