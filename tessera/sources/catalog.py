"""A small JSON catalog of tables, rules and models, flushed on each change and reloaded into a session."""

from __future__ import annotations

import json
import os
from pathlib import Path


class Catalog:
    KINDS = ("tables", "rules", "models")

    def __init__(self, path: str):
        self.path = Path(path)
        self.data: dict[str, dict[str, object]] = {k: {} for k in self.KINDS}
        if self.path.exists():
            self.data |= json.loads(self.path.read_text())

    def put(self, kind: str, name: str, value: object) -> None:
        """Add or replace by name."""
        self.data[kind][name] = value
        self._flush()

    def remove(self, kind: str, name: str) -> bool:
        there = self.data[kind].pop(name, None) is not None
        self._flush()
        return there

    def _flush(self) -> None:
        self.path.parent.mkdir(parents=True, exist_ok=True)
        part = self.path.with_suffix(".part")
        part.write_text(json.dumps(self.data, indent=1, sort_keys=True))
        os.replace(part, self.path)
