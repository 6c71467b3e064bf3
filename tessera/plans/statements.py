"""PREDICT statements and the trailing WITH clause, taken off before Spark parses the rest."""

from __future__ import annotations

import logging
import re
from dataclasses import dataclass

from tessera.errors import EngineError

_log = logging.getLogger(__name__)
_NAME = r"[A-Za-z_][\w.]*"
_PREDICT = re.compile(rf"^\s*PREDICT\s+(CLASS|VALUE)\s+OF\s+({_NAME})\s+FROM\s+({_NAME})(?:\s+WITH\s*\((.*)\))?\s*;?\s*$", re.IGNORECASE | re.DOTALL)
_WITH = re.compile(r"\bWITH\s*\(([^()]*)\)\s*;?\s*$", re.IGNORECASE)


@dataclass(frozen=True)
class Predict:
    kind: str  # class, value
    column: str
    table: str
    model: str

    @property
    def output(self) -> str:
        return f"prediction_{self.column}"


@dataclass(frozen=True)
class Constraints:
    max_latency_ms: float | None = None
    min_accuracy: float | None = None
    max_cost: float | None = None

    def admits(self, latency: float, accuracy: float, cost: float) -> bool:
        return (
            (self.max_latency_ms is None or latency <= self.max_latency_ms)
            and (self.min_accuracy is None or accuracy >= self.min_accuracy)
            and (self.max_cost is None or cost <= self.max_cost)
        )


def _pairs(text: str) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (p.partition("=") for p in text.split(",")) if k.strip()}


def parse_predict(text: str) -> Predict | None:
    """PREDICT {CLASS|VALUE} OF col FROM table [WITH (model='name')]; None for other statements."""
    if not re.match(r"\s*PREDICT\s", text, re.IGNORECASE):
        return None
    m = _PREDICT.match(text)
    if not m:
        raise EngineError("PREDICT {CLASS|VALUE} OF column FROM table [WITH (model = 'name')]")
    model = _pairs(m[4] or "").get("model", "default").strip("'\"")
    return Predict(m[1].lower(), m[2], m[3], model or "default")


def parse_constraints(text: str) -> tuple[str, Constraints | None]:
    """The statement without its trailing WITH (key = value, ...), and the constraints, if it has one.

    Unknown keys are told in the log; a value that is no number is no constraint. A WITH inside quotes is text.
    """
    m = _WITH.search(text)
    if not m or text[: m.start()].count("'") % 2 or "=" not in m[1]:
        return text, None
    values: dict[str, float | None] = {}
    for key, value in _pairs(m[1]).items():
        if key not in Constraints.__dataclass_fields__:
            _log.warning("unknown constraint %s", key)
            continue
        try:
            values[key] = float(value)
        except ValueError:
            values[key] = None
    return text[: m.start()].strip(), Constraints(**values)


CALLS = ("hub_search", "hub_install", "distill_model", "finetune_model")
_CALL = re.compile(rf"^\s*SELECT\s+({'|'.join(CALLS)})\s*\((.*)\)(?:\s+AS\s+({_NAME}))?\s*;?\s*$", re.IGNORECASE | re.DOTALL)
_ARGUMENT = re.compile(rf"\s*(?:({_NAME})\s*=>\s*)?('(?:[^']|'')*'|-?\d+(?:\.\d+)?(?:[eE]-?\d+)?)\s*(?:,|$)")


@dataclass(frozen=True)
class Call:
    function: str
    target: str
    options: dict[str, str | float]
    alias: str


def parse_call(text: str) -> Call | None:
    """SELECT function('target', name => value, ...) [AS alias] of a function that acts on the session; None for other statements."""
    m = _CALL.match(text)
    if not m:
        return None
    values, at = [], 0
    while at < len(m[2]):
        found = _ARGUMENT.match(m[2], at)
        if not found:
            raise EngineError(f"{m[1]} takes a quoted name, then name => value: {m[2][at:]!r}")
        values.append((found[1], found[2][1:-1].replace("''", "'") if found[2].startswith("'") else float(found[2])))
        at = found.end()
    if not values or values[0][0] or not isinstance(values[0][1], str) or any(k is None for k, _ in values[1:]):
        raise EngineError(f"{m[1]} takes a quoted name, then name => value")
    return Call(m[1].lower(), values[0][1], {k.lower(): v for k, v in values[1:]}, m[3] or m[1].lower())
