"""Decisions on anomalies, and repair of failed runs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from tessera.hitl.monitor import Anomaly

ACTIONS = ("accept", "correct", "abort", "retry_with_model")


@dataclass
class Triage:
    """Anomalies and what was decided on them, one action each."""

    anomalies: list[Anomaly]
    actions: list[tuple[str, str | None]] = field(default_factory=list)

    def decide(self, action: str, detail: str | None = None) -> None:
        if action not in ACTIONS:
            raise ValueError(f"one of {ACTIONS}, not {action}")
        self.actions.append((action, detail))

    @property
    def complete(self) -> bool:
        return len(self.actions) >= len(self.anomalies)


#: Fixed words of error texts, in order: the first that matches decides severity and confidence.
KEYWORDS = (
    (("dimension", "shape"), "recoverable", 0.9),
    (("unsupported", "format", "codec"), "degraded", 0.85),
    (("null", "missing", "none"), "recoverable", 0.8),
    (("timeout", "deadline", "exceeded"), "recoverable", 0.95),
    (("memory", "oom", "allocation"), "degraded", 0.9),
)
UNKNOWN = ("fatal", 0.5)


@dataclass(frozen=True)
class Review:
    error: str
    severity: str  # recoverable, degraded, fatal
    confidence: float


@dataclass(frozen=True)
class Repair:
    action: str  # swap, retry, skip, escalate
    model: str | None = None


def review(error: str) -> Review:
    text = error.lower()
    return Review(error, *next(((s, c) for words, s, c in KEYWORDS if any(w in text for w in words)), UNKNOWN))


def plan_repair(found: Review, current: str, models: list[str]) -> Repair:
    """Recoverable: the first other model, else try again; degraded: leave incomplete rows out; fatal: ask a person."""
    if found.severity == "recoverable":
        other = next((m for m in models if m != current), None)
        return Repair("swap", other) if other else Repair("retry")
    return Repair("skip") if found.severity == "degraded" else Repair("escalate")


def drop_null_rows(frame: DataFrame) -> DataFrame:
    """Rows without any NULL."""
    return frame.na.drop("any")


def apply_repair(frame: DataFrame, repair: Repair, rerun: Callable[[DataFrame, str], DataFrame] | None = None) -> tuple[DataFrame, bool]:
    """(rows, whether they changed): a swap runs the other model on the rows, and keeps them if it fails."""
    if repair.action == "skip":
        return drop_null_rows(frame), True
    if repair.action == "swap" and rerun is not None and repair.model:
        try:
            return rerun(frame, repair.model), True
        except (ValueError, KeyError):
            return frame, False
    return frame, False


def self_repair(error: str, current: str, models: list[str], reviewer: Callable[[str], Review] = review) -> tuple[Review, Repair]:
    """The verdict and plan for an error; reviewer may be any callable, such as one that asks a text model."""
    found = reviewer(error)
    return found, plan_repair(found, current, models)
