"""Which node or device a task goes to: filters and the least load.

Spark's scheduler places its own tasks; this serves plans over several sites and tells what a choice would be.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.errors import EngineError
from tessera.plans.pareto import SPEED

ROLES = ("core", "edge", "hybrid")


def route(nodes: DataFrame, task: str, memory_mb: int = 0) -> DataFrame:
    """The node (node_id, role, memory_mb, accelerators, load) for a task, one row, or none; ties by id.

    perception: nodes with accelerators, those that are not core before the core; symbolic: enough memory and not edge;
    mixed: enough memory, and hybrid or a core with accelerators.
    """
    roomy, accelerated = F.col("memory_mb") >= memory_mb, F.col("accelerators") > 0
    if task == "perception":
        fit, first = accelerated, F.col("role") == "core"
    elif task == "symbolic":
        fit, first = roomy & (F.col("role") != "edge"), F.lit(False)
    elif task == "mixed":
        fit, first = roomy & ((F.col("role") == "hybrid") | ((F.col("role") == "core") & accelerated)), F.lit(False)
    else:
        raise EngineError(f"no such task: {task}")
    return nodes.filter(fit).orderBy(first, "load", "node_id").limit(1)


@dataclass
class Slot:
    name: str
    kind: str  # cpu, metal, cuda
    load: int = 0


class DevicePool:
    """Slots of the machine; a request goes to the least loaded slot of the kind asked for, else of any kind."""

    def __init__(self, slots: list[Slot]):
        self.slots = slots

    def request(self, kind: str | None = None) -> Slot:
        fit = [s for s in self.slots if s.kind == kind] or self.slots
        if not fit:
            raise EngineError("no device")
        slot = min(fit, key=lambda s: (s.load, s.name))
        slot.load += 1
        return slot

    def complete(self, slot: Slot) -> None:
        slot.load = max(0, slot.load - 1)

    def speed(self, kind: str | None = None) -> float:
        """Speed against one CPU of the kind, or of the fastest there is."""
        return SPEED.get(kind, 1.0) if kind else max((SPEED[s.kind] for s in self.slots), default=1.0)

    def summary(self) -> str:
        return ", ".join(f"{s.name} ({s.kind}, load {s.load})" for s in self.slots)
