"""Measured times of the steps of a run, and lineage segments of them."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tessera.hitl.lineage import SEGMENT


@dataclass
class PipelineReport:
    steps: list[tuple[str, float, int | None]] = field(default_factory=list)

    @contextmanager
    def step(self, name: str, records: int | None = None) -> Iterator[None]:
        began = time.perf_counter()
        yield
        self.steps.append((name, (time.perf_counter() - began) * 1000, records))

    @property
    def total_ms(self) -> float:
        return sum(ms for _, ms, _ in self.steps)

    @property
    def slowest(self) -> str | None:
        return max(self.steps, key=lambda s: s[1], default=(None,))[0]

    def segments(self, spark: SparkSession, run_id: str) -> DataFrame:
        return spark.createDataFrame([(run_id, i, name, "step", ms) for i, (name, ms, _) in enumerate(self.steps)], SEGMENT)
