"""Keys, rate limits and metering of a service."""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.shipping import ensure_shipped

#: Fixed tiers: capacity and refill a second.
TIERS = {"free": (10.0, 1.0), "developer": (100.0, 10.0), "team": (1000.0, 100.0), "enterprise": (10000.0, 1000.0)}
KEY_PREFIX = "sk-"


def tier_of(key: str | None) -> str | None:
    """Tier of a key such as sk-team-...; a key without a tier's name is free; other texts are no keys."""
    if not key or not key.startswith(KEY_PREFIX):
        return None
    return next((t for t in TIERS if key.startswith(f"{KEY_PREFIX}{t}-")), "free")


@dataclass
class TokenBucket:
    capacity: float
    refill: float
    tokens: float | None = None
    last: float | None = None

    def allow(self, now: float | None = None, cost: float = 1.0) -> bool:
        now = time.monotonic() if now is None else now
        self.tokens = self.capacity if self.tokens is None else min(self.capacity, self.tokens + max(0.0, now - self.last) * self.refill)
        self.last = now
        if self.tokens >= cost:
            self.tokens -= cost
            return True
        return False


def rate_limit(calls: DataFrame, capacity: float, refill: float, key: str = "user_id", at: str = "ts") -> DataFrame:
    """The calls with ``allowed``: a bucket for each key, calls in order of time. The fold over a key's calls is
    sequential by nature, so rows of a key stream through one task in order without being gathered in memory."""
    ensure_shipped(calls.sparkSession)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in calls.schema.fields)
    order = [c for c in calls.columns if c not in (key, at)]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket, owner = None, object()
        for pdf in batches:
            allowed = []
            for who, when in zip(pdf[key], pdf[at], strict=True):
                if who != owner:
                    bucket, owner = TokenBucket(capacity, refill), who
                allowed.append(bucket.allow(when.timestamp()))
            yield pdf.assign(allowed=allowed)

    return calls.repartition(key).sortWithinPartitions(key, at, *order).mapInPandas(fold, f"{fields}, allowed boolean")


def metering(usage: DataFrame) -> DataFrame:
    """queries, rows and gpu_ms of each tenant."""
    return usage.groupBy("tenant").agg(F.count("*").alias("queries"), F.sum("rows").alias("rows"), F.sum("gpu_ms").alias("gpu_ms"))


class Meter:
    """Counters of each tenant since they were last read."""

    def __init__(self):
        self.counts: dict[str, list[float]] = {}

    def record(self, tenant: str, rows: int, gpu_ms: float = 0.0) -> None:
        own = self.counts.setdefault(tenant, [0, 0, 0.0])
        own[0], own[1], own[2] = own[0] + 1, own[1] + rows, own[2] + gpu_ms

    def read_and_reset(self, tenant: str) -> tuple[int, int, float]:
        return tuple(self.counts.pop(tenant, [0, 0, 0.0]))
