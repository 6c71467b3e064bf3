"""Choice of a model by latency, accuracy and cost.

Plans are few (one for each registered model), so the session chooses in Python; the same rules over a DataFrame of plans
serve catalogs of any size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.models.operators import Operator
from tessera.plans.statements import Constraints

#: Fixed speeds of devices against one CPU.
SPEED = {"cpu": 1.0, "metal": 10.0, "cuda": 50.0}
ROW_UNIT = 1000  # rows that a model's latency is stated for
COST_PER_MS = 0.001


@dataclass(frozen=True)
class Plan:
    plan_id: str
    latency: float
    accuracy: float
    cost: float

    def dominates(self, other: Plan) -> bool:
        no_worse = self.latency <= other.latency and self.accuracy >= other.accuracy and self.cost <= other.cost
        return no_worse and (self.latency < other.latency or self.accuracy > other.accuracy or self.cost < other.cost)


def plan_of(operator: Operator, rows: int, speed: float = 1.0) -> Plan:
    """Latency grows with the rows beyond the unit, cost does not."""
    return Plan(
        f"{operator.function_id}@{operator.version}",
        operator.latency_ms * max(rows / ROW_UNIT, 1.0) / speed,
        operator.accuracy,
        operator.latency_ms * COST_PER_MS / speed,
    )


def rows_within(max_latency_ms: float, latencies: list[float]) -> int | None:
    """The largest number of rows at which the choice still changes: beyond it every model is too slow. None: there are no models."""
    return int(max_latency_ms / min(latencies) * ROW_UNIT) + 1 if latencies and min(latencies) > 0 else None


def frontier(plans: list[Plan]) -> list[Plan]:
    return [p for p in plans if not any(q.dominates(p) for q in plans)]


def choose(plans: list[Plan], constraints: Constraints) -> Plan | None:
    """The feasible frontier plan of the least latency; ties: more accurate, cheaper, first by id."""
    feasible = [p for p in frontier(plans) if constraints.admits(p.latency, p.accuracy, p.cost)]
    return min(feasible, key=lambda p: (p.latency, -p.accuracy, p.cost, p.plan_id), default=None)


def frontier_frame(plans: DataFrame) -> DataFrame:
    """Plans (plan_id, latency, accuracy, cost) that no other dominates: an anti join. Catalogs are small; the planner
    broadcasts one side by its size."""
    other = plans.select(*(F.col(c).alias(f"_{c}") for c in ("latency", "accuracy", "cost")))
    no_worse = (F.col("_latency") <= F.col("latency")) & (F.col("_accuracy") >= F.col("accuracy")) & (F.col("_cost") <= F.col("cost"))
    better = (F.col("_latency") < F.col("latency")) | (F.col("_accuracy") > F.col("accuracy")) | (F.col("_cost") < F.col("cost"))
    return plans.join(other, no_worse & better, "left_anti")


def choose_frame(plans: DataFrame, constraints: Constraints) -> DataFrame:
    """The one plan that choose() takes, or no row."""
    out = frontier_frame(plans)
    for column, limit, at_most in (("latency", constraints.max_latency_ms, True), ("accuracy", constraints.min_accuracy, False), ("cost", constraints.max_cost, True)):
        if limit is not None:
            out = out.filter(F.col(column) <= limit if at_most else F.col(column) >= limit)
    return out.orderBy("latency", F.desc("accuracy"), "cost", "plan_id").limit(1)


def distributed_frame(plans: DataFrame) -> DataFrame:
    """Plans of several sites (plan_id, compute_ms, network_ms, accuracy, cost): latency is compute and network."""
    return plans.withColumn("latency", F.col("compute_ms") + F.col("network_ms"))


def choose_distributed(plans: DataFrame, constraints: Constraints) -> DataFrame:
    """The most accurate feasible plan, ties to the least latency, then the first id."""
    out = frontier_frame(distributed_frame(plans))
    for column, limit, at_most in (("latency", constraints.max_latency_ms, True), ("accuracy", constraints.min_accuracy, False), ("cost", constraints.max_cost, True)):
        if limit is not None:
            out = out.filter(F.col(column) <= limit if at_most else F.col(column) >= limit)
    return out.orderBy(F.desc("accuracy"), "latency", "plan_id").limit(1)


def progressive_rewrite(current: str, accuracy: float, threshold: float, alternatives: DataFrame) -> DataFrame:
    """The most accurate alternative (name, accuracy) of another name at or over the threshold, if current is below it."""
    fit = alternatives.filter((F.col("name") != current) & (F.col("accuracy") >= threshold) & F.lit(accuracy < threshold))
    return fit.orderBy(F.desc("accuracy"), "name").limit(1)
