"""Anomalies of a result, from aggregates that ride along with the query itself."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.guards import EPSILON

COLUMNS = ("confidence", "fraud_prob")
LOW, MOST_LOW = 0.5, 0.8  # a score below LOW is low; more than that share of low scores is an anomaly


@dataclass(frozen=True)
class Anomaly:
    kind: str  # empty, low_confidence, uniform
    description: str
    affected_rows: int
    severity: str  # WARNING, CRITICAL
    suggestion: str


def watched(frame: DataFrame, columns: tuple[str, ...] = COLUMNS) -> list[str]:
    """The monitored columns the result has as doubles."""
    kinds = {f.name: f.dataType for f in frame.schema.fields}
    return [c for c in columns if isinstance(kinds.get(c), T.DoubleType)]


def metrics(columns: list[str], low: float = LOW) -> list[Column]:
    """Count, low scores, least and largest score: one row of aggregates, no rows are kept."""
    out = [F.count(F.lit(1)).alias("n")]
    for c in columns:
        col = F.col(f"`{c}`")
        out += [F.count(F.when(col < low, 1)).alias(f"low_{c}"), F.min(col).alias(f"min_{c}"), F.max(col).alias(f"max_{c}")]
    return out


def judge(values: dict, columns: list[str], low: float = LOW, most: float = MOST_LOW) -> list[Anomaly]:
    """Anomalies of the aggregates: NULL scores count as rows, but are neither low nor different."""
    n = values["n"]
    if not n:
        return [Anomaly("empty", "The query returned no rows: the constraints may be too strict, or data may be missing.", 0, "WARNING", "Relax the conditions or look at the source.")]
    found = []
    for c in columns:
        share = values[f"low_{c}"] / n
        if share > most:
            found.append(Anomaly("low_confidence", f"{share:.0%} of rows have {c} below {low} (at most {most:.0%}).", values[f"low_{c}"], "WARNING", f"Use a more accurate model; {share:.1%} of scores are low."))
        least, top = values[f"min_{c}"], values[f"max_{c}"]
        if n >= 2 and least is not None and top - least < EPSILON:
            found.append(Anomaly("uniform", f"All {n} rows of {c} have the score {least:.4f}.", n, "CRITICAL", "Check that the model is loaded and its inputs are meaningful."))
    return found


class Monitor:
    """Attach before the action; the verdict is there when the action has run, without another pass."""

    def __init__(self, columns: tuple[str, ...] = COLUMNS, low: float = LOW, most: float = MOST_LOW):
        self.columns, self.low, self.most = columns, low, most

    def attach(self, frame: DataFrame) -> tuple[DataFrame, Observation, list[str]]:
        own, seen = watched(frame, self.columns), Observation()
        return frame.observe(seen, *metrics(own, self.low)), seen, own

    def inspect(self, frame: DataFrame) -> list[Anomaly]:
        """One aggregate over the result."""
        own = watched(frame, self.columns)
        return judge(frame.agg(*metrics(own, self.low)).first().asDict(), own, self.low, self.most)


def report(frame: DataFrame, column: str, low: float = LOW, most: float = MOST_LOW) -> DataFrame:
    """The verdicts for one column as a row: n, low_rate, is_low_confidence, is_uniform, is_empty."""
    col = F.col(f"`{column}`")
    sums = frame.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(col < low, 1)).alias("k"), F.min(col).alias("lo"), F.max(col).alias("hi"))
    rate = F.when(F.col("n") > 0, F.col("k") / F.col("n")).otherwise(F.lit(0.0))
    return sums.select("n", rate.alias("low_rate"), (rate > most).alias("is_low_confidence"), F.coalesce((F.col("n") >= 2) & (F.col("hi") - F.col("lo") < EPSILON), F.lit(False)).alias("is_uniform"), (F.col("n") == 0).alias("is_empty"))
