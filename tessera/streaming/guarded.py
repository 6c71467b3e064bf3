"""The same guards on streams: filters and models are stateless expressions, the monitor is a windowed aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.hitl.monitor import LOW, MOST_LOW
from tessera.logic.parser import Rule
from tessera.operators.guards import guard_result, guard_scan


def guard_stream(stream: DataFrame, rules: list[Rule], mode: str = "compat") -> DataFrame:
    """A stream under scan guards and result guards; no state."""
    return guard_result(guard_scan(stream, rules), rules, mode)


def monitor_stream(stream: DataFrame, column: str, at: str = "ts", window: str = "10 minutes", late: str = "5 minutes", low: float = LOW, most: float = MOST_LOW) -> DataFrame:
    """Low-score rate of each window; events later than the watermark are left out. Times without zone are read as UTC."""
    timed = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    c = F.col(f"`{column}`")
    sums = timed.groupBy(F.window(at, window)).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(c < low, 1)).alias("low"))
    return sums.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", (F.col("low") / F.col("n")).alias("low_rate"), (F.col("low") / F.col("n") > most).alias("is_low_confidence"))
