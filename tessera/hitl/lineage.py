"""Traces of tuples through the nodes of a run, and nodes taken out of service."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEGMENT = T.StructType([T.StructField("tuple_id", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("node", T.StringType()), T.StructField("operation", T.StringType()), T.StructField("duration_ms", T.DoubleType())])


def traces(segments: DataFrame) -> DataFrame:
    """tuple_id, hops, total_ms and the ordered path of every tuple: one aggregate."""
    step = F.struct("seq", "node", "operation", "duration_ms")
    return segments.groupBy("tuple_id").agg(F.count("*").alias("hops"), F.sum("duration_ms").alias("total_ms"), F.sort_array(F.collect_list(step)).alias("path"))


def trace(segments: DataFrame, tuple_id: str) -> dict:
    """One tuple's trace; an unknown one has no hops and took no time."""
    row = traces(segments.filter(F.col("tuple_id") == tuple_id)).first()
    return {"tuple_id": tuple_id, "hops": row["hops"] if row else 0, "total_ms": row["total_ms"] if row else 0.0, "path": [r.asDict() for r in row["path"]] if row else []}


class ClusterMonitor:
    """Nodes in service and isolated."""

    def __init__(self, nodes: list[str]):
        self.isolated: dict[str, str] = {}
        self.nodes = list(nodes)

    def isolate(self, node: str, reason: str) -> None:
        self.isolated[node] = reason

    def resume(self, node: str) -> bool:
        return self.isolated.pop(node, None) is not None

    @property
    def active(self) -> list[str]:
        return [n for n in self.nodes if n not in self.isolated]
