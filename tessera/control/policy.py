"""Policies as an append-only log of changes; the state is the latest change of each policy.

Changes have policy_id, version, active, category and body; versions grow by one with each change of the catalog.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHANGE = T.StructType([T.StructField("policy_id", T.StringType()), T.StructField("version", T.LongType()), T.StructField("active", T.BooleanType()), T.StructField("category", T.StringType()), T.StructField("body", T.StringType())])


def latest(changes: DataFrame) -> DataFrame:
    """One row for each policy, its last change."""
    rest = [c for c in changes.columns if c != "policy_id"]
    return changes.groupBy("policy_id").agg(F.max_by(F.struct(*rest), "version").alias("s")).select("policy_id", "s.*")


def since(changes: DataFrame, version: int) -> DataFrame:
    """The changes after a version."""
    return changes.filter(F.col("version") > version)


def summary(changes: DataFrame) -> DataFrame:
    """active, total and latest version, one row."""
    return latest(changes).agg(F.count_if("active").alias("active"), F.count(F.lit(1)).alias("total"), F.coalesce(F.max("version"), F.lit(0)).alias("version"))


class PolicyCatalog:
    """A driver-side writer of the log; it is as small as the rules people write."""

    def __init__(self):
        self.log: list[tuple] = []

    @property
    def version(self) -> int:
        return max((c[1] for c in self.log), default=0)

    def _state(self) -> dict[str, tuple]:
        return {c[0]: c for c in sorted(self.log, key=lambda c: c[1])}

    def upsert(self, policy_id: str, category: str, body: str) -> int:
        self.log.append((policy_id, self.version + 1, True, category, body))
        return self.version

    def deactivate(self, policy_id: str) -> bool:
        state = self._state().get(policy_id)
        if state is None:
            return False
        self.log.append((policy_id, self.version + 1, False, *state[3:]))
        return True

    def apply(self, changes: list[tuple]) -> int:
        """Take another catalog's changes; those that are known, or older than what is known, change nothing."""
        new = [c for c in changes if c not in self.log]
        self.log += new
        return len(new)

    def changes_since(self, version: int) -> list[tuple]:
        return sorted((c for c in self.log if c[1] > version), key=lambda c: c[1])

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.log, CHANGE)
