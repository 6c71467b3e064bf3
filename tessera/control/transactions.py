"""Optimistic and locking transactions over keys, and figures of a transaction log."""

from __future__ import annotations

import threading
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.errors import VersionConflict

CONFLICTS, SLOW_US = 0.1, 10_000.0  # beyond either, locking is advised


@dataclass
class Transaction:
    txn_id: int
    writes: set[str] = field(default_factory=set)
    state: str = "active"


class OptimisticController:
    """A commit fails if its writes overlap those of another active transaction."""

    def __init__(self):
        self.transactions: list[Transaction] = []

    def begin(self) -> Transaction:
        self.transactions.append(Transaction(len(self.transactions) + 1))
        return self.transactions[-1]

    def commit(self, txn: Transaction) -> None:
        for other in self.transactions:
            if other is not txn and other.state == "active" and other.writes & txn.writes:
                txn.state = "aborted"
                raise VersionConflict(f"transaction {txn.txn_id} writes what {other.txn_id} writes")
        txn.state = "committed"

    def abort(self, txn: Transaction) -> None:
        txn.state = "aborted"


class LockingController:
    """Strict two-phase locking on the driver: a write takes its key's lock, all are given back at the end; a lock that another holds
    is waited for, unless that would close a circle of waits, which aborts the one that asks."""

    def __init__(self):
        self.held: dict[str, Transaction] = {}
        self.waits: dict[int, Transaction] = {}
        self.free = threading.Condition()
        self.count = 0

    def begin(self) -> Transaction:
        with self.free:
            self.count += 1
            return Transaction(self.count)

    def write(self, txn: Transaction, key: str, wait: bool = True) -> None:
        with self.free:
            while (owner := self.held.get(key)) is not None and owner is not txn:
                seen = owner
                while seen is not None and seen is not txn:
                    seen = self.waits.get(seen.txn_id)
                if seen is txn or not wait:
                    self._end(txn, "aborted")
                    raise VersionConflict(f"transaction {txn.txn_id} cannot have {key!r}, which {owner.txn_id} holds")
                self.waits[txn.txn_id] = owner
                self.free.wait()
                self.waits.pop(txn.txn_id, None)
            self.held[key] = txn
            txn.writes.add(key)

    def _end(self, txn: Transaction, state: str) -> None:
        txn.state = state
        self.held = {k: t for k, t in self.held.items() if t is not txn}
        self.waits.pop(txn.txn_id, None)
        self.free.notify_all()

    def commit(self, txn: Transaction) -> None:
        with self.free:
            self._end(txn, "committed")

    def abort(self, txn: Transaction) -> None:
        with self.free:
            self._end(txn, "aborted")


def controller(conflict_rate: float, mean_us: float) -> OptimisticController | LockingController:
    """The controller that the figures of a log advise."""
    return LockingController() if advised(conflict_rate, mean_us) == "two_phase" else OptimisticController()


def advised(conflict_rate: float, mean_us: float) -> str:
    return "two_phase" if conflict_rate > CONFLICTS or mean_us > SLOW_US else "optimistic"


def log_metrics(log: DataFrame) -> DataFrame:
    """Of a log (txn_id, state, duration_us): commits, aborts, conflict rate, mean microseconds of commits."""
    done = F.col("state") == "committed"
    ended = F.col("state").isin("committed", "aborted")
    sums = log.agg(F.count_if(done).alias("commits"), F.count_if(F.col("state") == "aborted").alias("aborts"), F.count_if(ended).alias("n"), F.avg(F.when(done, F.col("duration_us"))).alias("mean_us"))
    return sums.select("commits", "aborts", F.when(F.col("n") > 0, F.col("aborts") / F.col("n")).otherwise(F.lit(0.0)).alias("conflict_rate"), F.coalesce("mean_us", F.lit(0.0)).alias("mean_us"))


def conflicts(writes: DataFrame) -> DataFrame:
    """txn_id and how many keys (keys) it writes that another transaction writes too; writes has txn_id and key.

    Keys with several writers are found by an aggregate and joined back, so a hot key costs its writers once, not their
    pairs.
    """
    shared = writes.groupBy("key").agg(F.min("txn_id").alias("lo"), F.max("txn_id").alias("hi")).filter("lo < hi").select("key")
    return writes.distinct().join(shared, "key").groupBy("txn_id").agg(F.count("*").alias("keys"))
