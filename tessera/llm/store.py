"""Lineage cuts, skew-safe joins, bounded filters and components, shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.shipping import ensure_shipped
from tessera.sources.shared import Store, shared_dir

__all__ = ["Store", "components", "likely_in", "marks", "prepare", "shared_dir", "versions", "without"]

#: Bits of the bounded membership bitmap; 2**22 bits are at most 65,536 rows of 64 bits on the driver.
BITMAP_BITS = 22
#: Bytes of an Arrow batch, so that neither the JVM's nor Python's side of a worker holds much text at once.
BATCH_BYTES = 2 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def prepare(spark: SparkSession) -> None:
    """Ship the package, and bound Arrow batches by bytes unless the session has a bound of its own."""
    ensure_shipped(spark)
    if spark.conf.get(_BATCH, "67108864b") == "67108864b":
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def marks(frame: DataFrame, key: str, wanted: DataFrame, wanted_key: str) -> DataFrame:
    """frame with _hit: whether its key may be among wanted's keys; false only where it surely is not.

    A bitmap of 2**BITMAP_BITS bits (at most 65,536 rows, 1 MB, whatever the input) is broadcast.
    """
    bit = lambda c: F.pmod(F.xxhash64(c.cast("long")), F.lit(1 << BITMAP_BITS))
    words = (
        wanted.select(bit(F.col(wanted_key)).alias("_b"))
        .groupBy(F.shiftright("_b", 6).alias("_word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(_b & 63 as int))")).alias("_bits"))
    )
    marked = frame.withColumn("_b", bit(F.col(key))).withColumn("_word", F.shiftright("_b", 6))
    hit = F.coalesce(F.expr("(shiftright(_bits, cast(_b & 63 as int)) & 1) = 1"), F.lit(False))
    return marked.join(F.broadcast(words), "_word", "left").withColumn("_hit", hit).drop("_b", "_word", "_bits")


def likely_in(frame: DataFrame, key: str, wanted: DataFrame, wanted_key: str) -> DataFrame:
    """Rows of frame whose key may be among wanted's keys: no wanted row is lost, some others may pass.

    Its only use is to keep rows that surely have no partner out of the shuffle of the exact join that follows.
    """
    return marks(frame, key, wanted, wanted_key).filter("_hit").drop("_hit")


def without(frame: DataFrame, key: str, unwanted: DataFrame) -> DataFrame:
    """Rows of frame whose key is not in unwanted(key); rows that surely are not are never shuffled."""
    marked = marks(frame, key, unwanted, key)
    rest = marked.filter("_hit").drop("_hit").join(unwanted.select(key), key, "left_anti").select(*frame.columns)
    return marked.filter("NOT _hit").select(*frame.columns).union(rest)


def versions(spark: SparkSession, texts: DataFrame) -> DataFrame:
    """texts (doc_id, text) with v: 0, or a hash of the text for rows whose doc_id also has rows of another text."""
    own = F.xxhash64(F.coalesce("text", F.lit("")))
    mixed = texts.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(own).alias("_lo"), F.max(own).alias("_hi")).filter("_lo < _hi").select("doc_id")
    mixed = Store(spark, "versions").put("mixed", mixed)
    if mixed.isEmpty():
        return texts.withColumn("v", F.lit(0).cast("long"))
    marked = marks(texts, "doc_id", mixed, "doc_id")
    met = marked.filter("_hit").drop("_hit").join(mixed.withColumn("_more", F.lit(True)), "doc_id", "left").select("doc_id", "text", F.when(F.col("_more"), own).otherwise(F.lit(0)).cast("long").alias("v"))
    return marked.filter("NOT _hit").select("doc_id", "text", F.lit(0).cast("long").alias("v")).union(met)


def components(store: Store, edges: DataFrame, name: str = "cc", most: int = 60) -> DataFrame:
    """(id, comp): the smallest id reachable from each id that has an edge (a, b), by alternating stars.

    Each round is two aggregates with map-side combining and two equi-joins whose skewed keys AQE splits; the edges are
    written to the shared folder after each round, never collected. The number of edges never grows.
    """
    now = store.put(f"{name}-0", edges.filter("a <> b").selectExpr("greatest(a, b) AS u", "least(a, b) AS v").distinct())
    for k in range(1, most + 1):
        both = now.union(now.selectExpr("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        then = store.put(f"{name}-{k}", small.filter("u <> v").selectExpr("greatest(u, v) AS u", "least(u, v) AS v").distinct())
        sums = [x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() for x in (now, then)]
        store.drop(f"{name}-{k - 1}")
        now = then
        if sums[0] == sums[1]:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select("v").distinct().select(F.col("v").alias("id"), F.col("v").alias("comp"))
    return now.select(F.col("u").alias("id"), F.col("v").alias("comp")).union(roots)
