"""Conflict-constrained best-fit packing of documents into bins of a fixed number of tokens.

Every document is split into pieces of at most the capacity; pieces are dealt to shards of about ``SHARD`` pieces by hash
(so neither a hot source nor a hot duplicate cluster gathers), and each shard is packed alone, largest piece first. A bin
carries a bitmap of the sources and one of the duplicate clusters in it. Bins stand in order of what is left in them;
the search begins at the first residual that holds the piece and goes on to its successors until a compatible bin is
found, which so is the tightest compatible one. Only if there is none is a bin opened.

Clusters get a bit only where a shard holds two of their documents. Within one residual, bins of equal bitmaps are one
entry, so a hot source or cluster is passed over at once, not bin by bin.
"""

from __future__ import annotations


import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.store import Store, prepare
from tessera.llm.tokens import count_tokens

CAPACITY = 2048
SHARD = 4096


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each piece, in the order given. sources and clusters are bits (0: none)."""
    left: list[dict[tuple[int, int], list[int]]] = [{} for _ in range(capacity + 1)]
    used = 0  # bit r: a bin with r tokens left
    fill: list[int] = []
    out = []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        found, rest = None, used >> size
        at = size
        while rest:
            skip = (rest & -rest).bit_length() - 1
            at, rest = at + skip, rest >> skip
            found = next((key for key in left[at] if not key[0] & source and not key[1] & cluster), None)
            if found is not None:
                break
            at, rest = at + 1, rest >> 1
        if found is None:
            number, found, at = len(fill), (0, 0), capacity
            fill.append(0)
        else:
            same = left[at][found]
            number = same.pop()
            if not same:
                del left[at][found]
                if not left[at]:
                    used &= ~(1 << at)
        out.append((number, fill[number]))
        fill[number] += size
        if rest_of := at - size:
            left[rest_of].setdefault((found[0] | source, found[1] | cluster), []).append(number)
            used |= 1 << rest_of
    return out


def _pack(capacity: int):
    def run(key: tuple, pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values(["size", "doc_id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        source = {s: 1 << i for i, s in enumerate(sorted(pieces["source"].dropna().unique()))}
        shared = pieces["cluster"].value_counts()
        cluster = {c: 1 << i for i, c in enumerate(sorted(shared.index[shared > 1]))}
        placed = best_fit(
            pieces["size"].tolist(), [source.get(s, 0) for s in pieces["source"]], [cluster.get(c, 0) for c in pieces["cluster"]], capacity
        )
        pieces["bin_id"] = [(int(key[0]) << 32) | b for b, _ in placed]
        pieces["bin_offset"] = [o for _, o in placed]
        return pieces[["bin_id", "bin_offset", "doc_id", "piece", "start", "size"]]

    return run


def pack(spark: SparkSession, sized: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """Return bin_id, bin_offset, doc_id, piece, start_token, n_tokens: a row for each piece of sized.

    sized has doc_id, source, cluster (long, null: none) and n_tokens, a row for each document. A document without
    tokens has one row with null bin_id and no tokens. Pieces of one document conflict, as documents of one cluster or
    one source do; a null source conflicts with nothing. Repeated rows are packed each. Ties go to the smaller doc_id.
    """
    prepare(spark)
    store = Store(spark, "packing")
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce("cluster", F.xxhash64("doc_id")).alias("cluster"), F.coalesce("n_tokens", F.lit(0)).alias("n")]
    sized = store.put("sized", sized.select(*columns))
    pieces = sized.filter("n > 0").select("*", F.posexplode(F.sequence(F.lit(0), F.expr(f"cast((n - 1) div {capacity} as int)"))).alias("piece", "_k"))
    pieces = pieces.select("doc_id", "source", "cluster", "piece", (F.col("piece").cast("long") * capacity).alias("start"), F.least(F.lit(capacity), F.col("n") - F.col("piece") * capacity).cast("long").alias("size"))
    count = sized.agg(F.sum(F.expr(f"(n + {capacity - 1}) div {capacity}"))).first()[0] or 0
    shards = max(1, -(-int(count) // shard))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "cluster"), F.lit(shards)))
    packed = dealt.groupBy("shard").applyInPandas(_pack(capacity), "bin_id long, bin_offset long, doc_id long, piece int, start long, size long")
    empty = sized.filter("n <= 0").selectExpr("cast(null as long) bin_id", "cast(null as long) bin_offset", "doc_id", "0 piece", "0L start", "0L size")
    return packed.union(empty).selectExpr("bin_id", "bin_offset", "doc_id", "piece", "start AS start_token", "size AS n_tokens")


def pack_documents(spark: SparkSession, docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """Pack documents by their token counts; documents of equal text (white space and case aside) are one cluster."""
    cluster = F.xxhash64(F.regexp_replace(F.lower("text"), r"\s+", " "))
    sized = count_tokens(spark, docs.select("doc_id", "source", cluster.alias("cluster"), "text"), vocabulary)
    return pack(spark, sized, capacity)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
