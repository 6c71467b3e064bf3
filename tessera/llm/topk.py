"""Exact top-k inner products by MaxScore over integer vectors.

A query is a bag of terms, one for each dimension. Within a shard of vectors the contribution of a dimension is
shifted to be at least zero, and its bound is the largest contribution of the shard. Terms stand by falling bound. With
the threshold at the k-th best score so far, the terms at the end whose bounds together cannot lift a vector over the
threshold are non-essential. Essential postings are traversed, and the others are probed, term group by term group,
only for vectors that are still competitive. Shards keep their k best for each query; these are merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.store import Store, prepare

SCALE = 1024
QUERY_BLOCK = 8192  # queries broadcast at once
SHARD_ROWS = 4096
MOST = 2.0**62  # larger components count as this
LONG = 2.0**63 - 1024  # the largest double within a long
PROBE = 8  # non-essential terms probed between two prunings


def _scaled(x: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(SCALE * np.clip(x, -MOST, MOST)), -MOST, MOST)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """floor(SCALE * x) of a list column, short vectors padded with zeros; exact in 64-bit floats."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), max(dims, int(sizes.max(initial=0)))))
    rows = np.repeat(np.arange(len(column)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = _scaled(flat)
    return out


class Best:
    """The k best of each query so far, by score, ties to the smaller id."""

    def __init__(self, queries: int, k: int):
        self.k, self.score, self.ids = k, [np.zeros(0)] * queries, [np.zeros(0, np.int64)] * queries

    def threshold(self, q: int) -> float:
        return self.score[q][-1] if len(self.score[q]) >= self.k else -np.inf

    def add(self, q: int, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.concatenate([self.score[q], score]), np.concatenate([self.ids[q], ids])
        order = np.lexsort((ids, -score))[: self.k]
        self.score[q], self.ids[q] = score[order], ids[order]


def search_shard(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, best: Best) -> int:
    """MaxScore of every query over one shard of vectors; returns the essential terms of all queries, counted."""
    traversed = 0
    low, high = vectors.min(axis=0), vectors.max(axis=0)
    columns = np.ascontiguousarray(vectors.T)
    for q, weight in enumerate(queries):
        least = np.minimum(weight * low, weight * high)
        bound = np.abs(weight) * (high - low)
        order = np.argsort(-bound, kind="stable")
        base, limit = least.sum(), best.threshold(q)
        tail = np.concatenate([np.cumsum(bound[order][::-1])[::-1], [0.0]])  # what the terms from here on can add
        if base + tail[0] < limit:
            continue
        essential = int(np.searchsorted(-(base + tail), -limit, side="left")) if np.isfinite(limit) else len(order)
        essential = min(max(essential, 1), len(order))
        traversed += essential
        terms = order[:essential]
        score = weight[terms] @ columns[terms]
        alive = np.arange(len(ids)) if query_ids[q] is None else np.flatnonzero(ids != query_ids[q])
        score = score[alive]
        rest = least[order]
        pending = np.concatenate([np.cumsum(rest[::-1])[::-1], [0.0]])  # the least the terms from here on add
        at = essential
        while at < len(order) and len(alive):
            able = score + pending[at] + tail[at] >= limit
            alive, score = alive[able], score[able]
            terms = order[at : at + PROBE]
            score = score + weight[terms] @ columns[np.ix_(terms, alive)]
            at += len(terms)
        able = score >= limit
        alive, score = alive[able], score[able]
        if len(alive) > 4 * best.k:
            cut = np.partition(score, len(score) - best.k)[len(score) - best.k]
            alive, score = alive[score >= cut], score[score >= cut]
        best.add(q, score, ids[alive])
    return traversed


def _search(held, k: int, shard: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, queries = held.value
        best = Best(len(query_ids), k)
        for batch in batches:
            for lo in range(0, batch.num_rows, shard):
                part = batch.slice(lo, shard)
                vectors = _matrix(part.column(1), queries.shape[1])
                padded = queries if vectors.shape[1] == queries.shape[1] else np.pad(queries, ((0, 0), (0, vectors.shape[1] - queries.shape[1])))
                search_shard(query_ids, padded, part.column(0).to_numpy(), vectors, best)
        for lo in range(0, len(query_ids), 1024):
            span = range(lo, min(len(query_ids), lo + 1024))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(query_ids[span.start : span.stop], [len(best.ids[q]) for q in span]), pa.int64()),
                    pa.array(np.concatenate([best.ids[q] for q in span]), pa.int64()),
                    pa.array(np.clip(np.concatenate([best.score[q] for q in span]), -LONG, LONG).astype(np.int64)),
                ],
                ["query_id", "vec_id", "score"],
            )

    return run


def top_k(spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Return query_id, rank, vec_id, score: the k best of vectors (vec_id, embedding, any others) for each query.

    Scores are integer inner products of floor(1024 * x). Rows that are null or hold null or non-finite components or
    no id take no part; a vector shorter than another counts as padded with zeros. Candidates are all rows but those of
    the query's own id; a repeated row is a candidate each time. A query id that repeats asks with its smallest vector.
    Ties go to the smaller vec_id. No vectors or no queries: no rows. Inner products are exact up to 2**53; larger ones
    are rounded as doubles are, and those beyond a long are the largest long. Queries are broadcast in blocks of
    QUERY_BLOCK: the best of a block are written, and the block's broadcast is released, before the next one is made.
    """
    prepare(spark)
    store = Store(spark, "topk")

    def usable(frame: DataFrame) -> DataFrame:
        cast = frame.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        return cast.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine)

    asked = usable(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    count = (asked := store.put("queries", asked)).count()
    blocks = max(1, -(-count // QUERY_BLOCK))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = []
    for block in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).orderBy("vec_id").collect()  # about QUERY_BLOCK
        width = max((len(r["embedding"]) for r in rows), default=1)
        matrix = np.zeros((len(rows), max(1, width)))
        for i, r in enumerate(rows):
            matrix[i, : len(r["embedding"])] = _scaled(np.array(r["embedding"], np.float64))
        held = spark.sparkContext.broadcast((np.array([r["vec_id"] for r in rows], np.int64), matrix))
        part = usable(vectors).mapInArrow(_search(held, k, SHARD_ROWS), "query_id long, vec_id long, score long")
        part = part.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        if blocks > 1:
            part = store.put(f"best-{block}", part)
            held.unpersist()
        found.append(part)
    return reduce(DataFrame.union, found)


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(spark, vectors, vectors.filter("vec_id % 100 = 0"))

