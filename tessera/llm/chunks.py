"""Substring deduplication by content-defined chunks.

A gear rolling hash (a sum of shifted table entries, so it depends on the last 64 bytes only) cuts each text where its
top bits are zero, at least ``LEAST`` bytes after the last cut and at most ``MOST``; cuts depend on nearby bytes only, so
insertions shift chunks without changing them. Chunks are deduplicated by a 96-bit digest (64 and
32 bits of two independent hashes; 100 TB have some 3e12 chunks, of which 1e-4 pairs are expected to be taken for equal): the first occurrence (smallest doc_id, then offset) stays. Successive duplicate chunks of a document form a run, and runs of at least
``RUN`` bytes are removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import text as tx
from tessera.llm.store import Store, prepare, versions

LEAST, BITS, MOST = 16, 4, 96  # about 31 bytes a chunk
RUN = 80
_GEAR = tx.mix(np.arange(1, 257, dtype=np.uint64))


def gear(buf: np.ndarray) -> np.ndarray:
    """The rolling hash behind each byte, over at most the last 64 bytes, by doubling."""
    h = _GEAR[buf]
    span = 1
    while span < 64 and span < len(h):
        more = h.copy()
        more[span:] += h[:-span] << np.uint64(span)
        h, span = more, span * 2
    return h


def cuts(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the chunks of a slice of texts. The hash of a cut looks at bytes of its own text only."""
    h = gear(buf)
    marks = np.flatnonzero(h >> np.uint64(64 - BITS) == 0) + 1
    starts: list[int] = []
    ends: list[int] = []
    first = np.searchsorted(marks, offsets)
    candidates = marks.tolist()
    for i in range(len(offsets) - 1):
        at, end, j, last = int(offsets[i]), int(offsets[i + 1]), int(first[i]), int(first[i + 1])
        floor = at + 64  # before it the hash looks into the text before: decided by the text's own bytes
        if i and end > at:
            own = gear(buf[at : min(end, floor)])
            local = (np.flatnonzero(own >> np.uint64(64 - BITS) == 0) + 1 + at).tolist()
            while j < last and candidates[j] <= floor:
                j += 1
            mine = local + candidates[j:last]
        else:
            mine = candidates[j:last]
        k = 0
        while at < end:
            low, high = at + LEAST, min(end, at + MOST)
            while k < len(mine) and mine[k] < low:
                k += 1
            to = mine[k] if k < len(mine) and mine[k] <= high else high
            starts.append(at)
            ends.append(to)
            at = to
    return np.array(starts, np.int64), np.array(ends, np.int64)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, v = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "v"))
        for lo, _, buf, offsets in tx.slices(batch.column("text")):
            starts, ends = cuts(buf, offsets)
            if not len(starts):
                continue
            row = np.searchsorted(offsets, starts, side="right") - 1
            digests, others = tx.range_hashes(buf, starts, ends), (tx.other_range_hashes(buf, starts, ends) >> np.uint64(32)).astype(np.uint32).view(np.int32)
            order = np.lexsort((starts, others, digests, row))  # of equal chunks of one text all but the first stand again
            again = np.zeros(len(row), bool)
            again[order[1:]] = np.all([x[order[1:]] == x[order[:-1]] for x in (digests, others, row)], axis=0)
            yield pa.RecordBatch.from_arrays(
                [
                    *(pa.array(x, pa.int64()) for x in (ids[lo + row], v[lo + row], digests.view(np.int64))),
                    *(pa.array(x) for x in (others, (starts - offsets[row]).astype(np.int32), (ends - starts).astype(np.int16), again)),
                ],
                ["doc_id", "v", "digest", "other", "start", "size", "again"],
            )


def duplicate_chunks(spark: SparkSession, texts: DataFrame) -> DataFrame:
    """(doc_id, v, start, size) of every chunk whose digest stands earlier: at a smaller (doc_id, v), or earlier in the document."""
    store = Store(spark, "chunks")
    chunks = store.put("chunks", texts.filter("doc_id IS NOT NULL").mapInArrow(_chunks, "doc_id long, v long, digest long, other int, start int, size smallint, again boolean"))
    once = chunks.filter("NOT again").drop("again")
    firsts = once.groupBy("digest", "other").agg(F.min("doc_id").alias("first"), F.count("*").alias("c")).filter("c > 1").select("digest", "other", "first")
    elsewhere = once.join(firsts, ["digest", "other"]).filter("doc_id > first").select("doc_id", "v", "start", "size")
    # within one doc_id the row of the least v has a chunk first; few rows have a v
    versions_ = once.filter("v <> 0")
    least = versions_.groupBy("digest", "other", "doc_id").agg(F.min("v").alias("least"))
    before = versions_.join(least, ["digest", "other", "doc_id"]).filter("v > least").select("doc_id", "v", "start", "size")
    # a chunk that stands again in its own document repeats it, whether other documents have it or not
    return elsewhere.union(before).union(chunks.filter("again").select("doc_id", "v", "start", "size"))


def substring_dedup(spark: SparkSession, docs: DataFrame, run: int = RUN) -> DataFrame:
    """Return doc_id, n_bytes and spans: start and end (exclusive) byte offsets of removed runs, for every row of docs.

    A null or empty text has no spans, and a row without doc_id keeps its text. Rows that repeat a doc_id with one text are one
    document: equal rows are not duplicates of each other. Rows that repeat a doc_id with another text are documents of their
    own, in the order of a hash of their text. Ties cannot arise, as a place in a document is unique.
    """
    prepare(spark)
    texts = versions(spark, docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    piece = F.struct("start", (F.col("start") + F.col("size")).alias("end"))
    found = duplicate_chunks(spark, texts).groupBy("doc_id", "v").agg(F.array_sort(F.collect_set(piece)).alias("c"))
    # a run begins where the piece before does not end, and ends where the next does not begin
    begins = F.filter("c", lambda x, i: F.coalesce(F.get("c", i - 1)["end"] != x["start"], F.lit(True)))
    ends = F.filter("c", lambda x, i: F.coalesce(F.get("c", i + 1)["start"] != x["end"], F.lit(True)))
    runs = F.zip_with(begins, ends, lambda a, b: F.struct(a["start"].alias("start"), b["end"].alias("end")))
    spans = found.select("doc_id", "v", F.filter(runs, lambda s: s["end"] - s["start"] >= run).alias("spans"))
    sizes = texts.select("doc_id", "v", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return sizes.join(spans, ["doc_id", "v"], "left").select("doc_id", "n_bytes", F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.expr("cast(aggregate(spans, 0L, (s, x) -> s + x.end - x.start) AS long)")
    told = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), told.alias("spans"))
