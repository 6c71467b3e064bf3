"""Benchmark decontamination by winnowing.

A window is ``ngram`` consecutive words of an item (a shorter item is one window of its own length). Both sides are
fingerprinted alike: of the k-gram hashes inside each window the leftmost smallest is kept, so texts that share
``ngram`` words share a fingerprint at the same place of the shared span. Fingerprints of documents are joined with those
of the items, each hit is extended word by word in both directions, and an extended run of at least a window marks its
words. For windows shorter than ``ngram`` the k-gram is the window itself.

The items are joined in blocks of at most ``BLOCK_BYTES`` of text, so what is broadcast is bounded; with more than one
block the documents pass once for each, and they are written with their state to the shared folder between passes, where
the pass before is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import text as tx
from tessera.llm.store import Store, prepare

BLOCK_BYTES = 8 << 20
_STATE = ("n_words", "spans", "items")


class Items:
    """Fingerprints of a block of items: sorted hashes, and for each the item and the word it starts at."""

    def __init__(self, ids: list[str], texts: list[str], ngram: int, k: int):
        self.ids, self.words = ids, []
        hashes: list[np.ndarray] = []
        for lo, hi, buf, offsets in tx.slices(pa.array(texts, pa.large_string())):
            found, _, _, firsts = tx.hashed_words(buf, offsets, tx.ALNUM)
            self.words += [found[firsts[i] : firsts[i + 1]] for i in range(hi - lo)]
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in sorted({min(ngram, len(w)) for w in self.words if len(w)}):
            at = k if size == ngram else size
            prints, owner, place = [], [], []
            for i, w in enumerate(self.words):
                if min(ngram, len(w)) == size:
                    grams = tx.grams(w, at)
                    chosen = np.unique(tx.sliding_min(grams, size - at + 1))
                    prints.append(grams[chosen])
                    owner.append(np.full(len(chosen), i))
                    place.append(chosen)
            prints, owner, place = map(np.concatenate, (prints, owner, place))
            order = np.argsort(prints, kind="stable")
            self.tables[size] = prints[order], owner[order], place[order]


def _runs(words: np.ndarray, items: Items, size: int, hits: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
    """(item, first word, end word) of the maximal equal runs of at least size words through each hit."""
    done: dict[tuple[int, int], int] = {}
    for at, i, place in hits:
        own = items.words[i]
        line = (i, at - place)
        if done.get(line, -1) > at:  # inside a run that was extended before
            continue
        lo = max(0, place - at)
        n = min(len(own), lo + len(words) - (at - place + lo)) - lo
        equal = words[at - place + lo : at - place + lo + n] == own[lo : lo + n]
        left = place - lo
        if not equal[left]:
            continue
        gaps = np.flatnonzero(~equal)
        k = int(np.searchsorted(gaps, left))
        first = int(gaps[k - 1]) + 1 if k else 0
        end = int(gaps[k]) if k < len(gaps) else n
        done[line] = at - left + end
        if end - first >= size:
            yield i, at - left + first, at - left + end


def _merge(spans: list[tuple[int, int]]) -> list[int]:
    out: list[int] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def _match(ngram: int, k: int, held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(*held.value, ngram, k)
        for batch in batches:
            n_words, spans, names = [], batch.column("spans").to_pylist(), batch.column("items").to_pylist()
            for lo, hi, buf, offsets in tx.slices(batch.column("text")):
                words, _, _, firsts = tx.hashed_words(buf, offsets, tx.ALNUM)
                n_words += (firsts[1:] - firsts[:-1]).tolist()
                for size, (prints, owner, place) in items.tables.items():
                    at = k if size == ngram else size
                    grams = tx.grams(words, at)
                    chosen = tx.sliding_min(grams, size - at + 1)
                    if not len(chosen):
                        continue
                    window = np.arange(len(chosen))
                    text_of = np.searchsorted(firsts, window, side="right") - 1
                    chosen = np.unique(chosen[window + size <= firsts[text_of + 1]])
                    found = np.searchsorted(prints, grams[chosen])
                    chosen = chosen[prints[np.minimum(found, len(prints) - 1)] == grams[chosen]]
                    if not len(chosen):
                        continue
                    begin, end = np.searchsorted(prints, grams[chosen]), np.searchsorted(prints, grams[chosen], side="right")
                    text_of = np.searchsorted(firsts, chosen, side="right") - 1
                    for t in np.unique(text_of):
                        mine = np.flatnonzero(text_of == t) if len(chosen) < 64 else np.arange(*np.searchsorted(text_of, [t, t + 1]))
                        base = firsts[t]
                        hits = [(int(chosen[j] - base), int(owner[x]), int(place[x])) for j in mine for x in range(begin[j], end[j])]
                        runs = list(_runs(words[base : firsts[t + 1]], items, size, hits))
                        if runs:
                            old = spans[lo + t] or []
                            spans[lo + t] = _merge([*zip(old[::2], old[1::2], strict=True), *((a, b) for _, a, b in runs)])
                            names[lo + t] = sorted({*(names[lo + t] or []), *(items.ids[i] for i, _, _ in runs)})
            kept = [c for c in batch.schema.names if c not in _STATE]
            state = [pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(names, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *state], [*kept, *_STATE])

    return run


def decontaminate(spark: SparkSession, docs: DataFrame, bench: DataFrame, ngram: int = 10, k: int = 6) -> DataFrame:
    """Return every row and column of docs with n_words, spans and items; columns of those names are replaced.

    spans holds start, end (exclusive) of hit words, pair after pair, disjoint and in order; items the ids of the items
    with occurring windows, sorted as strings. A null or wordless text has no words and no hits; an item without
    words has no windows; an item without id takes no part; rows that repeat an item count once, and items of one text
    all count. An empty benchmark leaves every document clean. Repeated documents are judged row by row.
    """
    prepare(spark)
    state = docs.drop(*_STATE).withColumn("text", F.col("text").cast("string")).withColumns(
        {"n_words": F.lit(None).cast("long"), "spans": F.lit(None).cast("array<int>"), "items": F.lit(None).cast("array<string>")}
    )
    items = bench.filter("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    blocks = max(1, -(-size // BLOCK_BYTES))
    store = Store(spark, "winnow")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in state.schema.fields)
    for block in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).distinct().orderBy("item_id", "text").collect()
        held = spark.sparkContext.broadcast(([r["item_id"] for r in rows], [r["text"] for r in rows]))
        state = state.mapInArrow(_match(ngram, k, held), schema)
        if block + 1 < blocks:
            state = store.put(f"pass-{block}", state)
            held.unpersist()
            if block:
                store.drop(f"pass-{block - 1}")
    return state.withColumn("spans", F.coalesce("spans", F.array().cast("array<int>"))).withColumn("items", F.coalesce("items", F.array().cast("array<string>")))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = F.expr("cast(aggregate(spans, 0L, (s, x) -> x - s) AS long)")
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )
