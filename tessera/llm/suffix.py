"""Removal of repeated byte strings by difference-cover suffix sorting.

A byte goes if a string of ``WIDTH`` bytes that covers it also starts earlier. The suffixes of all texts cannot be
shuffled at a tolerable cost, so the text that is sorted is first reduced to what can matter:

1. Each window of WIDTH bytes has an anchor, its leftmost smallest K-gram hash (by 40 bits), the same wherever the window stands. Windows
   whose anchor occurs once in the corpus are unique, and only anchors, one in about forty bytes, are shuffled to know it.
2. The windows that one place of an anchor owns stand together; their text is a context. Of equal contexts only the first
   goes on (the others repeat it wholly), and only if its anchor has other contexts too.
3. The remaining contexts are dealt to buckets by anchor, so equal windows meet. Each bucket is sorted by the
   difference-cover algorithm: the triples at two of three places are sorted and named, names that tie recurse, the third
   class follows from its first byte and the rank behind it, and both orders are merged. Suffixes beside each other are
   compared over WIDTH bytes; of an equal run all but the first place in the corpus are repeats.
4. An anchor with more than HOT contexts (a passage that a large part of the corpus holds, each time between other words)
   would fill a bucket. Equal windows have the anchor at the same place, so the contexts are split by that place in halves.
   All windows of a half hold certain bytes around the anchor, and these take the anchor's place as the key: equal halves of a key
   become one again (by their bytes), and what is left is sorted in a bucket or split further, down to single windows, which
   are all different once equal ones are one.

Contexts are equal if 128 bits of two independent hashes are; buckets and halves compare bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import text as tx
from tessera.llm.store import Store, likely_in, marks, prepare, versions

WIDTH = 100
K = 32
HOT = 2048  # contexts of one key in a bucket
BUCKET_ROWS = 4096  # contexts of a bucket, about 140 bytes each


def difference_cover(s: np.ndarray) -> np.ndarray:
    """The suffix array of an array of positive integers."""
    n = len(s)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.concatenate([s, np.zeros(3, s.dtype)]).astype(np.int64)
    top = int(t.max()) + 1
    first, second = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([first, second])
    if top < 1 << 20:
        keys = (t[sample] * top + t[sample + 1]) * top + t[sample + 2]
        order = np.argsort(keys)
        fresh = np.diff(keys[order]) != 0
    else:
        order = np.lexsort((t[sample + 2], t[sample + 1], t[sample]))
        fresh = np.any([t[sample[order][1:] + d] != t[sample[order][:-1] + d] for d in range(3)], axis=0)
    names = np.empty(len(sample), np.int64)
    names[order] = np.concatenate([[1], 1 + np.cumsum(fresh)])
    if fresh.all():
        by_name = order
    else:
        by_name = difference_cover(names)
    rank = np.zeros(n + 4, np.int64)
    rank[sample[by_name]] = np.arange(1, len(sample) + 1)
    sorted12 = sample[by_name]
    sorted12 = sorted12[sorted12 < n]
    rest = np.arange(0, n, 3)
    wide = len(sample) + 2
    one = lambda i: t[i] * wide + rank[i + 1]
    rest = rest[np.argsort(one(rest))]
    in_first, in_second = sorted12[sorted12 % 3 == 1], sorted12[sorted12 % 3 == 2]
    before = np.searchsorted(one(in_first), one(rest))
    if top * top * wide < 1 << 62:
        two = lambda i: (t[i] * top + t[i + 1]) * wide + rank[i + 2]
    else:
        pairs = np.unique(np.concatenate([t[i] * top + t[i + 1] for i in (rest, in_second)]))
        two = lambda i: np.searchsorted(pairs, t[i] * top + t[i + 1]) * wide + rank[i + 2]
    before = before + np.searchsorted(two(in_second), two(rest))
    out = np.empty(n, np.int64)
    place = np.arange(len(rest)) + before
    out[place] = rest
    free = np.ones(n, bool)
    free[place] = False
    out[free] = sorted12
    return out


def anchors(buf: np.ndarray, offsets: np.ndarray, with_context: bool = True) -> tuple[np.ndarray, ...]:
    """(text, anchor hash, first window, windows, anchor, context hash, other hash) of every place of an anchor.

    Windows and anchors count from the slice's start; without context the hashes of it are left out.
    """
    n = len(buf)
    empty = np.zeros(0, np.int64)
    if n < WIDTH:
        return empty, empty.view(np.uint64), empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64)
    grams = tx.byte_grams(buf, K)
    chosen = tx.sliding_least(grams, WIDTH - K + 1)
    long = offsets[1:] - offsets[:-1] >= WIDTH
    edge = np.zeros(len(chosen) + 1, np.int8)
    edge[offsets[:-1][long]] += 1
    edge[offsets[1:][long] - WIDTH + 1] -= 1
    inside = np.cumsum(edge, dtype=np.int8)[:-1] > 0  # windows that lie in one text
    other = np.ones(len(chosen), bool)
    other[1:] = (chosen[1:] != chosen[:-1]) | ~inside[:-1]
    start = np.flatnonzero(inside & other)
    if not len(start):
        return empty, empty.view(np.uint64), empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64)
    text_of = np.searchsorted(offsets, start, side="right") - 1
    count = np.minimum(np.append(start[1:], len(chosen)), offsets[text_of + 1] - WIDTH + 1) - start
    anchor = chosen[start]
    if not with_context:
        return text_of, grams[anchor], start, count, anchor, empty.view(np.uint64), empty.view(np.uint64)
    place = tx.mix((anchor - start).astype(np.uint64))
    both = (h(buf, start, start + count + WIDTH - 1) ^ place for h in (tx.range_hashes, tx.other_range_hashes))
    return text_of, grams[anchor], start, count, anchor, *both


def _places(with_context: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, v = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "v"))
            for lo, _, buf, offsets in tx.slices(batch.column("text")):
                text, gram, start, count, anchor, context, other = anchors(buf, offsets, with_context)
                if not len(text):
                    continue
                columns = {"anchor": pa.array(gram.view(np.int64))}
                if with_context:
                    columns |= {"context": pa.array(context.view(np.int64)), "other": pa.array(other.view(np.int64)), "doc_id": pa.array(ids[lo + text], pa.int64()), "v": pa.array(v[lo + text], pa.int64())}
                    columns |= {"start": pa.array((start - offsets[text]).astype(np.int32)), "n": pa.array(count.astype(np.int16)), "at": pa.array((anchor - start).astype(np.int16))}
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


_ENTRY = {"anchor": pa.int64(), "doc_id": pa.int64(), "v": pa.int64(), "start": pa.int32(), "at": pa.int16(), "bytes": pa.binary()}


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, v, text, [(start, n, at, anchor)]) to a row for each context with its bytes."""
    for batch in batches:
        rows: list[tuple] = []
        for doc, v, text, entries in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            raw = text.encode()
            rows += [(e["anchor"], doc, v, e["start"], e["at"], raw[e["start"] : e["start"] + e["n"] + WIDTH - 1]) for e in entries]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _ENTRY.values(), strict=True)], list(_ENTRY))


def equal_runs(text: np.ndarray, order: np.ndarray, width: int) -> np.ndarray:
    """For each place of the order, the run of equal prefixes of width it belongs to."""
    apart = np.ones(max(0, len(order) - 1), bool)
    open_ = np.arange(len(order) - 1)
    for lo in range(0, width, 4):
        span = range(lo, min(lo + 4, width))
        same = np.all([text[order[open_] + d] == text[order[open_ + 1] + d] for d in span], axis=0) if len(open_) else np.zeros(0, bool)
        open_ = open_[same]
    apart[open_] = False
    return np.concatenate([[0], np.cumsum(apart)]) if len(order) else np.zeros(0, np.int64)


def repeats_of(docs: np.ndarray, v: np.ndarray, starts: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(entry, window in it) of every window of WIDTH bytes whose string stands earlier among the entries."""
    sizes = np.array([len(t) for t in texts])
    base = np.concatenate([[0], np.cumsum(sizes + 1)])
    joined = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.int64) + 1
    joined[base[1:] - 1] = 1  # ends; no window reaches over one, so they need not differ
    order = difference_cover(joined)
    entry = np.searchsorted(base, order, side="right") - 1
    keep = order - base[entry] + WIDTH <= sizes[entry]
    order, entry = order[keep], entry[keep]
    run = equal_runs(joined, order, WIDTH)
    again = np.bincount(run)[run] > 1 if len(run) else np.zeros(0, bool)
    order, entry, run = order[again], entry[again], run[again]
    if not len(run):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place, owner, version = starts[entry] + order - base[entry], docs[entry], v[entry]
    by = np.lexsort((place, version, owner, run))
    head = by[np.searchsorted(run[by], run[by])]  # the first of each run
    later = (place[by] != place[head]) | (owner[by] != owner[head]) | (version[by] != version[head])  # a document that repeats repeats nothing
    return entry[by][later], (order - base[entry])[by][later]


def _spans(docs: np.ndarray, v: np.ndarray, starts: np.ndarray) -> list[pa.Array]:
    """Windows that repeat, as maximal runs (doc_id, v, start, end)."""
    by = np.lexsort((starts, v, docs))
    docs, v, starts = docs[by], v[by], starts[by]
    fresh = np.flatnonzero(np.concatenate([[True], (docs[1:] != docs[:-1]) | (v[1:] != v[:-1]) | (starts[1:] > starts[:-1] + WIDTH)])) if len(docs) else np.zeros(0, np.int64)
    last = np.append(fresh[1:], len(docs)) - 1 if len(docs) else fresh
    return [pa.array(docs[fresh], pa.int64()), pa.array(v[fresh], pa.int64()), pa.array(starts[fresh], pa.int32()), pa.array(starts[last] + WIDTH, pa.int32())]


def _sort_bucket(key: tuple, table: pa.Table) -> pa.Table:
    docs, v, starts = (table.column(c).to_numpy().astype(np.int64) for c in ("doc_id", "v", "start"))
    entry, window = repeats_of(docs, v, starts, table.column("bytes").to_pylist())
    return pa.Table.from_arrays(_spans(docs[entry], v[entry], starts[entry] + window), ["doc_id", "v", "start", "end"])


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, spans as start/end structs) to disjoint runs, the bytes that stay, and the number of all."""
    for batch in batches:
        runs, kept, sizes = [], [], []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            raw, out, last, own = (text or "").encode(), [], 0, []
            for s in sorted((s["start"], s["end"]) for s in spans or ()):
                if own and s[0] <= own[-1][1]:
                    own[-1][1] = max(own[-1][1], s[1])
                else:
                    own.append(list(s))
            for a, b in own:
                out.append(raw[last:a])
                last = b
            sizes.append(len(raw))
            runs.append([{"start": a, "end": b} for a, b in own])
            kept.append(b"".join(out) + raw[last:])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(runs, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.binary()), pa.array(sizes, pa.int64())], ["doc_id", "spans", "kept", "n_bytes"])


def _same(names: tuple[str, ...]) -> str:
    return " AND ".join(f"{n} = f_{n}" for n in names)


_PLACE = ("doc_id", "v", "start")


def split_keys(store: Store, contexts: DataFrame, bound: int) -> tuple[DataFrame, DataFrame]:
    """(contexts, spans): contexts of keys with more than bound of them, as halves that share a key with at most bound others.

    A key is an anchor and a range of its places in a window, at first all. In each round the contexts of a key are cut
    at the middle of the range, and the hash of all bytes that windows of the new range surely hold becomes the anchor. Equal halves
    become the first of them (spans holds all others, which repeat it), and keys with at most bound halves are done, as is a
    range of one place: its windows are all different.
    """
    left, size = contexts.withColumns({"lo": F.lit(0), "hi": F.lit(WIDTH - K + 1)}), f"length(bytes) - {WIDTH - 1}"
    done, spans, key = [], [], ["anchor", "lo", "hi"]
    for round_ in range((WIDTH - K + 1).bit_length()):
        cut = left.selectExpr("*", "(lo + hi) div 2 AS mid", f"{size} AS n").selectExpr("*", "int(least(greatest(at - mid + 1, 0), n)) AS before")
        halves = cut.filter("before > 0").selectExpr("int(mid) AS lo", "hi", "doc_id", "v", "start", "at", f"substring(bytes, 1, before + {WIDTH - 1}) AS bytes").union(
            cut.filter("before < n").selectExpr("lo", "int(mid) AS hi", "doc_id", "v", "start + before AS start", "smallint(at - before) AS at", "substring(bytes, before + 1) AS bytes")
        )
        halves = halves.withColumn("anchor", F.expr(f"xxhash64(substring(bytes, at - lo + 1, {WIDTH + 1} - hi + lo))"))
        halves = store.put(f"halves-{round_}", halves)
        same = [*key, "at", "bytes"]
        firsts = store.put(f"firsts-{round_}", halves.groupBy(*same).agg(F.min(F.struct(*_PLACE)).alias("f"), F.count("*").alias("c")).select(*same, "f.*", "c"))
        again = firsts.filter("c > 1").select(*same, *(F.col(c).alias(f"f_{c}") for c in _PLACE))
        spans.append(halves.join(again, same).filter(f"NOT ({_same(_PLACE)})").selectExpr("doc_id", "v", "start", "start + length(bytes) AS end"))
        keys = firsts.groupBy(*key).agg(F.count("*").alias("k")).filter("k > 1 AND hi - lo > 1")
        held = store.put(f"held-{round_}", firsts.drop("c").join(keys, key))
        done.append(held.filter(f"k <= {bound}").drop("k"))
        left = held.filter(f"k > {bound}").drop("k")
        if left.isEmpty():
            break
    union = lambda frames: reduce(DataFrame.union, frames)
    return union([d.select(*key, "doc_id", "v", "start", "bytes") for d in done]), union(spans)


def repeated_spans(spark: SparkSession, texts: DataFrame) -> DataFrame:
    """(doc_id, v, start, end) of byte ranges that together are all bytes to remove. They may overlap or touch."""
    store = Store(spark, "suffix")
    texts = texts.filter("doc_id IS NOT NULL AND octet_length(text) >= " + str(WIDTH))
    often = texts.mapInArrow(_places(False), "anchor long").groupBy("anchor").agg(F.count("*").alias("c")).filter("c > 1").select("anchor")
    often = store.put("often", often)
    places = texts.mapInArrow(_places(True), "anchor long, context long, other long, doc_id long, v long, start int, n smallint, at smallint")
    places = store.put("places", places.join(often, "anchor"))
    firsts = places.groupBy("context", "other").agg(F.min(F.struct("doc_id", "v", "start", "n", "at", "anchor")).alias("f"), F.count("*").alias("c"))
    firsts = store.put("firsts", firsts.select("context", "other", "f.*", "c"))
    again = firsts.filter("c > 1").select("context", "other", *(F.col(c).alias(f"f_{c}") for c in _PLACE))
    spans = places.join(again, ["context", "other"]).filter(f"NOT ({_same(_PLACE)})").selectExpr("doc_id", "v", "start", f"start + n + {WIDTH - 1} AS end")
    spans = store.put("spans", spans)
    store.drop("places", "often")

    mixed = store.put("mixed", firsts.groupBy("anchor").agg(F.count("*").alias("k")).filter("k > 1"))
    entries = firsts.join(mixed, "anchor").select("anchor", "doc_id", "v", "start", "n", "at")
    listed = store.put("listed", entries.groupBy("doc_id", "v").agg(F.collect_list(F.struct("start", "n", "at", "anchor")).alias("e")))
    owners = likely_in(texts, "doc_id", listed, "doc_id").join(listed, ["doc_id", "v"]).select("doc_id", "v", "text", "e")
    contexts = store.put("contexts", owners.mapInArrow(_cut, "anchor long, doc_id long, v long, start int, at smallint, bytes binary"))
    hot = mixed.filter(f"k > {HOT}").select("anchor")
    whole = ["anchor", "0 AS lo", f"{WIDTH - K + 1} AS hi", "doc_id", "v", "start", "bytes"]
    held = contexts.selectExpr(*whole)
    if not hot.isEmpty():
        parts, more = split_keys(store, contexts.join(hot, "anchor", "left_semi"), HOT)
        held = contexts.join(hot, "anchor", "left_anti").selectExpr(*whole).union(parts)
        spans = spans.union(more)
    buckets = max(1, -(-contexts.count() // BUCKET_ROWS))
    dealt = held.withColumn("bucket", F.pmod(F.xxhash64("anchor", "lo", "hi"), F.lit(buckets))).drop("anchor", "lo", "hi")
    sorted_ = dealt.groupBy("bucket").applyInArrow(_sort_bucket, "doc_id long, v long, start int, end int")
    found = store.put("all", spans.union(sorted_))
    store.keep("all")
    return found


def suffix_dedup(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Return doc_id, n_bytes, spans (removed runs: start, end) and kept (the remaining bytes) for every row of docs.

    A null or empty text has no bytes and no spans; matches never cross documents. A row without doc_id takes no part. Rows
    that repeat a doc_id with one text are one document: none repeats the other. Rows that repeat a doc_id with another
    text are documents of their own, in the order of a hash of their text. Ties go to the smaller doc_id, then the
    smaller offset. Other columns of docs are not read.
    """
    prepare(spark)
    texts = versions(spark, docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    found = repeated_spans(spark, texts)
    per = found.groupBy("doc_id", "v").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    marked = marks(texts, "doc_id", found, "doc_id")
    kind = "array<struct<start:int,end:int>>"
    clean = marked.filter("NOT _hit").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.array().cast(kind).alias("spans"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("kept"))
    hit = marked.filter("_hit").join(per, ["doc_id", "v"], "left").select("doc_id", "text", "spans").mapInArrow(_apply, f"doc_id long, spans {kind}, kept binary, n_bytes long")
    return clean.union(hit.select("doc_id", "n_bytes", "spans", "kept"))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
