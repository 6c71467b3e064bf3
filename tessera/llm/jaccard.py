"""N-gram Jaccard join: size-aware heavy-light set join on word shingles.

Method. A document's set is its distinct word shingles. Equal sets are one class (found by digest). Over the
classes every token has one global order: estimated document frequency first (hashed counters over all documents),
then hash. With threshold ``num/den`` a set of size s shares at least ceil(num*s/den) shingles with any partner, so
the pair must share a token within the first ``s - that + 1`` tokens of the order, and two within one token more.

* Light sets (size up to the boundary) enumerate every fixed-size subset (two tokens) of that prefix.
* Heavy sets scan inverted lists: each token of the prefix is a posting. Light sets near enough to the boundary to
  have heavy partners post there too.
* The boundary is the one of least cost over the histogram of sizes: subsets written against postings written and
  the pairs that lists of the measured mean length would check.

Groups are never expanded into all pairs. Every member of a list is first linked with the list's smallest id (as many
candidates as postings), verified exactly on the whole texts, and joined into components. Only then are pairs of one
list that still lie in different components joined, on condition that a parity sketch allows the pair: the number of
differing bits of two parity sketches never exceeds the size of the symmetric difference, so nothing is lost.
Survivors are verified exactly too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import text as tx
from tessera.llm.store import Store, components, likely_in, prepare

SKETCH_BITS = 20  # 2**20 hashed counters, 1 MB when broadcast, whatever the input
SLICES = 64
PARITY_WORDS = 8  # 512 bits
WIDE_FROM, WIDE_WORDS = 1500, 64  # larger sets, whose differences fill 512 bits, have 4,096 more
PAIR_COST = 8.0  # a checked pair against a written posting


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every text; the whole sequence is one shingle if shorter than k."""
    for lo, hi, buf, offsets in tx.slices(column):
        hashes, _, _, firsts = tx.hashed_words(buf, offsets, tx.SPACED)
        for i in range(hi - lo):
            own = hashes[firsts[i] : firsts[i + 1]]
            yield lo + i, np.unique(tx.grams(own, min(k, len(own)))) if len(own) else own


def _count_tokens(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in batches:
            kept = [s for _, s in shingle_sets(batch.column(0), k)]
            if kept:
                np.add.at(counts, (np.concatenate(kept) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
        if counts.any():
            parts = counts.reshape(SLICES, -1)
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["slice", "counts"])

    return run


def _sum_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, c in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own = np.frombuffer(c.as_buffer(), np.uint32).astype(np.uint64)
            total[i] = total[i] + own if i in total else own
    for i, c in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([c.tobytes()], pa.binary())], ["slice", "counts"])


def token_weights(docs: DataFrame, k: int) -> np.ndarray:
    """Document frequencies of all shingles in 2**SKETCH_BITS hashed counters, as logarithms in bytes (1 MB)."""
    rows = docs.select("text").mapInArrow(_count_tokens(k), "slice int, counts binary").repartition(SLICES, "slice").mapInArrow(_sum_slices, "slice int, counts binary").collect()
    out = np.zeros((SLICES, (1 << SKETCH_BITS) // SLICES), np.uint64)
    for r in rows:
        out[r["slice"]] += np.frombuffer(r["counts"], np.uint64)
    return np.minimum(255, np.log2(out.reshape(-1) + 1.0) * 8).astype(np.uint8)


def _profile(k: int, num: int, den: int, weights):
    """(doc_id, n, digest, tokens of the longer prefix in global order, wide and short parity words) of every row."""

    def parity_of(own: np.ndarray, size: int) -> np.ndarray:
        bits = np.bincount((own >> np.uint64(7)).astype(np.int64) & (64 * size - 1), minlength=64 * size) & 1
        return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        weight = weights.value
        for batch in batches:
            n, digests, prefixes, wide, parity = [], [], [], [], []
            for _, own in shingle_sets(batch.column(1), k):
                n.append(len(own))
                digests.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
                need = -(-num * len(own) // den)
                if len(own) * den < num * (len(own) + 1):  # only equal sets can reach the threshold
                    prefixes.append(None)
                else:
                    size = min(len(own), len(own) - need + 2)
                    keys = (weight[(own >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (own >> np.uint64(8))
                    at = np.argpartition(keys, size - 1)[:size] if size < len(own) else np.arange(len(own))
                    prefixes.append(own[at[np.argsort(keys[at], kind="stable")]].view(np.int64))
                wide.append(parity_of(own, WIDE_WORDS) if len(own) >= WIDE_FROM else None)
                parity.append(parity_of(own, PARITY_WORDS))
            par = np.stack(parity) if parity else np.zeros((0, PARITY_WORDS), np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(wide, pa.list_(pa.int64())), *(pa.array(par[:, j]) for j in range(PARITY_WORDS))],
                ["doc_id", "n", "digest", "tokens", "wide", *(f"s{j}" for j in range(PARITY_WORDS))],
            )

    return run


def boundary(sizes: list[tuple[int, int]], mean_list: float, num: int, den: int) -> int:
    """The largest size of a light set, by least total cost over the histogram [(size, sets)]."""
    sizes = sorted(sizes)
    prefix = lambda s: s - -(-num * s // den) + 1
    light = [c * (prefix(s) + 1) * prefix(s) / 2 for s, c in sizes]
    heavy = [c * prefix(s) * (1 + PAIR_COST * max(0.0, mean_list - 1)) for s, c in sizes]
    best, at, cost = sum(heavy), 0, sum(heavy)
    for (s, _), a, b in zip(sizes, light, heavy, strict=True):
        cost += a - b
        if cost < best:
            best, at = cost, s
    return at


def _verify(k: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (dict(shingle_sets(batch.column(j), k)) for j in (2, 3))
            keep = []
            for i in range(batch.num_rows):
                both = len(np.intersect1d(a[i], b[i], assume_unique=True))
                keep.append(den * both >= num * (len(a[i]) + len(b[i]) - both) and both > 0)
            out = batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))
            if out.num_rows:
                yield out

    return run


def verified(docs: DataFrame, pairs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose whole texts reach the threshold. docs: one row for each id."""
    ids = pairs.select(F.col("a").alias("i")).union(pairs.select("b")).distinct()
    texts = likely_in(docs.select("doc_id", "text"), "doc_id", ids, "i")
    left = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
    both = left.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
    return both.select("a", "b", "ta", "tb").mapInArrow(_verify(k, num, den), "a long, b long")


def jaccard_groups(spark: SparkSession, docs: DataFrame, k: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """Return doc_id, n_shingles, component_id for every row of docs (doc_id, text, any other columns).

    A null or blank text has no shingles, n_shingles 0, and is its own component. Rows that repeat a doc_id are rows
    of one document: they share a component. A row without doc_id takes no part and has a null component_id. Ties do
    not arise: links are decided by integers. Columns of docs other than doc_id and text are not read.
    """
    prepare(spark)
    store = Store(spark, "jaccard")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    weights = spark.sparkContext.broadcast(token_weights(docs, k))
    words = [f"s{j}" for j in range(PARITY_WORDS)]
    sets = store.put("sets", docs.mapInArrow(_profile(k, num, den, weights), "doc_id long, n long, digest binary, tokens array<long>, wide array<long>, " + ", ".join(f"{w} long" for w in words)))

    classes = store.put("classes", sets.filter("n > 0 AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("rep")))
    can = sets.filter("tokens IS NOT NULL AND doc_id IS NOT NULL")
    unique = can.join(classes.select("digest", F.col("rep").alias("doc_id")), ["doc_id", "digest"], "left_semi").dropDuplicates(["doc_id", "digest"]).withColumnRenamed("doc_id", "id")
    unique = store.put("unique", unique.select("id", "n", "tokens", "wide", *words))

    sizes = [(r["n"], r["c"]) for r in unique.groupBy("n").agg(F.count("*").alias("c")).collect()]  # as many rows as set sizes
    told = unique.select(F.explode("tokens").alias("t")).agg(F.count("*").alias("c"), F.approx_count_distinct("t").alias("d")).first()
    top = boundary(sizes, told["c"] / max(1, told["d"]), num, den)

    prefix = f"int(n - ceil({num} * n / {den}) + 1)"
    single = F.expr(f"CASE WHEN n * {den} >= {top} * {num} THEN slice(tokens, 1, {prefix}) ELSE array() END")
    subsets = F.expr(
        f"CASE WHEN n <= {top} THEN flatten(transform(tokens, (x, i) -> transform(slice(tokens, i + 2, size(tokens)), y -> xxhash64(x, y)))) ELSE array() END"
    )
    postings = unique.select("id", F.explode(F.concat(single, subsets)).alias("sig"))
    postings = store.put("postings", postings)
    lists = postings.groupBy("sig").agg(F.min("id").alias("rep"), F.max("id").alias("top")).filter("rep < top").select("sig", "rep")
    members = store.put("members", postings.join(lists, "sig"))
    store.drop("postings")

    attrs = unique.select("id", "n", *words)
    side = lambda name: attrs.select(F.col("id").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in ("n", *words)))
    differing = " + ".join(f"bit_count(a_{w} ^ b_{w})" for w in words)
    possible = F.expr(f"a_n * {den} >= b_n * {num} AND b_n * {den} >= a_n * {num} AND ({differing}) * {den + num} <= (a_n + b_n) * {den - num}")

    wide = unique.groupBy("id").agg(F.count("*").alias("c"), F.first("n").alias("n"), F.first("wide").alias("wide")).filter("c = 1 AND wide IS NOT NULL")

    def likely(pairs: DataFrame) -> DataFrame:
        """Pairs of large sets once more, by the wider sketch."""
        two = [wide.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("wide").alias(f"w{c}")) for c in ("a", "b")]
        met = pairs.join(two[0], "a", "left").join(two[1], "b", "left")
        apart = F.expr(f"aggregate(zip_with(wa, wb, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x) * {den + num} <= (na + nb) * {den - num}")
        return met.filter(F.coalesce(apart, F.lit(True))).select("a", "b")

    stars = members.filter("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b")).distinct()
    stars = store.put("stars", likely(stars.join(side("a"), "a").join(side("b"), "b").filter(possible).select("a", "b")))
    texts = docs.filter("doc_id IS NOT NULL")
    links = store.put("links", verified(texts, stars, k, num, den).distinct())
    first = store.put("first", components(store, links, "cc1"))

    placed = members.select("sig", "id").join(first, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    placed = store.put("placed", placed)
    mixed = placed.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("sig")
    rest = store.put("rest", placed.join(mixed, "sig").join(attrs, "id"))
    store.drop("placed", "members", "stars")
    one = rest.select("sig", F.col("id").alias("a"), F.col("comp").alias("a_comp"), *(F.col(c).alias(f"a_{c}") for c in ("n", *words)))
    two = rest.select("sig", F.col("id").alias("b"), F.col("comp").alias("b_comp"), *(F.col(c).alias(f"b_{c}") for c in ("n", *words)))
    pairs = one.join(two, (one["sig"] == two["sig"]) & F.expr("a < b AND a_comp <> b_comp") & possible).select("a", "b")
    pairs = store.put("pairs", likely(pairs.distinct()))
    more = store.put("more", verified(texts, pairs, k, num, den).distinct())
    repeats = sets.filter("n > 0 AND doc_id IS NOT NULL").join(classes, "digest").filter("doc_id <> rep").groupBy("doc_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).filter("lo < hi")
    edges = first.select(F.col("id").alias("a"), F.col("comp").alias("b")).union(more).union(repeats.select("lo", "hi"))
    final = store.put("final", components(store, edges, "cc2"))
    store.keep("sets", "classes", "final")

    named = classes.join(final.withColumnRenamed("id", "rep"), "rep", "left").select("digest", F.coalesce("comp", "rep").alias("comp"))
    out = sets.select("doc_id", "n", "digest").join(named, "digest", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id")).alias("component_id"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
