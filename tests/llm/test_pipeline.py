"""The pipeline's stages on a small corpus with planted cases, and on odd tables."""

import random

import pytest

import corpus_pipeline

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join(f"{chr(97 + rng.randrange(26))}{rng.randrange(300):x}" for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    texts = [words(rng, rng.randrange(40, 90)) for _ in range(60)]
    texts += [t.upper().replace(" ", "!! ") for t in (words(rng, 50) for _ in range(25))]
    texts += [texts[0], texts[1] + " extra", None, "", 'x token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" ' + words(rng, 30)]
    item = words(rng, 20)
    texts += [f"{words(rng, 30)} {item} {words(rng, 5)}"]
    docs = [(i, t, "en", f"s{i % 3}" if i != 5 else None, None if t is None else len(t)) for i, t in enumerate(texts)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 0 if 60 <= i < 85 else 1, 0) for i in range(85)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_decisions_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    n = docs.count()
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder).cache()
        kept[name] = {r["doc_id"] for r in out.select("doc_id").collect()}
        if name != "packing":
            assert out.columns == docs.columns
            docs = out
    clean = set(range(60)) | {87, 88, 89}
    assert clean <= kept["quality"] and not kept["quality"] & set(range(60, 85))
    assert kept["quality"] - kept["near_duplicates"] == {85, 86}
    assert kept["near_duplicates"] - kept["benchmark_leaks"] == {n - 1}
    assert kept["secrets"] == kept["benchmark_leaks"] == kept["packing"]
    text = docs.filter("doc_id = 89").first()
    assert "04dbeb" not in text["text"] and "<SECRET>" in text["text"] and text["n_chars"] == len(text["text"])
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, folder).select("doc_id").collect()} == kept["packing"]


def test_empty_and_null_rows(spark, folder):
    for rows in ([], [(None, None, None, None, None), (1, "", None, None, 0), (1, "", None, None, 0), (2, "z" * 20000, "en", "a", 5)]):
        docs = spark.createDataFrame(rows, COLUMNS)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, folder)
            assert out.count() >= len(rows), name
            if name != "packing":
                docs = spark.createDataFrame(out.collect(), COLUMNS)


def test_near_copies_with_scattered_edits_go(spark):
    def edited(n, edits, name):
        base = [f"{name}{i}" for i in range(n)]
        copy = list(base)
        for j in range(edits):
            copy[(2 * j + 1) * n // (2 * edits)] = f"{name}new{j}"
        return [" ".join(base), " ".join(copy)]

    def alike(a, b):
        x, y = ({tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b))
        return 10 * len(x & y) >= 8 * len(x | y)

    texts = [t for n, edits, name in ((200, 4, "a"), (100, 2, "b"), (400, 7, "c"), (1000, 18, "d"), (200, 5, "e"), (100, 3, "f")) for t in edited(n, edits, name)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], COLUMNS)
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").select("doc_id").collect()}
    assert kept == {i for i in range(len(texts)) if i % 2 == 0 or not alike(texts[i - 1], texts[i])} == {0, 2, 4, 6, 8, 9, 10, 11}


def test_run_against_brute_force(spark, folder):
    from test_operators import greedy, hits

    from tessera.llm import quality, secrets

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    scores = {r["doc_id"]: r["score"] for r in quality.score_quality(spark, docs, quality.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))).collect()}
    left = {r["doc_id"]: r["text"] for r in docs.collect() if scores[r["doc_id"]] >= 0.5}

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    root = {}
    for d in sorted(left):
        mine = shingles(left[d])
        alike = {root[e] for e in root if mine and 100 * len(mine & shingles(left[e])) >= 80 * len(mine | shingles(left[e]))}
        root[d] = min(alike, default=d)
        root = {e: root[d] if r in alike else r for e, r in root.items()}
    left = {d: t for d, t in left.items() if root[d] == d}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    clean = {d for d, _, marked, _ in hits(left.items(), items) if not marked}
    left = {d: t for d, t in left.items() if d in clean}
    kept = spark.createDataFrame([(d, t, None, None, 0) for d, t in left.items()], COLUMNS)
    model = secrets.train(kept)

    def masked(t):
        spans = [(a, b) for a, _, b in secrets.base_spans(t)]
        spans += [m.span() for m in secrets.TOKEN.finditer(t) if len(m[0]) >= secrets.LEAST and model.ratio([m[0]])[0] >= model.threshold and all(b <= m.start() or m.end() <= a for a, b in spans)]
        out, at = "", 0
        for a, b in sorted(spans):
            if a >= at:
                out += t[at:a] + secrets.MASK
            at = max(at, b)
        return out + t[at:]

    expected = {d: greedy(masked(t) if t else t) for d, t in left.items()}
    packed, bins = {}, {}
    for r in corpus_pipeline.run(spark, folder).collect():
        packed[r["doc_id"]] = packed.get(r["doc_id"], 0) + r["n_tokens"]
        if r["bin_id"] is not None:
            bins[r["bin_id"]] = bins.get(r["bin_id"], 0) + r["n_tokens"]
    assert packed == expected and max(bins.values()) <= 2048
