"""Every operator against brute force, and its defined results for nulls, empty and long texts, ties, repeats and clashes."""

import hashlib
import random
import re

import numpy as np
import pytest

from tessera.llm import chunks, decontaminate, html, jaccard, packing, quality, secrets, suffix, text, tokens, topk

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
VOCABULARY = tokens.pieces_of()


def words_of(rng, n, size=400):
    return [f"{chr(97 + rng.randrange(26))}{rng.randrange(size):x}" for _ in range(n)]


def corpus(seed=1, n=60):
    """Random texts, copies, near copies, shared passages, blanks, one long text."""
    rng = random.Random(seed)
    base = [" ".join(words_of(rng, rng.randrange(1, 120))) for _ in range(n)]
    passage = " ".join(words_of(rng, 70))
    out = list(base)
    out += base[:5]
    for t in base[5:20]:
        w = t.split()
        w[rng.randrange(len(w))] = "Ünlike"
        out.append(" ".join(w))
    out += [f"{base[i]} {passage} {base[i + 1]}" for i in range(20, 28)]
    out += [None, "", "   \n", "One", "two words", "x" * 5000, " ".join(words_of(rng, 30000))]
    return [(i, t) for i, t in enumerate(out)]


DOCS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string").repartition(3)


def extra(docs):
    """Columns whose names clash with what the operators make."""
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit("x") for c in ("n", "digest", "spans", "items", "n_words", "score", "start", "end", "anchor", "_hit", "_b", "comp", "id", "n_tokens", "base_spans", "secret_spans", "kept", "size")})


def rows(frame, *names):
    return sorted(tuple(r[n] for n in names) for r in frame.collect())


# words ---------------------------------------------------------------------------------------------------------------
def test_words_match_their_patterns():
    import pyarrow as pa

    samples = ["Abc d\x00e  f-9Z\té ü", "", "--", "x"]
    for kind, pattern in ((text.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), (text.SPACED, r"[^\x20\x09-\x0D]+")):
        for _, _, buf, offsets in text.slices(pa.array(samples)):
            low, starts, ends, firsts = text.words(buf, offsets, kind)
            got = [[low[a:b].tobytes().decode() for a, b in zip(starts[firsts[i] : firsts[i + 1]], ends[firsts[i] : firsts[i + 1]], strict=True)] for i in range(len(samples))]
            assert got == [re.findall(pattern, s.translate(LOWER)) for s in samples]


def test_sliding_min_is_the_leftmost():
    rng = np.random.default_rng(0)
    v = rng.integers(0, 5, 50).astype(np.uint64)
    for w in (1, 2, 3, 7, 50):
        assert text.sliding_min(v, w).tolist() == [i + int(np.argmin(v[i : i + w])) for i in range(len(v) - w + 1)]


def test_sliding_least_is_the_leftmost_by_its_top_bits():
    rng = np.random.default_rng(0)
    v = (rng.integers(0, 5, 60).astype(np.uint64) << np.uint64(24)) + rng.integers(0, 1 << 24, 60).astype(np.uint64)
    top = v >> np.uint64(24)
    for w in (1, 2, 3, 7, 60):
        assert text.sliding_least(v, w).tolist() == [i + int(np.argmin(top[i : i + w])) for i in range(len(v) - w + 1)]
    long = text.mix(np.arange((1 << 24) + 100))
    assert (text.sliding_least(long, 69)[-50:] == text.sliding_least(long[-118:], 69) + len(long) - 118).all()
    assert len(text.sliding_least(long, 69)) == len(long) - 68


# 1 -------------------------------------------------------------------------------------------------------------------
def greedy(t):
    known, n = set(VOCABULARY) | {bytes([b]) for b in range(256)}, 0
    longest = max(map(len, known))
    for w in re.findall(r"[^\x20\x09-\x0D]+", t or ""):
        b, i = tokens.MARK + w.encode(), 0
        while i < len(b):
            i += next(k for k in range(min(longest, len(b) - i), 0, -1) if b[i : i + k] in known)
            n += 1
    return n


def test_token_counts(spark, docs):
    more = spark.createDataFrame([(900, "日本語テキスト 😀 naïve ▁▁ a\x00b"), (901, "unbelievable " * 50)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.count_tokens(spark, extra(docs.union(more))).collect()}
    assert got == {d: greedy(t) for d, t in [*DOCS, *((r["doc_id"], r["text"]) for r in more.collect())]}


def test_token_counts_of_nothing(spark, docs):
    assert tokens.count_tokens(spark, docs.limit(0)).count() == 0


# 2 -------------------------------------------------------------------------------------------------------------------
PAGE = (
    "<html><head><title>t</title><style>p{{}}</style></head><body><nav><a>Home</a></nav><div class='ad'>buy {0}</div><article><h1>Head &amp; {0}</h1>"
    "<p>One   <b>two\n three</b><br>four<p>five<script>var x='</p>'</script></p><div class='comments'><p>first!</p></div><form>x<p>y</p></form></article><footer>&copy;</footer></body></html>"
)
BARE = "<html><body><ul><li>Home</li><li>Shop</li></ul><div>Hello {0}</div><p>mine {0}</p><div>Contact us</div></body></html>"


def test_html_extraction(spark):
    pages = [
        (1, "http://h.x/a/1", PAGE.format(1)), (2, "http://h.x/a/2", PAGE.format(2)), (3, "http://b.x/p/1", BARE.format(1)), (4, "http://b.x/p/2.html?x=1", BARE.format(2)),
        (5, "http://c.x/only", BARE.format(3)), (6, None, None), (7, "", ""), (8, "http://b.x/p/2#top", BARE.format(4)), (1, "http://h.x/a/1", PAGE.format(1)),
    ]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = rows(html.extract_text(spark, extra(frame).withColumnRenamed("n", "host").withColumnRenamed("digest", "lines")), "page_id", "text")
    article = "Head & {0}\nOne two three\nfour\nfive"
    assert got == [
        (1, article.format(1)), (1, article.format(1)), (2, article.format(2)), (3, "Hello 1\nmine 1"), (4, "Hello 2\nmine 2"),
        (5, "Home\nShop\nHello 3\nmine 3\nContact us"), (6, ""), (7, ""), (8, "Hello 4\nmine 4"),
    ]
    assert html.extract_text(spark, frame.limit(0)).count() == 0


def test_articles_before_main_and_without_comments():
    page = "<main><p>crumbs</p><article class='post'><header class='entry-header'><h1>T</h1></header><p>a</p><article class='comment'>no</article><aside>no</aside></article><div id='comments'>no</div></main>"
    assert html.main_text(page) == "T\na"
    assert html.main_text("<main><p>x &lt;b&gt;</p><nav>no</nav></main><p>no</p>") == "x <b>"
    assert html.main_text("<p>unclosed <b>bold<p>next<ul><li>one<li>two</ul>tail") == "unclosed bold\nnext\none\ntwo\ntail"


def test_lines_outside_of_the_article_are_decided_by_alignment(spark):
    page = "<html><body><div>Site line</div><div>lead {0}</div><{1}><p>reposted</p><p>own {0}</p></{1}><div>Imprint</div></body></html>"
    pages = [(1, "http://h.x/a/1", page.format(1, "article")), (2, "http://h.x/a/2", page.format(2, "article")), (3, "http://m.x/a/1", page.format(3, "main")), (4, "http://m.x/a/2", page.format(4, "div")), (5, "http://o.x/a", page.format(5, "article"))]
    got = dict(rows(html.extract_text(spark, spark.createDataFrame(pages, "page_id long, url string, html string")), "page_id", "text"))
    assert got == {1: "lead 1\nreposted\nown 1", 2: "lead 2\nreposted\nown 2", 3: "lead 3\nreposted\nown 3", 4: "lead 4\nown 4", 5: "reposted\nown 5"}


def whole_operator(pages):
    """The operator by plain lists: lines of every page stand in one global order, so that shared lines are an intersection."""

    def cut(html_):
        return [(m, t) for m, t in html.page_lines(html_)]

    def place(url):
        host, _, path = re.sub(r"^[a-z]+://", "", re.sub(r"[?#].*", "", url or "")).partition("/")
        return (host.lower(), re.sub(r"(\.html?|/)$", "", "/" + path if path or "/" in (url or "")[8:] else "")) if "://" in (url or "") else ("", url or "")

    stands = {}
    for i, url, h in sorted(pages, key=lambda p: p[0]):
        if cut(h):
            stands.setdefault(place(url), [t for _, t in cut(h)])
    out = []
    for i, url, h in pages:
        host, path = place(url)
        paths = sorted(p for g, p in stands if g == host)
        others = []
        if (host, path) in stands:
            at, own = paths.index(path), stands[host, path]
            for step in range(1, 5):
                for side, j in enumerate((at - step, at + step)):
                    if 0 <= j < len(paths) and stands[host, paths[j]] != own:
                        them, common = stands[host, paths[j]], 0
                        while common < min(len(path), len(paths[j])) and path[common] == paths[j][common]:
                            common += 1
                        others.append((10 * len(set(own) & set(them)) >= 9 * max(len(set(own)), len(set(them))), -common, step, side, them))
        others = [set(o[-1]) for o in sorted(others)[:4]]
        lines = cut(h)
        gone = {t for _, t in lines if 2 * sum(t in o for o in others) > len(others)}
        plain = [(m, t) for m, t in lines if not m % 2]
        inside = [(m, t) for m, t in plain if m and m // 2 % 4 == max(x // 2 % 4 for x, _ in plain)]
        if not others or all(t in gone for _, t in plain):
            text_ = inside or plain
        else:
            holders = {m for m, t in inside if t not in gone} or {m for m, _ in inside}
            text_ = [(m, t) for m, t in plain if t not in gone or m in holders]
        out.append((i, "\n".join(t for _, t in text_)))
    return sorted(out)


@pytest.mark.parametrize("block", [512, 5])
def test_html_extraction_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(html, "BLOCK", block)
    rng = random.Random(6)
    pages = []
    for i in range(160):
        menu = "".join(f"<li>menu {k}</li>" for k in range(rng.randrange(2, 6)))
        ad = f"<div class='ad'>ad {rng.randrange(3)}</div>" if rng.random() < 0.5 else f"<div>banner {rng.randrange(2)}</div>"
        body = "".join(f"<p>text {rng.randrange(10 * k, 10 * k + (3 if rng.random() < 0.3 else 9)):04}</p>" for k in range(rng.randrange(1, 8)))
        tag = rng.choice(("article", "main", "div", "section"))
        teaser = "<article>zz teaser</article>" if rng.random() < 0.3 else ""
        foot = f"<div>zzz foot {rng.randrange(2)}</div><div>zzzz imprint</div>"
        h = rng.choice((None, "", "<p></p>")) if rng.random() < 0.05 else f"<html><body><ul>{menu}</ul>{ad}<{tag}>{body}</{tag}>{teaser}{foot}</body></html>"
        url = rng.choice(("", ".html", "/", "?a=1", "#x")).join((f"http://{rng.choice(('One', 'two', 'three', f'single{i}'))}.example/{rng.choice(('a', 'b/c'))}/{rng.randrange(60)}", ""))
        pages.append((i, url if rng.random() < 0.95 else None, h))
    frame = spark.createDataFrame(pages, "page_id int, url string, html string").repartition(5)
    found = rows(html.extract_text(spark, frame), "page_id", "text")
    assert found == whole_operator(pages)
    monkeypatch.setattr(html, "partners", lambda *a: [])  # without alignments the texts differ
    assert found != sorted((i, html.main_text(h)) for i, _, h in pages)


def test_shared_lines_are_a_longest_common_subsequence():
    rng = random.Random(3)

    def length(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(9))] for _ in range(2))
        found = sorted(html.shared(a, b))
        assert len(found) == length(a, b)
        it = iter(b)
        assert all(a[i] in it for i in found)


def test_shared_lines_of_very_long_pages_are_a_longest_common_subsequence(monkeypatch):
    x, y, z = range(900), range(1000, 1900), range(2000, 3000)
    own, other = [*x, 7000, *y, *z], [7000, *z, *x, *y]  # the longest block, z, is not on the longest common subsequence
    assert len(own) * len(other) > 4_000_000
    assert html.shared(own, other) == {*range(900), *range(901, 1801)}
    rng = random.Random(4)
    pairs = [[[rng.randrange(5) for _ in range(rng.randrange(40))] for _ in range(2)] for _ in range(200)]
    whole = [len(html.shared(a, b)) for a, b in pairs]
    monkeypatch.setattr(html, "CELLS", 3)
    for (a, b), n in zip(pairs, whole, strict=True):
        found = sorted(html.shared(a, b))
        it = iter(b)
        assert len(found) == n and all(a[i] in it for i in found)


# 3 -------------------------------------------------------------------------------------------------------------------
def hits(docs_, items):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for i, t in items:
        w = pattern.findall((t or "").translate(LOWER))
        m = min(10, len(w))
        for j in range(len(w) - m + 1 if w else 0):
            windows.setdefault(tuple(w[j : j + m]), set()).add(str(i))
    out = []
    for d, t in docs_:
        w, mark, found = pattern.findall((t or "").translate(LOWER)), set(), set()
        for m in {len(k) for k in windows}:
            for j in range(len(w) - m + 1):
                if own := windows.get(tuple(w[j : j + m])):
                    found |= own
                    mark |= set(range(j, j + m))
        out.append((d, len(w), len(mark), sorted(found)))
    return sorted(out)


@pytest.mark.parametrize("block", [8 << 20, 300])
def test_decontamination(spark, docs, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    pick = lambda i, a, b: " ".join(DOCS[i][1].split()[a:b])
    long = max((d for d in DOCS if d[1]), key=lambda d: len(d[1]))[0]
    items = [(1, pick(long, 5, 40)), (2, pick(long, 30, 45)), (3, pick(25, 0, 12).upper()), (4, "two WORDS"), (5, "one"), (6, ""), (7, None), (2, pick(long, 30, 45)), (9, pick(30, 0, 10))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r["doc_id"], r["n_words"], sum(b - a for a, b in zip(r["spans"][::2], r["spans"][1::2], strict=True)), r["items"]) for r in decontaminate.decontaminate(spark, extra(docs), bench).collect())
    assert got == hits(DOCS, items)


def test_decontamination_of_nothing(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert all(not r["spans"] and not r["items"] for r in decontaminate.decontaminate(spark, docs, none).collect())
    assert decontaminate.decontaminate(spark, docs.limit(0), none).count() == 0


# 4 -------------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("shard, block", [(4096, 8192), (16, 2)])
def test_top_k(spark, monkeypatch, shard, block):
    monkeypatch.setattr(topk, "SHARD_ROWS", shard)
    monkeypatch.setattr(topk, "QUERY_BLOCK", block)
    rng = np.random.default_rng(5)
    data = [(i, [float(x) for x in rng.normal(size=8).round(2)]) for i in range(1500)]
    data += [(2000, data[3][1]), (301, data[3][1]), (302, None), (303, [1.0, None]), (304, [float("nan")] * 8), (305, [float("inf")] * 8), (None, [0.0] * 8), (306, [2.0]), (307, [])]
    data = [d for i, d in enumerate(data) if d[0] not in (301, 302, 303, 304, 305, 306, 307) or i >= 1500]
    frame = extra(spark.createDataFrame(data, "vec_id long, embedding array<float>").repartition(4))
    got = rows(topk.top_k(spark, frame, frame.filter("vec_id % 100 = 0")), "query_id", "rank", "vec_id", "score")
    vectors = {i: np.floor(1024 * np.pad(np.array(v, np.float32).astype(np.float64), (0, 8 - len(v)))) for i, v in data if i is not None and v is not None and None not in v and np.isfinite(v).all()}
    expected = []
    for q in (v for v in vectors if v % 100 == 0):
        best = sorted(((-int(vectors[q] @ v), i) for i, v in vectors.items() if i != q))[:10]
        expected += [(q, k, i, -s) for k, (s, i) in enumerate(best, 1)]
    assert got == sorted(expected)
    assert topk.top_k(spark, frame.limit(0), frame.limit(0)).count() == 0


def test_maxscore_prunes_and_loses_nothing():
    rng = np.random.default_rng(6)
    dims, scale = 24, np.exp(-np.arange(24) / 3)  # terms of falling weight, as of a rotated space
    vectors = np.floor(1024 * rng.normal(size=(4000, dims)) * scale)
    ids, queries = np.arange(4000), vectors[::200]
    for shard in (64, 500):
        best, traversed = topk.Best(len(queries), 10), 0
        for lo in range(0, 4000, shard):
            traversed += topk.search_shard(ids[::200], queries, ids[lo : lo + shard], vectors[lo : lo + shard], best)
        assert traversed < 0.6 * dims * len(queries) * (4000 / shard)  # most terms are non-essential
        for q, vector in enumerate(queries):
            expected = sorted(((-int(vector @ v), i) for i, v in enumerate(vectors) if i != 200 * q))[:10]
            assert [(-int(s), int(i)) for s, i in zip(best.score[q], best.ids[q], strict=True)] == expected


def test_top_k_of_huge_components(spark):
    frame = spark.createDataFrame([(0, [1e300, 1.0]), (1, [1e300, 2.0]), (2, [-1e300, 0.0])], "vec_id long, embedding array<double>")
    got = rows(topk.top_k(spark, frame, frame.filter("vec_id = 0")), "rank", "vec_id", "score")
    assert [(r, v) for r, v, _ in got] == [(1, 1), (2, 2)] and got[0][2] == 2**63 - 1024 == -got[1][2]


# 5 -------------------------------------------------------------------------------------------------------------------
def test_best_fit_takes_the_tightest_compatible_bin():
    rng = random.Random(2)
    for _ in range(100):
        n, cap = rng.randrange(1, 40), 20
        sizes = sorted((rng.randrange(1, cap + 1) for _ in range(n)), reverse=True)
        sources, clusters = [1 << rng.randrange(5) for _ in range(n)], [rng.choice([0, 1, 2]) for _ in range(n)]
        got, bins, fill = packing.best_fit(sizes, sources, clusters, cap), [], []
        for (b, offset), s, so, cl in zip(got, sizes, sources, clusters, strict=True):
            fit = [cap - f for f, (x, y) in zip(fill, bins, strict=True) if cap - f >= s and not x & so and not y & cl]
            if b == len(bins):
                assert not fit
                bins.append((0, 0))
                fill.append(0)
            else:
                assert cap - fill[b] == min(fit)
            assert offset == fill[b]
            fill[b] += s
            bins[b] = (bins[b][0] | so, bins[b][1] | cl)


def test_packing(spark, docs):
    from pyspark.sql import functions as F

    some = extra(docs).withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("doc_id") % 7).cast("string")))).withColumn("source", F.when(F.col("doc_id") != 4, F.col("source")))
    got = packing.pack_documents(spark, some, capacity=256).collect()
    sizes = {d: greedy(t) for d, t in DOCS}
    packed = {}
    for r in got:
        packed[r["doc_id"]] = packed.get(r["doc_id"], 0) + r["n_tokens"]
    assert packed == sizes
    bins = {}
    for r in got:
        if r["bin_id"] is not None:
            bins.setdefault(r["bin_id"], []).append(r)
    source = {r["doc_id"]: r["source"] for r in some.select("doc_id", "source").collect()}
    for pieces in bins.values():
        at = 0
        for p in sorted(pieces, key=lambda r: r["bin_offset"]):
            assert p["bin_offset"] == at
            at += p["n_tokens"]
        assert at <= 256
        named = [source[p["doc_id"]] for p in pieces if source[p["doc_id"]]]
        assert len(named) == len(set(named))
        norm = [re.sub(r"\s+", " ", DOCS[p["doc_id"]][1].lower()) for p in pieces]
        assert len(norm) == len(set(norm))
    assert packing.pack_documents(spark, some.limit(0)).count() == 0


# 6 -------------------------------------------------------------------------------------------------------------------
def test_difference_cover_sorts_suffixes():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 4, 5, 6, 7, 8, 30, 31, 32, 400):
        for a in (1, 2, 5):
            s = rng.integers(1, 1 + a, n)
            assert suffix.difference_cover(s).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())


def removed(docs_):
    return removed_in_order(sorted(docs_))


def removed_in_order(docs_):
    seen, out = set(), []
    for d, t in docs_:
        b = (t or "").encode()
        mark = bytearray(len(b))
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                mark[i : i + 100] = b"\1" * 100
            seen.add(b[i : i + 100])
        runs = sum(1 for i in range(len(b)) if mark[i] and not (i and mark[i - 1]))
        out.append((d, len(b), runs, bytes(c for c, m in zip(b, mark, strict=True) if not m)))
    return out


@pytest.mark.parametrize("hot", [512, 2])
def test_suffix_dedup(spark, docs, monkeypatch, hot):
    monkeypatch.setattr(suffix, "HOT", hot)
    rng = random.Random(12)
    passage = " ".join(words_of(rng, 40))
    shared = [f"{' '.join(words_of(rng, 12))} {passage[rng.randrange(9) : len(passage) - rng.randrange(9)]} {' '.join(words_of(rng, 12))}" for _ in range(30)]
    more = [(500, "é" * 200), (501, "ab" * 200), (502, "Z" + "ab" * 120), (500, "é" * 200), *((600 + i, t) for i, t in enumerate(shared))]
    both = extra(docs.union(spark.createDataFrame(more, "doc_id long, text string")))
    got = sorted((r["doc_id"], r["n_bytes"], len(r["spans"]), bytes(r["kept"])) for r in suffix.suffix_dedup(spark, both).collect())
    known = {r["doc_id"]: r["text"] for r in both.collect()}
    expected = removed(known.items())
    expected += [e for e in expected if e[0] == 500]
    assert got == sorted(expected)
    assert suffix.suffix_dedup(spark, docs.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [512, 1])
def test_suffix_dedup_of_rows_that_repeat_a_doc_id(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix, "HOT", hot)
    rng = random.Random(13)
    long, other = " ".join(words_of(rng, 60)), " ".join(words_of(rng, 60))
    data = [(1, f"{long} a"), (1, "short"), (1, f"b {long} {other}"), (1, f"{long} a"), (1, None), (1, ""), (2, f"c {other} d"), (3, f"{long[:150]} e"), (None, long), (4, None)]
    frame = spark.createDataFrame(data, "doc_id long, text string")
    order = {t: h for t, h in frame.selectExpr("text", "xxhash64(coalesce(text, '')) AS h").distinct().collect()}
    rows_ = [r for r in data if r[0] is not None]
    distinct = sorted({(d, order[t], t or "") for d, t in rows_})
    known = {(d, t): e for (d, _, t), e in zip(distinct, [e for e in removed_in_order([(d, t) for d, _, t in distinct])], strict=True)}
    got = sorted((r["doc_id"], r["n_bytes"], len(r["spans"]), bytes(r["kept"])) for r in suffix.suffix_dedup(spark, frame).filter("doc_id IS NOT NULL").collect())
    assert got == sorted(known[d, t or ""] for d, t in rows_)


def test_contexts_are_told_apart_by_the_other_hash(monkeypatch):
    rng = np.random.default_rng(14)
    buf = rng.integers(97, 123, 900).astype(np.uint8)
    offsets = np.array([0, 300, 600, 900])
    buf[600:] = buf[:300]
    monkeypatch.setattr(text, "range_hashes", lambda codes, starts, ends, base=None: np.zeros(len(starts), np.uint64) if base is None else real(codes, starts, ends, base))
    of, _, _, _, _, context, other = suffix.anchors(buf, offsets)
    for i, j in ((0, 1), (1, 2)):
        assert set(context[of == i]) & set(context[of == j]) and not set(other[of == i]) & set(other[of == j])
    assert other[of == 0].tolist() == other[of == 2].tolist()


real = text.range_hashes


# 7 -------------------------------------------------------------------------------------------------------------------
def test_secret_scans(spark, docs):
    secret = hashlib.sha1(b"x").hexdigest()
    cases = [
        (700, f'é😀 token = "{secret}" and {secret[:23]} {secret[:24]}'), (701, "password:abc password: abcdef PASSWD='x_y=z.w' api-key=abcdefg apikey=abcdefg"), (702, "AKIA" + "A" * 15 + " AKIA" + "B7" * 8),
        (703, "see mail4_example_com and an_ordinary_identifier_name_v2 or getUserAccountSettingsById"), (704, "key wJalrXUtnFEMIK7MDENGbPxRfiCYzEXAM9LEKEY here"), (705, None), (706, ""), (707, "4929348385146306"),
    ]
    frame = extra(docs.union(spark.createDataFrame(cases, "doc_id long, text string")))
    got = {r["doc_id"]: r for r in secrets.scan_secrets(spark, frame).collect()}
    told = lambda d, c: [(s["kind"], s["start"], s["end"]) for s in got[d][c]]
    t = cases[0][1]
    assert told(700, "base_spans") == [("assign", 3, 3 + len('token = "') + 40), ("hex", 12, 52), ("hex", len(t) - 24, len(t))]
    assert [k for k, _, _ in told(701, "base_spans")] == ["assign", "assign", "assign"]
    assert told(702, "base_spans") == [("access", 20, 40)]
    assert not told(703, "secret_spans") and not told(707, "secret_spans") and not told(705, "secret_spans") and not told(706, "secret_spans")
    assert told(704, "secret_spans") == [("random", 4, 43)] and not told(704, "base_spans")
    masked = {r["doc_id"]: r["text"] for r in secrets.scan_secrets(spark, frame, mask=True).collect()}
    assert masked[704] == "key <SECRET> here" and masked[705] is None and masked[703] == cases[3][1]
    assert all(masked[d] == t for d, t in DOCS)
    assert secrets.scan_secrets(spark, docs.limit(0)).count() == 0


def english(rng, n):
    return " ".join(rng.choice(("the", "river", "bridge", "Über", "season", "of", "winter", "garden", "people", "number", "7", "2024-05-01", "mail8@example.com", "state-run")) for _ in range(n))


def test_secret_scans_against_brute_force(spark):
    rng = random.Random(21)
    alphabets = secrets.KINDS_OF_RANDOM
    data, planted = [], {}
    for i in range(150):
        words_ = english(rng, rng.randrange(5, 60)).split()
        if i % 3 == 0:
            planted[i] = "".join(rng.choice(alphabets[i % len(alphabets)]) for _ in range(rng.randrange(16, 40)))
            words_.insert(rng.randrange(len(words_)), f"«{planted[i]}»")
        if i % 5 == 0:
            words_.append(f"token: {rng.getrandbits(128):x} Xé=AKIA{'Q7' * 9}{'=' * (i % 2)}")
        data.append((i, " ".join(words_)))
    data += [(200, None), (201, ""), (202, english(rng, 30000))]
    frame = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    model = secrets.train(frame)

    def spans_of(t):
        found = []
        for kind, pattern, least in (("assign", secrets.ASSIGN, 0), ("access", secrets.ACCESS, 20), ("hex", secrets.HEX, 24)):
            found += [(m.start(), kind, m.end()) for m in pattern.finditer(t) if m.end() - m.start() >= least and (kind != "assign" or len(m[2]) >= 6)]
        base = sorted(found, key=lambda s: (s[0], ("assign", "access", "hex").index(s[1])))
        for m in secrets.TOKEN.finditer(t):
            if len(m[0]) >= 12 and all(b <= m.start() or m.end() <= a for a, _, b in base):
                logs = [sum(table[secrets._A if k == 0 else secrets.ALPHABET.index(m[0][k - 1]), secrets.ALPHABET.index(c)] for k, c in enumerate(m[0])) for table in model.tables]
                mean = lambda x: np.log(np.mean(np.exp(np.array(x) - max(x)))) + max(x)
                if mean(logs[:-2]) - mean(logs[-2:]) >= model.threshold:
                    found.append((m.start(), "random", m.end()))
        return sorted(found)

    got = {r["doc_id"]: sorted((s["start"], s["kind"], s["end"]) for s in r["secret_spans"]) for r in secrets.scan_secrets(spark, frame).collect()}
    assert got == {i: spans_of(t or "") for i, t in data}
    caught = sum(any(k in ("random", "hex") and data[i][1][a:b].find(planted[i]) >= 0 for a, k, b in got[i]) for i in planted)
    assert caught >= 0.9 * len(planted)
    assert all(not got[i] for i, _ in data if i % 3 and i % 5)


def test_counts_of_words_are_those_of_all_tokens():
    import pyarrow as pa

    rng = random.Random(22)
    texts = [None, "", "ab", "cd", *(english(rng, 40) for _ in range(20)), f"é token = {'ab9' * 9} end", "x" * 40]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    counts = np.array(next(secrets._gather([batch])).column(0)[0].as_py())
    a = secrets._A
    captured, plain, first, last = np.split(counts, np.cumsum([(a + 1) * a, (a + 1) * a, a * a]))
    taken, others = [], []
    for t in texts:
        base = secrets.base_spans(t or "")
        for m in secrets.TOKEN.finditer(t or ""):
            (others if all(e <= m.start() or m.end() <= s for s, _, e in base) else taken).append(m[0])
    assert captured.reshape(a + 1, a).tolist() == secrets.count_pairs([t for t in taken if len(t) >= 12]).tolist()
    assert plain.reshape(a + 1, a).tolist() == secrets.count_pairs(others).tolist()
    assert first.sum() == sum(len(t) > 1 for t in others) and last[secrets.ALPHABET.index("b")] == sum(t[-1] == "b" for t in others)


def test_threshold_is_that_of_all_documents(spark):
    from pyspark.sql import functions as F

    rng = random.Random(23)
    order = [r["id"] for r in spark.range(2600).orderBy(F.xxhash64("id"), "id").collect()]
    odd = lambda: "".join(rng.choice("BCDFGHJKLMNPQRSTVWXZ0123456789bdfhkqvxz") for _ in range(rng.randrange(7, 11)))
    data = [(d, english(rng, rng.randrange(12))) for d in order[:2200]] + [(d, f"é {odd()} token = {'ab9' * 9} {odd()} Of_tHe {odd()}, {odd()} a") for d in order[2200:]]
    data += [(None, english(rng, 9)), (7, None), (7, "two words"), (7, "")]
    frame = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    model = secrets.train(frame)
    ratios = []
    for _, t in data:
        base = [(a, b) for a, _, b in secrets.base_spans(t or "")]
        w = [m[0] for m in secrets.TOKEN.finditer(t or "") if len(m[0]) < 12 and all(b <= m.start() or m.end() <= a for a, b in base)]
        made = []
        for i, (a, b, c) in enumerate(zip(w, w[1:], w[2:], strict=False)):
            mark = "_-/"[i % 3]
            made.append((f"{a}{mark}{b}{mark}{c}", f"{a}{b.capitalize()}{c.capitalize()}{i % 100}", f"{a.upper()}_{b.upper()}", f"{a}{mark}{b}{i % 10000}")[i // 3 % 4])
        made = [x for x in made if len(x) >= 12]
        ratios += model.ratio(made).tolist() if made else []
    steps = sorted((np.floor(4 * np.array(ratios)) / 4).tolist(), reverse=True)
    assert model.threshold == max(8.0, steps[int(1e-4 * len(steps))] + 0.25) > 8.0


def test_identifiers_follow_their_forms(spark):
    rng = random.Random(24)
    texts = [english(rng, n) for n in (0, 1, 2, 3, 70, 400)] + ["", "aB cD-eF Gh " * 20]
    for batch in (texts, texts[:3]):
        raw = [t.encode() for t in batch]
        buf, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in raw])])
        _, starts, ends, _ = text.words(buf, offsets, secrets._TOKENS)
        made, a, b = secrets.identifiers(buf, offsets, starts, ends)
        expected = []
        for t in batch:
            w = secrets.TOKEN.findall(t)
            for i, (x, y, z) in enumerate(zip(w, w[1:], w[2:], strict=False)):
                mark = "_-/"[i % 3]
                expected.append((f"{x}{mark}{y}{mark}{z}", f"{x}{y.capitalize()}{z.capitalize()}{i % 100}", f"{x.upper()}_{y.upper()}", f"{x}{mark}{y}{i % 10000}")[i // 3 % 4])
        assert [made[i:j].tobytes().decode() for i, j in zip(a, b, strict=True)] == [x for x in expected if len(x) >= 12]


# 8 -------------------------------------------------------------------------------------------------------------------
def gear_chunks(t):
    """The chunks of a text, byte by byte."""

    def mixed(x):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) % 2**64
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) % 2**64
        return x ^ (x >> 31)

    table, out, last, h, data = [mixed(i + 1) for i in range(256)], [], 0, 0, t.encode()
    for i, byte in enumerate(data, 1):
        h = (2 * h + table[byte]) % 2**64
        if i == len(data) or i - last == 96 or (i - last >= 16 and h < 2**60):
            out.append(data[last:i])
            last = i
    return out


def test_chunks_cover_and_resist_shifts():
    import pyarrow as pa

    rng = random.Random(9)
    body = bytes(rng.randrange(97, 123) for _ in range(20000)).decode()
    texts = ["", body, "x", f"inserted{body}", *(t for _, t in DOCS if t)]
    got = [[] for _ in texts]
    for lo, _, buf, offsets in text.slices(pa.array(texts)):
        starts, ends = chunks.cuts(buf, offsets)
        for a, b in zip(starts, ends, strict=True):
            got[lo + int(np.searchsorted(offsets, a, side="right")) - 1].append(buf[a:b].tobytes())
    assert got == [gear_chunks(t) for t in texts]
    assert len(set(got[1]) & set(got[3])) > 0.95 * len(got[1])


def removed_runs(docs_):
    """Documents in order to the runs of chunks that stand earlier."""
    seen, out = set(), []
    for t in docs_:
        at, runs = 0, []
        for c in gear_chunks(t or ""):
            if c in seen:
                if runs and runs[-1][1] == at:
                    runs[-1][1] += len(c)
                else:
                    runs.append([at, at + len(c)])
            seen.add(c)
            at += len(c)
        out.append([tuple(r) for r in runs if r[1] - r[0] >= chunks.RUN])
    return out


def test_substring_dedup(spark, docs):
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"]] for r in chunks.substring_dedup(spark, extra(docs)).collect()}
    assert got == dict(zip((d for d, _ in DOCS), removed_runs(t for _, t in DOCS), strict=True))
    assert any(got[d] for d in range(81, 88))  # the shared passage
    assert chunks.substring_dedup(spark, docs.limit(0)).count() == 0


def test_substring_dedup_of_rows_that_repeat_a_doc_id(spark):
    rng = random.Random(15)
    long = " ".join(words_of(rng, 80))
    data = [(1, f"a {long}"), (1, f"b {long}"), (1, f"a {long}"), (1, None), (2, f"{long} c"), (None, long), (3, "")]
    frame = spark.createDataFrame(data, "doc_id long, text string")
    order = {t: h for t, h in frame.selectExpr("text", "xxhash64(coalesce(text, '')) AS h").distinct().collect()}
    distinct = sorted({(d, order[t], t or "") for d, t in data if d is not None})
    known = {(d, t): r for (d, _, t), r in zip(distinct, removed_runs(t for _, _, t in distinct), strict=True)}
    got = sorted((r["doc_id"] or 0, r["n_bytes"], [(s["start"], s["end"]) for s in r["spans"]]) for r in chunks.substring_dedup(spark, frame).collect())
    assert got == sorted((d or 0, len(t or ""), known.get((d, t or ""), [])) for d, t in data)


# 9 -------------------------------------------------------------------------------------------------------------------
def test_quality(spark):
    from pyspark.sql import functions as F

    rng = random.Random(4)
    data, labels = [], []
    for i in range(400):
        good = i % 4 != 0
        w = words_of(rng, rng.randrange(5, 80))
        data.append((i, " ".join(w) if good else " ".join(x.upper() + "!!" for x in w)))
        labels.append((i, int(good), 0))
    data += [(900, None), (901, ""), (902, "word " * 40000)]
    labels += [(3, None, 0), (None, 1, 0), (5000, 1, 0), (1, 1, 0)]
    docs, marks = spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.fit(docs, marks)
    got = {r["doc_id"]: r["score"] for r in quality.score_quality(spark, extra(docs), model).collect()}
    held = [r["doc_id"] for r in docs.filter("doc_id < 400 AND crc32(cast(doc_id AS string)) % 3 = 1").select("doc_id").collect()]
    assert sum((got[d] >= 0.5) == (d % 4 != 0) for d in held) >= 0.98 * len(held)
    assert got[900] == got[901] and all(0 <= s <= 1 for s in got.values())
    empty = quality.fit(docs, marks.limit(0))
    assert {r["score"] for r in quality.score_quality(spark, docs, empty).collect()} == {0.5}
    assert quality.score_quality(spark, docs.limit(0), model).select(F.count("*")).first()[0] == 0


def test_quality_scores_are_exact_cosines():
    rng = np.random.default_rng(1)
    sample = [(int(rng.integers(2)), sorted(set(rng.integers(0, quality.DIMS, 20).tolist())), None) for _ in range(60)]
    sample = [(q, d, [1] * len(d)) for q, d, _ in sample]
    model = quality.Model(sample, {0: 30, 1: 40}, rank=16, k=5)
    unit = rng.normal(size=(700, 16)).astype(np.float32)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    for u, s in zip(unit[::50], model.score(unit)[::50], strict=True):
        like = model.vectors @ u
        near = np.argsort(-like)[:5]
        w = np.maximum(like[near], 0) * model.weights[near]
        assert abs(s - ((w * model.votes[near]).sum() / w.sum() if w.sum() > 0 else model.prior)) < 1e-5


def scores_by_hand(docs_, labels_, k, rank):
    """The classifier by dictionaries and full matrices, on labelled texts and all texts."""
    collapse = [(re.compile(rb"[a-z\x80-\xff]+"), b"a"), (re.compile(rb"[A-Z]+"), b"A"), (re.compile(rb"[0-9]+"), b"0")]

    def words_in(t):
        return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)), re.findall(r"[^\x20\x09-\x0D]+", t or "")

    def hashed(raw):
        a = np.frombuffer(raw, np.uint8)
        return int(text.range_hashes(a, np.array([0]), np.array([len(a)]))[0])

    def count(t):
        low, cased = words_in(t)
        found = {}
        for w in low:
            d = quality.SHAPES + hashed(w.encode()) % (quality.DIMS - quality.SHAPES)
            found[d] = found.get(d, 0) + 1
        for w in cased:
            raw = w.encode()
            for pattern, letter in collapse:
                raw = pattern.sub(letter, raw)
            d = quality.PATTERNS + hashed(raw) % (quality.SHAPES - quality.PATTERNS)
            found[d] = found.get(d, 0) + 1
        for i in range(len(low) - 3):
            four = low[i : i + 4]
            d = sum(four.index(w) * 4 ** (3 - j) for j, w in enumerate(four))
            found[d] = found.get(d, 0) + 1
        return found

    sample = [(q, count(t)) for q, t in labels_]
    idf = np.log((1 + len(sample)) / (1 + np.array([sum(d in c for _, c in sample) for d in range(quality.DIMS)]))) + 1

    def vector(c):
        x = np.zeros(quality.DIMS)
        for d, n in c.items():
            x[d] = np.log1p(n) * idf[d]
        for a, b in ((0, 64), (64, 2048), (2048, 8192)):
            x[a:b] /= max(np.linalg.norm(x[a:b]), 1e-9)
        return x

    x = np.stack([vector(c) for _, c in sample])
    _, _, directions = np.linalg.svd(x, full_matrices=False)
    project = lambda m: (y := m @ directions[:rank].T) / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-9)
    like = np.rint(project(np.stack([vector(count(t)) for t in docs_])) @ project(x).T * 2**20)
    votes = np.array([q for q, _ in sample])
    out = []
    for row in like:
        near = np.argsort(-row, kind="stable")[:k]
        w = np.maximum(row[near], 0)
        out.append((w * votes[near]).sum() / w.sum() if w.sum() else votes.mean())
    return out


def test_quality_against_brute_force(spark):
    rng = random.Random(31)
    data = []
    for i in range(240):
        w = words_of(rng, rng.randrange(2, 40), 60)
        data.append((i, " ".join(w if i % 3 else [x if i % 2 else x.upper() + "!" for x in w for _ in range(3)])))
    data += [(300, ""), (301, None), (302, "Ü é!! 12ab")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(200)], "doc_id long, quality int")
    model = quality.fit(docs, marks, rank=12, k=7)
    got = {r["doc_id"]: r["score"] for r in quality.score_quality(spark, docs, model).collect()}
    allowed = {r["doc_id"] for r in marks.filter("crc32(cast(doc_id AS string)) % 3 <> 1").collect()}
    expected = scores_by_hand([t for _, t in data], [(int(i % 3 > 0), t) for i, t in data if i in allowed], 7, 12)
    close = [abs(got[i] - e) < 1e-3 for (i, _), e in zip(data, expected, strict=True)]
    assert sum(close) >= len(close) - 2  # a rounding step may swap a neighbour


@pytest.mark.parametrize("block", [None, 300])
def test_quality_learns_from_all_labelled_rows(spark, tmp_path, monkeypatch, block):
    import corpus_pipeline

    if block:
        monkeypatch.setattr(quality, "ROWS", block)
    rng = random.Random(32)
    data = []
    for i in range(1500):
        w = words_of(rng, rng.randrange(2, 30), 60)
        data.append((i, " ".join(w if i % 10 else [x.upper() + "!" for x in w])))
    data += [(2000, ""), (2001, None), (2002, "Ü é!! 12ab")]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    marks = spark.createDataFrame([(i, int(i % 10 > 0)) for i in range(1500)], "doc_id long, quality int")
    allowed = {r["doc_id"] for r in marks.filter("crc32(cast(doc_id AS string)) % 3 <> 1").collect()}
    assert sum(i % 10 > 0 for i in allowed) > 800
    model = quality.fit(docs, marks, rank=12, k=7)
    assert abs(model.idf.max() - np.log(1 + len(allowed)) - 1) < 1e-9  # a feature that no labelled row holds
    got = {r["doc_id"]: r["score"] for r in quality.score_quality(spark, extra(docs), model).collect()}
    expected = scores_by_hand([t for _, t in data], [(int(i % 10 > 0), t) for i, t in data if i in allowed], 7, 12)
    close = [abs(got[i] - e) < 1e-3 for (i, _), e in zip(data, expected, strict=True)]
    assert len(got) == len(data) and model.n == len(allowed) and sum(close) >= len(close) - 6  # a rounding step may swap a neighbour
    marks.write.parquet(f"{tmp_path}/labels.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.quality(spark, docs, str(tmp_path)).collect()}
    assert {i for i in range(1500) if i % 10} == kept - {2000, 2001, 2002}


def test_nearest_rows_are_those_of_all_blocks():
    rng = np.random.default_rng(3)
    unit, vectors = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (rng.normal(size=(600, 8)).astype(np.float32), rng.normal(size=(5000, 8)).astype(np.float32)))
    vectors[4000:4100] = vectors[:100]  # equals: the earlier rows stay
    votes = rng.integers(0, 2, 5000)
    near = np.full((600, 7), quality._NONE)
    for first in range(0, 5000, 2300):
        quality.nearer(near, unit, vectors[first : first + 2300], votes[first : first + 2300], first)
    like = np.rint((unit @ vectors.T) * quality.GRAIN).astype(np.int64)
    for i, keys in enumerate(near):
        keys = np.sort(keys)[::-1]
        at = (1 << quality._PLACE) - 1 - ((keys >> 1) & ((1 << quality._PLACE) - 1))
        best = np.argsort(-like[i], kind="stable")[:7]
        assert np.abs(like[i][at] - like[i][best]).max() <= 1 and (keys & 1).tolist() == votes[at].tolist() and len(set(at)) == 7
        assert not set(at) & set(range(4000, 4100)) or all(a - 4000 in at for a in at if 4000 <= a < 4100)


def test_only_texts_that_bounds_leave_open_meet_all_labelled_rows(spark, monkeypatch):
    rng = random.Random(33)

    def data(n, mixed):
        out = []
        for i in range(n):
            w = words_of(rng, rng.randrange(2, 30), 60)
            loud = [x.upper() + "!" for x in w]
            out.append((i, " ".join(loud[: len(w) // 2] + w[len(w) // 2 :] if i < mixed else w if i % 4 else loud)))
        return [*out, (2000, ""), (2001, None), (2002, out[0][1])]

    met = []

    def compare(held, k, real=quality._compare):
        met.append(held.value[1].shape[0])
        return real(held, k)

    monkeypatch.setattr(quality, "_compare", compare)
    for mixed in (0, 120):
        docs = spark.createDataFrame(data(1200, mixed), "doc_id long, text string").repartition(3)
        marks = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(1200)], "doc_id long, quality int")
        model = quality.fit(docs, marks, rank=12, k=7)
        whole = {r["doc_id"]: r["score"] for r in quality.score_quality(spark, docs, model).collect()}  # all labelled rows at once
        assert 800 <= model.n <= quality.ROWS and not met
        monkeypatch.setattr(quality, "ROWS", 300)
        passes = {r["doc_id"]: r["score"] for r in quality.score_quality(spark, docs, model).collect()}
        assert sum(met) == (model.n if mixed else 0)  # the passes hold every labelled row once, or are not needed
        monkeypatch.setattr(quality, "ROWS", 1 << 13)
        met.clear()
        off = [d for d in whole if abs(whole[d] - passes[d]) > 1e-3]
        assert passes.keys() == whole.keys() and len(off) <= 4, off  # a rounding step may swap a neighbour


def test_bounds_settle_only_what_all_labelled_rows_say():
    rng = np.random.default_rng(4)

    def near(centre, n, noise):
        x = (centre + noise * rng.normal(size=(n, 6))).astype(np.float32)
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    a, b = np.eye(6)[0], np.eye(6)[1]
    good, bad = np.concatenate([near(a, 900, 0.1), near(b, 5, 0.01)]), np.concatenate([near(b, 300, 0.1), np.zeros((3, 6), np.float32), near(a + b, 20, 0.1)])
    bounds = quality.Bounds([bad[:100], good[:100]], 15)  # the guides see neither the good rows at b nor the bad ones between
    for label, rows in ((0, bad), (1, good)):
        rows = rows[np.linalg.norm(rows, axis=1) > 0]
        np.minimum.at(bounds.least[label], *bounds.cells(rows, label))
    texts = np.concatenate([near(a, 200, 0.1), near(b, 200, 0.1), near(a + b, 200, 0.2), near(-a, 20, 0.1), np.zeros((2, 6), np.float32)])
    votes = np.repeat([0, 1], [len(bad), len(good)])
    best = np.argsort(-(texts @ np.concatenate([bad, good]).T), axis=1)[:, :15]
    share, found = votes[best].mean(axis=1), bounds.settle(texts)
    told = ~np.isnan(found)
    assert (found[told] == share[told]).all() and told[:200].mean() > 0.9 and not told[-2:].any()
    for label, rows in ((0, bad), (1, good)):  # no row of a label is nearer than the bound
        assert ((texts @ rows.T).max(axis=1) <= np.maximum(bounds.most(texts @ bounds.centres[label].T, label), 0) + 1e-3).all()


# 10 ------------------------------------------------------------------------------------------------------------------
def groups(docs_):
    sets = {}
    for d, t in docs_:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[d] = {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 90 * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return sorted((d, len(sets[d]), root(d)) for d in ids)


def near_copies(seed, n=80):
    """A chain of edits, so that links are not transitive, and sizes around every boundary."""
    rng = random.Random(seed)
    out = []
    for size in (6, 11, 13, 22, 40, 90, 260):
        w = words_of(rng, size)
        for _ in range(n // 7):
            if rng.random() < 0.7:
                w = list(w)
                w[rng.randrange(len(w))] = rng.choice(words_of(rng, 3))
            else:
                w = [*w, *words_of(rng, 1)]
            out.append(" ".join(w))
    return [(i, t) for i, t in enumerate(out)]


@pytest.mark.parametrize("limit", [None, 0, 10**6])
def test_jaccard(spark, docs, monkeypatch, limit):
    if limit is not None:  # all heavy, all light
        monkeypatch.setattr(jaccard, "boundary", lambda *a: min(limit, 60))
    data = [*DOCS, *((1000 + i, t) for i, t in near_copies(1))]
    frame = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    assert rows(jaccard.jaccard_groups(spark, extra(frame)), "doc_id", "n_shingles", "component_id") == groups(data)


def test_jaccard_without_documents_and_with_repeats(spark, docs):
    assert jaccard.jaccard_groups(spark, docs.limit(0)).count() == 0
    odd = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (2, "a B c d"), (3, None), (None, "a b c d"), (4, ""), (5, "q r s"), (5, "t u v"), (6, "t u v")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_groups(spark, odd).collect()), key=str)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3), (None, 2, None), (4, 0, 4), (5, 1, 5), (5, 1, 5), (6, 1, 5)], key=str)


def test_boundary_is_the_cheapest():
    sizes = [(s, 100) for s in range(9, 200)]
    cost = lambda b: sum(c * ((s - -(-9 * s // 10) + 2) * (s - -(-9 * s // 10) + 1) / 2 if s <= b else (s - -(-9 * s // 10) + 1) * (1 + jaccard.PAIR_COST * 0.5)) for s, c in sizes)
    assert cost(jaccard.boundary(sizes, 1.5, 90, 100)) == min(cost(b) for b in [0, *(s for s, _ in sizes)])
