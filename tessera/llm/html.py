"""HTML extraction by nearest-URL page differencing.

A page is cut into text lines (blocks of text between block-level tags). Pages of one host are sorted by URL path, and
each page is aligned, by longest common subsequence of lines, with up to PARTNERS pages of the nearest other paths. A
place that the alignments share with more than half of its partners is template, not content: it is deleted. One
partner that reposts the article so deletes nothing of it.

Names only decide what the alignment leaves open. A line that is not shared goes if it stands in an element that is
named as no content (menus, adverts, comments and the like, by element, role or class), since such text may differ on every page. A
shared line stays if it stands in an article element (or main, where there is no article) that has lines of its own, as
pages of one host may rightly share a line of their articles. A page without partners is its article alone, or all lines that
are not named as no content.

Neighbours are found without gathering a host: the places are sorted by (host, path) in range partitions, numbered through
and cut into blocks of a fixed number, each with the few places before and behind it; a task streams over its blocks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.store import Store, prepare

BLOCKS = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header"
    " hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements whose text is never shown as text.
DROPPED = frozenset("head script style template noscript button select option textarea input iframe svg math object canvas audio video".split())
#: Elements that are named as no content.
ASIDE = frozenset("nav header footer aside form dialog menu search".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = BLOCKS - {"br", "option", "optgroup"}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of a class or id that mark what is not the article.
MARKS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer gdpr header masthead menu nav navbar navigation newsletter notice"
    " notices popup promo promoted promotion related replies reply respond share sharing sidebar social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
#: Of these, the words that inside an article mark a part of it.
INNER = frozenset(("header", "masthead", "banner"))
#: How surely an element holds the article.
LEVEL = {"article": 2, "main": 1}
#: Cells of an alignment table (16 MB); larger alignments are halved.
CELLS = 4_000_000
PARTNERS = 4  # pages that a page is aligned with
REACH = 4  # places before and behind in the order of paths that they are taken from
BLOCK = 512  # places of a block, REACH at least
SPACE = re.compile(r"\s+")
_WORDS = re.compile(r"[a-z0-9]+")


class _Lines(HTMLParser):
    """(mark, text) of each block of text, in page order. A mark is holder * 8 + level * 2 + named.

    The holder is the number of the outermost article (level 2) or main (level 1) element the line is in, and 0 if there
    is none (level 0); named is 1 in an element named as no content.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[int, str]] = []
        self.parts: list[str] = []
        self.open: list[tuple[str, bool, int]] = []  # tag, dropped from here on, mark from here on
        self.holders = 0

    def _break(self):
        if self.parts:
            text = SPACE.sub(" ", "".join(self.parts)).strip()
            self.parts = []
            if text:
                self.lines.append((self.open[-1][2] if self.open else 0, text))

    def _named(self, tag: str, attrs: dict[str, str | None], level: int) -> bool:
        if tag in ASIDE and not (tag == "header" and level):
            return True
        if tag in ("html", "body", "main"):
            return False
        if (attrs.get("role") or "").lower() in ROLES:
            return True
        marks_here = MARKS - INNER if level or tag in LEVEL else MARKS
        return any(not marks_here.isdisjoint(_WORDS.findall((attrs.get(a) or "").lower())) for a in ("class", "id"))

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self._break()
        if tag in CLOSES_P and any(t == "p" for t, _, _ in self.open):
            self._close("p")
        if tag in ("li", "dt", "dd", "tr", "td", "th", "option") and self.open and self.open[-1][0] == tag:
            self.open.pop()
        if tag in VOID:
            return
        _, dropped, mark = self.open[-1] if self.open else ("", False, 0)
        if attrs or tag in ASIDE or tag in DROPPED or tag in LEVEL:
            own = dict(attrs)
            hidden = "hidden" in own or (own.get("aria-hidden") or "").lower() == "true"
            dropped = dropped or tag in DROPPED or (hidden and tag not in ("html", "body", "main"))
            level = mark >> 1 & 3
            named = mark & 1 or self._named(tag, own, level)
            if LEVEL.get(tag, 0) > level:
                self.holders += 1
                mark = self.holders * 8 + LEVEL[tag] * 2
            mark = mark & ~1 | int(named)
        self.open.append((tag, dropped, mark))

    def _close(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                self._break()
                if tag == "p":  # formatting left open goes on, as browsers have it
                    del self.open[i]
                else:
                    del self.open[i:]
                return
            if self.open[i][0] in BLOCKS and tag not in BLOCKS:
                return

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self._break()
        self._close(tag)

    def handle_data(self, data):
        if not (self.open and self.open[-1][1]):
            self.parts.append(data)


def page_lines(html: str | None) -> list[tuple[int, str]]:
    """The text lines of a page outside of dropped elements, each with its mark."""
    parser = _Lines()
    parser.feed(html or "")
    parser.close()
    parser._break()
    return parser.lines


def _lengths(a: list[int], b: np.ndarray) -> np.ndarray:
    """Lengths of longest common subsequences of a with every prefix of b, by bit-parallel rows (a bit for each of b's lines)."""
    full = row = (1 << len(b)) - 1  # bit j is 0 where the length grows with b[j]
    for x in a:
        hit = row & int.from_bytes(np.packbits(b == np.int64(x), bitorder="little").tobytes(), "little")
        row = ((row + hit) | (row - hit)) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(-(-len(b) // 8), "little"), np.uint8), count=len(b), bitorder="little")
    return np.concatenate([[0], np.cumsum(1 - bits, dtype=np.int64)])


def _matched(a: list[int], b: np.ndarray) -> list[int]:
    """Places in a of a longest common subsequence with b; what has more than CELLS cells is halved (Hirschberg), so memory is linear."""
    if len(a) > 1 and len(a) * len(b) > CELLS:
        half = len(a) // 2
        at = int(np.argmax(_lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]))
        return _matched(a[:half], b[:at]) + [half + i for i in _matched(a[half:], b[at:])]
    table = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    for i in range(len(a) - 1, -1, -1):
        diagonal = table[i + 1, 1:] + (b == np.int64(a[i]))
        table[i, :-1] = np.maximum.accumulate(np.maximum(diagonal, table[i + 1, :-1])[::-1])[::-1]
    i = j = 0
    found = []
    while i < len(a) and j < len(b):
        if b[j] == np.int64(a[i]) and table[i, j] == table[i + 1, j + 1] + 1:
            found.append(i)
            i, j = i + 1, j + 1
        elif table[i + 1, j] >= table[i, j + 1]:
            i += 1
        else:
            j += 1
    return found


def shared(own: list[int], other: list[int]) -> set[int]:
    """Places of own's lines that a longest common subsequence with other holds, exact for pages of every length.

    Common ends belong to some longest common subsequence; between them it is sought over the lines that both sides have.
    """
    lo, n, m = 0, len(own), len(other)
    found = set()
    while lo < n and lo < m and own[lo] == other[lo]:
        found.add(lo)
        lo += 1
    while n > lo and m > lo and own[n - 1] == other[m - 1]:
        n, m = n - 1, m - 1
        found.add(n)
    common = set(own[lo:n]) & set(other[lo:m])
    a = [i for i in range(lo, n) if own[i] in common]
    b = np.array([x for x in other[lo:m] if x in common], np.int64)
    return found | {a[i] for i in _matched([own[i] for i in a], b)}


def _signed(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def partners(path: str, lines: list[int], before: list[tuple[str, list[int]]], after: list[tuple[str, list[int]]]) -> list[list[int]]:
    """Lines of up to PARTNERS of the places (path, lines) before and after a place, both nearest first.

    Those that share the longer start of the path come first, on a tie the one fewer places away, then the one before.
    Copies tell nothing: places of equal lines are left out, and those of which nine in ten lines are equal come last.
    """
    own = set(lines)
    found = []
    for side, places in enumerate((before, after)):
        for step, (other, theirs) in enumerate(places):
            if theirs != lines:
                common = next((i for i, (a, b) in enumerate(zip(path, other, strict=False)) if a != b), min(len(path), len(other)))
                them = set(theirs)
                found.append((10 * len(own & them) >= 9 * max(len(own), len(them)), -common, step, side, theirs))
    return [f[-1] for f in sorted(found, key=lambda f: f[:4])[:PARTNERS]]


def kept_lines(marks: list[int], votes: list[int], asked: int) -> list[int]:
    """Places of the lines that are content: marks of the lines, in how many of the asked alignments each is shared."""
    plain = [i for i, m in enumerate(marks) if not m & 1]
    surest = max((marks[i] >> 1 & 3 for i in plain), default=0)
    own = {i for i in plain if 2 * votes[i] <= asked}
    if not asked or not own:
        return [i for i in plain if marks[i] >> 1 & 3 == surest]
    held = [i for i in plain if surest and marks[i] >> 1 & 3 == surest]
    sure = {marks[i] for i in held if i in own} or {marks[i] for i in held}
    return [i for i in plain if i in own or marks[i] in sure]


def votes_of(own: list[int], others: list[list[int]]) -> list[int]:
    """In how many of the alignments with others each line of own is shared."""
    votes = [0] * len(own)
    for other in others:
        for i in shared(own, other):
            votes[i] += 1
    return votes


def main_text(html: str | None, others: list[list[int]] = ()) -> str:
    """The content of a page that is aligned with the line digests of others."""
    lines = page_lines(html)
    votes = votes_of([_signed(t) for _, t in lines], others)
    return "\n".join(lines[i][1] for i in kept_lines([m for m, _ in lines], votes, len(others)))


def _squeeze(lines: list[tuple[int, str]]) -> bytes:
    """Length of what follows, compressed: the marks, then the texts, a line each (white space in them is single spaces)."""
    raw = np.array([m for m, _ in lines], np.int32).tobytes() + "\n".join(t for _, t in lines).encode()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unsqueeze(data: bytes, n: int) -> tuple[list[int], list[str]]:
    raw = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)
    return np.frombuffer(raw, np.int32, n).tolist(), raw[4 * n :].decode().split("\n") if n else []


def _parse(whole: bool):
    """Pages to the digests of their lines, and if whole to the lines themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = [page_lines(h) for h in batch.column("html").to_pylist()]
            columns = {c: batch.column(c) for c in (("page_id", "url") if whole else ("page_id",)) + ("host", "path")}
            columns["lines"] = pa.array([[_signed(t) for _, t in lines] for lines in pages], pa.list_(pa.int64()))
            if whole:
                columns["page"] = pa.array([_squeeze([(m, "" if m & 1 else t) for m, t in lines]) for lines in pages], pa.binary())
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _meet(size: int):
    """Sorted rows (block, at, host, path, lines, more) to (host, path, lines, votes, asked, others); the places of one block are held at once.

    lines and others, which only pages that differ from the place's own lines need, are there only where there are more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.string(), pa.list_(pa.int64()), pa.binary(), pa.int32(), pa.list_(pa.list_(pa.int64())))
        for block, rows in groupby(_rows(batches), key=lambda r: r[0]):
            rows = list(rows)
            out = []
            for i, (_, at, host, path, lines, more) in enumerate(rows):
                if at // size == block:
                    near = [[(r[3], r[4]) for r in part if r[2] == host] for part in (rows[max(0, i - REACH) : i][::-1], rows[i + 1 : i + 1 + REACH])]
                    if others := partners(path, lines, *near):
                        out.append((host, path, lines if more else None, bytes(votes_of(lines, others)), len(others), others if more else None))
            for lo in range(0, len(out), 64):
                columns = zip(*out[lo : lo + 64], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["host", "path", "first", "votes", "asked", "others"])

    return run


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    columns = ("lines", "page", "first", "votes", "asked", "others")
    for batch in batches:
        texts = []
        for own, page, first, votes, asked, others in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
            marks, lines = _unsqueeze(page, len(own))
            if others is not None and first != own:
                votes = votes_of(own, others)
            texts.append("\n".join(lines[i] for i in kept_lines(marks, votes or [0] * len(own), asked or 0)))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def alignments(spark: SparkSession, pages: DataFrame, store: Store) -> DataFrame:
    """(host, path, first, votes, asked, others) of each place with partners: how often each of its lines is shared with them."""
    places = pages.filter("size(lines) > 0").groupBy("host", "path").agg(
        F.min_by("lines", F.struct("page_id", F.xxhash64("lines"))).alias("lines"), (F.min(F.xxhash64("lines")) < F.max(F.xxhash64("lines"))).alias("more")
    )
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = places.repartitionByRange(parts, "host", "path").sortWithinPartitions("host", "path").withColumn("_id", F.monotonically_increasing_id())
    placed = store.put("places", placed.select("*", F.shiftright("_id", 33).alias("_part"), F.col("_id").bitwiseAND((1 << 33) - 1).alias("_row")))
    total, offsets = 0, []
    for r in placed.groupBy("_part").agg(F.count("*").alias("c")).orderBy("_part").collect():  # a row for each partition
        offsets.append((r["_part"], total))
        total += r["c"]
    starts = F.broadcast(spark.createDataFrame(offsets, "_part long, _start long"))
    ranked = placed.join(starts, "_part").select((F.col("_start") + F.col("_row")).alias("at"), "host", "path", "lines", "more")
    blocks = F.expr(f"array_distinct(array((at - {REACH}) div {BLOCK}, at div {BLOCK}, (at + {REACH}) div {BLOCK}))")
    dealt = ranked.select(F.explode(blocks).alias("block"), "at", "host", "path", "lines", "more").repartition("block").sortWithinPartitions("block", "at")
    return dealt.mapInArrow(_meet(BLOCK), "host string, path string, first array<long>, votes binary, asked int, others array<array<long>>")


def extract_text(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Return page_id, url, text for every row of pages (page_id, url, html, any others).

    A null or empty html has an empty text. A page without url belongs to the host "" and path "". Pages of one host and
    path are one place: each is aligned with the partners of the place, none with another page of it, and the page of the
    smallest page_id with lines stands for it to other places. Pages of any length are aligned whole. Repeated rows
    get equal texts. Where several longest common subsequences exist, the places of the first are taken.
    """
    prepare(spark)
    store = Store(spark, "html")
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*", ""), r"(\.html?|/)$", "")
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host.alias("host"), path.alias("path"))
    digests = store.put("digests", pages.mapInArrow(_parse(False), "page_id long, host string, path string, lines array<long>"))
    cut = pages.mapInArrow(_parse(True), "page_id long, url string, host string, path string, lines array<long>, page binary")
    met = cut.join(alignments(spark, digests, store), ["host", "path"], "left").drop("host", "path")
    return met.mapInArrow(_decide, "page_id long, url string, text string")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_text(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
