"""Secret scans: base patterns, and character Markov models of random strings against ordinary identifiers.

First-order character models over the token alphabet are trained from labelled samples: one of random strings for each
usual alphabet (seeded strings), one of the values that the base patterns capture, and one of ordinary tokens. The ordinary one counts the
transitions of all other tokens of all documents, and of the identifiers that programs make of such words (snake, kebab, camel and
upper case, numbered), which follow from the counts of words' starts, first pairs, transitions and ends; a second ordinary one is of the
names in Python's own library, which no corpus need hold. A token of LEAST or more characters is a secret
where its log-likelihood ratio, random against ordinary (each the mean of its models' likelihoods), reaches a threshold. That is fitted on held-out labelled
tokens: the least at which at most FALSE of the identifiers made of the short words (too short to be judged) of all
documents pass, and LOWEST at least.
Spans that the base patterns find always stay; tokens that overlap them are not told twice.
"""

from __future__ import annotations

import importlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import text as tx
from tessera.llm.store import prepare

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "random")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]+")
LEAST = 12  # characters of a token that is judged
FALSE = 1e-4  # share of held-out ordinary tokens that may pass
LOWEST = 8.0  # nats, where the held-out tokens allow less
MASK = "<SECRET>"
_A = len(ALPHABET)
_CODE = np.full(256, _A, np.int64)
_CODE[[ord(c) for c in ALPHABET]] = np.arange(_A)
_TOKENS = tx.Words(bytes(b for b in range(256) if chr(b) not in ALPHABET), lower=False)
_NUMBERS = [str(i) for i in range(10000)]
_MADE = np.frombuffer(("_-/" + "".join(_NUMBERS)).encode(), np.uint8)  # what identifiers hold beside words
_NUMBER_SIZES = np.array([len(x) for x in _NUMBERS])
_NUMBER_STARTS = 3 + np.cumsum(_NUMBER_SIZES) - _NUMBER_SIZES
_RAISED, _LOWERED = (np.frombuffer(turn(bytes(range(256))), np.uint8) for turn in (bytes.upper, bytes.lower))
_UPPER, _LOWER, _DIGITS = (np.array([ALPHABET.index(c) for c in part]) for part in (ALPHABET[:26], ALPHABET[26:52], ALPHABET[52:62]))
#: Alphabets of random strings: hex, letters of one or both cases, these with digits, base64 and its other form.
KINDS_OF_RANDOM = ("0123456789abcdef", "0123456789ABCDEF", ALPHABET[26:52], ALPHABET[:26], ALPHABET[:52], ALPHABET[26:62], ALPHABET[:26] + ALPHABET[52:62], ALPHABET[:62], ALPHABET[:64], ALPHABET[:62] + "_-")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, by start, then kind; leftmost and non-overlapping for each kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(found)


def count_pairs(tokens: list[str]) -> np.ndarray:
    """Transitions of all tokens; row _A is the start."""
    codes = _CODE[np.frombuffer(("~" + "~".join(tokens)).encode("ascii"), np.uint8)]  # a mark that is no token character
    before, after = codes[:-1], codes[1:]
    inside = after < _A
    return np.bincount(before[inside] * _A + after[inside], minlength=(_A + 1) * _A).reshape(_A + 1, _A)


def random_strings(alphabet: str, n: int, seed: int, least: int = LEAST, most: int = 48) -> list[str]:
    """Labelled random strings of an alphabet."""
    rng = np.random.default_rng(seed)
    return ["".join(alphabet[i] for i in rng.integers(0, len(alphabet), int(rng.integers(least, most)))) for _ in range(n)]


def _suspects(buf: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rows that may hold a base span: a token of 20 or more bytes, or a separator after which a value may stand."""
    out = np.zeros(len(offsets) - 1, bool)
    for at in (starts[ends - starts >= 20], np.flatnonzero((buf == 58) | (buf == 61))):
        out[np.searchsorted(offsets, at, side="right") - 1] = True
    return np.flatnonzero(out)


def _byte_places(text: str, places: np.ndarray) -> np.ndarray:
    """Byte offsets of code points."""
    if text.isascii():
        return places
    heads = np.flatnonzero((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80)
    return np.append(heads, len(text.encode()))[places]


def _tokens(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, offsets, starts of tokens, their ends, whether each is clear of base spans) of slices of a column."""
    for lo, _, buf, offsets in tx.slices(column):
        _, starts, ends, _ = tx.words(buf, offsets, _TOKENS)
        keep = np.ones(len(starts), bool)
        for row in _suspects(buf, offsets, starts, ends):
            text = column[lo + row].as_py()
            if spans := base_spans(text):
                a, b = (offsets[row] + _byte_places(text, np.array(x)) for x in zip(*((a, b) for a, _, b in spans), strict=True))
                for i, j in zip(np.searchsorted(ends, a, side="right"), np.searchsorted(starts, b), strict=True):
                    keep[i:j] = False
        yield buf, offsets, starts, ends, keep


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row: transitions of captured values, and transitions, first pairs and ends of all other tokens."""
    captured, plain = np.zeros((_A + 1, _A), np.int64), np.zeros((_A + 1, _A), np.int64)
    first, last = np.zeros((_A, _A), np.int64), np.zeros(_A, np.int64)
    for batch in batches:
        for buf, _, starts, ends, keep in _tokens(batch.column("text")):
            codes = _CODE[buf]
            taken = [buf[a:b].tobytes().decode() for a, b in zip(starts[~keep], ends[~keep], strict=True) if b - a >= LEAST]
            captured += count_pairs(taken)
            starts, ends = starts[keep], ends[keep]
            edge = np.zeros(len(buf) + 1, np.int8)
            edge[starts] += 1
            edge[ends] -= 1
            inside = np.cumsum(edge[:-1], dtype=np.int8) > 0  # a token that follows another directly begins a text
            inside[starts] = False  # from here on: has one before it
            at = np.flatnonzero(inside)
            plain[:_A] += np.bincount(codes[at - 1] * _A + codes[at], minlength=_A * _A).reshape(_A, _A)
            plain[_A] += np.bincount(codes[starts], minlength=_A)
            two = starts[ends - starts > 1]
            first += np.bincount(codes[two] * _A + codes[two + 1], minlength=_A * _A).reshape(_A, _A)
            last += np.bincount(codes[ends - 1], minlength=_A)
    yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([x.ravel() for x in (captured, plain, first, last)])], pa.list_(pa.int64()))], ["counts"])


def ordinary_counts(plain: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Transitions of words and of the identifiers made of them, from those of the words."""
    inner, start = plain[:_A].astype(np.float64), plain[_A].astype(np.float64)
    upper = np.arange(_A)
    upper[_LOWER] = _UPPER
    raised = np.zeros((_A, _A))
    np.add.at(raised, (upper[:, None], upper[None, :]), inner)
    begin, end, lead = np.zeros(_A), np.zeros(_A), np.zeros((_A, _A))
    np.add.at(begin, upper, start)
    np.add.at(end, upper, last)
    np.add.at(lead, upper, first)
    every = max(start.sum(), 1.0)
    out = np.zeros((_A + 1, _A))
    out[:_A] += 4 * inner + raised + (inner - first) + lead  # as it stands, with a separator, before a hump, in upper case; behind a hump
    out[_A] += 3 * start + begin
    for mark in "_-/":
        out[:_A, ALPHABET.index(mark)] += (last + end) / 3
        out[ALPHABET.index(mark)] += (start + begin) / 3
    out[:_A] += last[:, None] * begin / every  # humps
    out[:_A, _DIGITS] += (last + end)[:, None] / 20
    out[_DIGITS[:, None], _DIGITS] += every / 100
    return out


def program_names() -> list[str]:
    """Labelled ordinary identifiers that need no corpus: public names of Python's own library, and those of several words with humps."""
    modules = "argparse asyncio builtins collections csv datetime decimal email http.client inspect io json locale logging os pathlib random re shutil socket sqlite3 ssl string subprocess sys tarfile tempfile threading time types unittest urllib.parse uuid zipfile"
    found = set()
    for module in map(importlib.import_module, modules.split()):
        for name in dir(module):
            found.add(name)
            found.update(dir(getattr(module, name)) if isinstance(getattr(module, name), type) else ())
    names = sorted(n for n in found if n.isascii() and not n.startswith("_"))
    humps = [first + "".join(w.capitalize() for w in rest) for first, *rest in (n.lower().split("_") for n in names) if rest]
    return names + humps


def likelihoods(counts: np.ndarray) -> np.ndarray:
    """Log probabilities of transitions; a fiftieth of each row is spread over all characters, so that no rare one decides alone."""
    share = (counts + 1e-9) / (counts + 1e-9).sum(axis=-1, keepdims=True)
    return np.log(0.98 * share + 0.02 / _A)


def _sums(table: np.ndarray, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of a table's entries over the transitions of each token (never empty)."""
    sizes = ends - starts
    head = np.cumsum(sizes) - sizes
    at = np.arange(int(sizes.sum())) + np.repeat(starts - head, sizes)
    before = codes[at - 1]
    before[head] = _A
    return np.add.reduceat(table.ravel()[before * _A + codes[at]], head)


class Model:
    """Log probabilities of transitions in each kind of random string, then in words and in program names, and the threshold."""

    def __init__(self, captured: np.ndarray, ordinary: np.ndarray, threshold: float = 0.0):
        randoms = [count_pairs(random_strings(alphabet, 1500, 7 + i)) for i, alphabet in enumerate(KINDS_OF_RANDOM)]
        if captured[_A].sum() >= 100:
            randoms.append(captured)
        self.tables = np.stack([likelihoods(c) for c in (*randoms, ordinary, count_pairs(program_names()))])
        self.reach = self.tables[:-2].max(axis=0) - self.tables[-2]  # summed, and log 2 more: no ratio is above it
        self.threshold = threshold

    def judge(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Log-likelihood ratio of each token buf[start:end], random against ordinary, each the mean of its models."""
        if not len(starts):
            return np.zeros(0)
        codes = _CODE[buf]
        each = np.stack([_sums(t, codes, starts, ends) for t in self.tables])
        mean = lambda x: x.max(axis=0) + np.log(np.exp(x - x.max(axis=0)).mean(axis=0))
        return mean(each[:-2]) - mean(each[-2:])

    def ratio(self, tokens: list[str]) -> np.ndarray:
        sizes = np.array([len(t) for t in tokens], np.int64)
        ends = np.cumsum(sizes + 1) - 1
        return self.judge(np.frombuffer("~".join(tokens).encode("ascii"), np.uint8), ends - sizes, ends)


def identifiers(buf: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Held-out ordinary tokens (bytes, starts, ends): identifiers of LEAST or more characters, of two or three of the words each, that follow in a text."""
    row, first = np.searchsorted(offsets, starts, side="right") - 1, np.searchsorted(starts, offsets)
    at = np.flatnonzero(row[:-2] == row[2:])
    i, sizes, n = at - first[row[at]], ends - starts, len(buf)
    source = np.concatenate([buf, _RAISED[buf], _LOWERED[buf], _MADE])
    places, lengths = np.zeros((len(at), 6), np.int64), np.zeros((len(at), 6), np.int64)
    for form in range(4):
        of = np.flatnonzero(i // 3 % 4 == form)
        a, b, c = ((starts[at[of] + k], sizes[at[of] + k]) for k in range(3))
        mark = 3 * n + i[of] % 3, 1
        number = lambda most: (3 * n + _NUMBER_STARTS[i[of] % most], _NUMBER_SIZES[i[of] % most])  # noqa: B023, E731
        raised = lambda word: (n + word[0], word[1])
        hump = lambda word: ((n + word[0], 1), (2 * n + word[0] + 1, word[1] - 1))
        made = ((a, mark, b, mark, c), (a, *hump(b), *hump(c), number(100)), (raised(a), (3 * n, 1), raised(b)), (a, mark, b, number(10000)))[form]
        for j, (place, length) in enumerate(made):
            places[of, j], lengths[of, j] = place, length
    long = lengths.sum(axis=1) >= LEAST
    places, lengths = places[long].ravel(), lengths[long].ravel()
    ends = np.cumsum(lengths)
    out = source[np.arange(int(lengths.sum())) + np.repeat(places - ends + lengths, lengths)]
    ends = ends[5::6]
    return out, np.concatenate([[0], ends[:-1]])[: len(ends)], ends


def clear_of(spans: list[tuple[int, int, int]], others: list[tuple[int, int]]) -> list[bool]:
    """Whether each of others (start, end) overlaps none of the spans (sorted by start)."""
    if not spans:
        return [True] * len(others)
    reach = np.maximum.accumulate([b for _, _, b in spans])  # of the spans that start before its end, none ends behind its start
    before = np.searchsorted([a for a, _, _ in spans], [b for _, b in others])
    return [not k or bool(reach[k - 1] <= a) for (a, _), k in zip(others, before.tolist(), strict=True)]


def train(docs: DataFrame) -> Model:
    """Models of the transitions of all documents, and the threshold from the identifiers of all documents."""
    parts = docs.select("text").mapInArrow(_gather, "counts array<long>")
    total = parts.select(F.posexplode("counts").alias("i", "c")).groupBy("i").agg(F.sum("c").alias("c")).filter("c > 0")
    counts = np.zeros(2 * (_A + 1) * _A + _A * _A + _A, np.int64)
    for r in total.collect():  # a row for each counter
        counts[r["i"]] = r["c"]
    captured, plain, first, last = np.split(counts, np.cumsum([(_A + 1) * _A, (_A + 1) * _A, _A * _A]))
    model = Model(captured.reshape(_A + 1, _A), ordinary_counts(plain.reshape(_A + 1, _A), first.reshape(_A, _A), last))
    held = docs.select("text").mapInArrow(_held_out(docs.sparkSession.sparkContext.broadcast(model)), "ratio float, n long")
    told = held.groupBy("ratio").agg(F.sum("n").alias("n")).orderBy(F.desc("ratio")).collect()  # steps of a quarter, 801 at most
    allowed, passed = FALSE * sum(r["n"] for r in told), 0
    model.threshold = LOWEST
    for r in told:
        passed += r["n"]
        if passed > allowed:
            model.threshold = max(model.threshold, r["ratio"] + 0.25)
            break
    return model


def _held_out(held):
    """Ratios of the identifiers of all texts, in steps of a quarter, counted; those that are surely below LOWEST count as 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, found = held.value, np.zeros(801, np.int64)
        for batch in batches:
            for buf, offsets, starts, ends, clear in _tokens(batch.column("text")):
                short = clear & (ends - starts < LEAST)
                made, a, b = identifiers(buf, offsets, starts[short], ends[short])
                if len(a):
                    near = _sums(model.reach, _CODE[made], a, b) + np.log(2) >= LOWEST - 1e-6
                    steps = np.clip(np.floor(4 * model.judge(made, a[near], b[near])), 0, 800).astype(np.int64)
                    found += np.bincount(steps, minlength=801)
                    found[0] += len(a) - len(steps)
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array((some / 4).astype(np.float32)), pa.array(found[some])], ["ratio", "n"])

    return run


def _masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    out, last = [], 0
    for start, _, end in spans:
        if end > last:
            if start >= last:
                out += [text[last:start], MASK]
            last = end
    return "".join(out) + text[last:]


def _random_spans(model: Model, buf: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the tokens of a slice that are secrets, in code points of their text."""
    long = ends - starts >= LEAST
    starts, ends = starts[long], ends[long]
    hit = model.judge(buf, starts, ends) >= model.threshold
    starts, ends = starts[hit], ends[hit]
    row = np.searchsorted(offsets, starts, side="right") - 1
    if not len(row):
        return row, starts, ends
    heads = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    return row, heads[starts] - heads[offsets[row]], heads[ends] - heads[offsets[row]]


def _scan(held, mask: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))
        for batch in batches:
            names = batch.schema.names
            at = names.index("text")
            texts, found, added = batch.column(at), {}, {}
            for lo, _, buf, offsets in tx.slices(texts):
                _, starts, ends, _ = tx.words(buf, offsets, _TOKENS)
                for row in _suspects(buf, offsets, starts, ends):
                    if spans := base_spans(texts[lo + row].as_py()):
                        found[lo + int(row)] = spans
                for row, start, end in zip(*(x.tolist() for x in _random_spans(model, buf, offsets, starts, ends)), strict=True):
                    added.setdefault(lo + row, []).append((start, 3, end))
            for i, more in added.items():
                added[i] = [m for m, clear in zip(more, clear_of(found.get(i, []), [(a, b) for a, _, b in more]), strict=True) if clear]
            columns = list(batch.columns)
            told = lambda spans: [{"start": a, "kind": KINDS[k], "end": b} for a, k, b in spans]
            every = {i: sorted(found.get(i, []) + added.get(i, [])) for i in {*found, *added}}
            if mask and any(every.values()):
                columns[at] = pa.array([_masked(t.as_py(), every[i]) if every.get(i) else t.as_py() for i, t in enumerate(texts)], texts.type)
            spans = [pa.array([told(x.get(i, ())) for i in range(batch.num_rows)], kind) for x in (found, every)]
            yield pa.RecordBatch.from_arrays([*columns, *spans], [*names, "base_spans", "secret_spans"])

    return run


def scan_secrets(spark: SparkSession, docs: DataFrame, mask: bool = False) -> DataFrame:
    """Return every row and column of docs with base_spans and secret_spans (base and added), in code points.

    A null or empty text has no spans. Rows are judged alone, so repeated rows get equal results, and columns of docs named
    base_spans or secret_spans are replaced. An empty table has ordinary tokens of even odds and returns no rows. With mask
    every span of the text is replaced by MASK (overlapping spans by one); the spans are those of the text before.
    """
    prepare(spark)
    docs = docs.drop("base_spans", "secret_spans").withColumn("text", F.col("text").cast("string"))
    held = spark.sparkContext.broadcast(train(docs))  # 11 x 67 x 66 numbers
    span = "array<struct<start:int,kind:string,end:int>>"
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(_scan(held, mask), f"{fields}, base_spans {span}, secret_spans {span}")


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    told = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(told("base_spans").cast("binary"), 256).alias("base_sha256"),
        told("secret_spans").alias("spans"),
    )
