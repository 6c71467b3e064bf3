"""Token counts: a linear longest-match automaton over the bytes of a word-piece vocabulary.

The vocabulary is a trie. A node that is left for want of a child follows its failure link, and the tokens popped on the
way are counted, not built. Both are folded into one table: for each (state, byte) the next state and the number
of tokens popped, so a word costs one look-up a byte, whatever the vocabulary. Each byte is a piece (byte fallback), so
every word has a count and there is no unknown token.

Words are maximal runs without ASCII white space; each is read behind the word-start mark, as the vocabulary marks word
starts. Equal words of a slice are walked once, all words in step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import text as tx
from tessera.llm.store import prepare

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"  # where the session sets no spark.tessera.vocabulary
MARK = "▁".encode()
_STATE_BITS = 21  # states; the rest of 31 bits counts popped tokens


def pieces_of(path: str = VOCABULARY) -> list[bytes]:
    """The pieces of a vocabulary file, without control, unknown and byte pieces. Read on the driver, where path is."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    odd = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)
    return sorted({sp.id_to_piece(i).encode() for i in range(sp.get_piece_size()) if not odd(i)})


def vocabulary_of(spark: SparkSession) -> str:
    """The vocabulary file that the session names in spark.tessera.vocabulary, or VOCABULARY."""
    return spark.conf.get("spark.tessera.vocabulary", VOCABULARY)


class Automaton:
    """start: the state behind the mark; table[state, byte]: popped << _STATE_BITS | next; rest[state]: tokens at a word's end."""

    def __init__(self, pieces: list[bytes], mark: bytes = MARK):
        vocabulary = sorted({p for p in pieces if p} | {bytes([b]) for b in range(256)})
        sizes = np.array([len(p) for p in vocabulary])
        letters = np.zeros((len(vocabulary), int(sizes.max())), np.uint8)
        for i, piece in enumerate(vocabulary):
            letters[i, : len(piece)] = np.frombuffer(piece, np.uint8)
        # the nodes of each depth: parent and byte of each, and which are pieces
        node, levels, made = np.zeros(len(vocabulary), np.int64), [], 1
        for depth in range(letters.shape[1]):
            alive = np.flatnonzero(sizes > depth)
            edges, which = np.unique(node[alive] * 256 + letters[alive, depth], return_inverse=True)
            node[alive] = made + which
            final = np.zeros(len(edges), bool)
            final[node[alive[sizes[alive] == depth + 1]] - made] = True
            levels.append((np.arange(made, made + len(edges)), edges >> 8, edges & 255, final))
            made += len(edges)
        assert made < 1 << _STATE_BITS
        self.table, self.rest = np.zeros((made, 256), np.int32), np.zeros(made, np.int32)
        mask, fail, popped = (1 << _STATE_BITS) - 1, np.zeros(made, np.int64), np.zeros(made, np.int64)
        self.table[0, levels[0][2]] = levels[0][0]
        for k, (own, parent, byte, final) in enumerate(levels):
            # a piece pops itself; another node pops what its parent pops, and what the parent's link pops on the byte
            step = self.table[fail[parent], byte].astype(np.int64)
            fail[own] = np.where(final, 0, step & mask)
            popped[own] = np.where(final, 1, popped[parent] + (step >> _STATE_BITS))
            self.table[own] = self.table[fail[own]] + (popped[own] << _STATE_BITS)[:, None].astype(np.int32)
            self.rest[own] = popped[own] + self.rest[fail[own]]
            if k + 1 < len(levels):
                below, parents, bytes_, _ = levels[k + 1]
                self.table[parents, bytes_] = below
        self.start, self.before = 0, 0
        for b in mark:
            step = int(self.table[self.start, b])
            self.start, self.before = step & mask, self.before + (step >> _STATE_BITS)

    def lengths(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of each word buf[starts[i]:ends[i]], all words in step, longest first."""
        size = ends - starts
        order = np.argsort(-size, kind="stable")
        begin, sizes = starts[order], size[order]
        state = np.full(len(order), self.start, np.int64)
        count = np.full(len(order), self.before, np.int64)
        flat, mask, live, at = self.table.reshape(-1), (1 << _STATE_BITS) - 1, len(order), 0
        falling = -sizes
        while live > 8:
            step = flat[state[:live] * 256 + buf[begin[:live] + at]]
            state[:live] = step & mask
            count[:live] += step >> _STATE_BITS
            at += 1
            live = int(np.searchsorted(falling, -at, side="left"))
        for i in range(live):  # a few words longer than all others
            s, c = int(state[i]), int(count[i])
            for b in buf[begin[i] + at : begin[i] + sizes[i]].tolist():
                step = int(flat[s * 256 + b])
                s, c = step & mask, c + (step >> _STATE_BITS)
            state[i], count[i] = s, c
        out = np.empty(len(order), np.int64)
        out[order] = count + self.rest[state]
        return out


_made: dict[int, Automaton] = {}


def automaton(pieces: list[bytes]) -> Automaton:
    """One automaton for each vocabulary and Python worker."""
    key = hash(tuple(pieces))
    if key not in _made:
        _made.clear()
        _made[key] = Automaton(pieces)
    return _made[key]


def count_column(auto: Automaton, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, words) of each text of a string column."""
    tokens, n_words = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for _, _, buf, offsets in tx.slices(column):
        hashes, starts, ends, firsts = tx.hashed_words(buf, offsets, tx.SPACED_CASED)
        _, index, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        lengths = auto.lengths(buf, starts[index], ends[index])[inverse] if len(index) else np.zeros(0, np.int64)
        total = np.concatenate([[0], np.cumsum(lengths)])
        tokens.append(total[firsts[1:]] - total[firsts[:-1]])
        n_words.append(firsts[1:] - firsts[:-1])
    return np.concatenate(tokens), np.concatenate(n_words)


def _count(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton(held.value)
        for batch in batches:
            tokens, n_words = count_column(auto, batch.column(batch.schema.names.index("text")))
            keep = [i for i, c in enumerate(batch.schema.names) if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(n_words), pa.array(tokens)], [*(batch.schema.names[i] for i in keep), "n_words", "n_tokens"])

    return run


def count_tokens(spark: SparkSession, docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Return the columns of docs except text, with n_words and n_tokens (greedy longest-match pieces).

    A null, empty or blank text has no words and no tokens. Rows are counted alone, so repeated rows get equal counts.
    Columns of docs named n_words or n_tokens are replaced. A word of any length is walked whole. The vocabulary
    (tens of thousands of pieces, a fixed file) is read on the driver and broadcast.
    """
    prepare(spark)
    docs = docs.drop("n_words", "n_tokens").withColumn("text", F.col("text").cast("string"))
    held = spark.sparkContext.broadcast(pieces_of(vocabulary or vocabulary_of(spark)))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "text")
    return docs.mapInArrow(_count(held), f"{fields + ', ' if fields else ''}n_words long, n_tokens long")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
