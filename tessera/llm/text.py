"""Vectorised text primitives shared by the training-data operators.

Everything here works on the UTF-8 bytes of a whole Arrow string column at once (numpy over the
column's own buffers), in slices of a bounded number of bytes, so that one very long text or a batch of
many texts never needs more than a small multiple of ``MAX_SLICE`` bytes.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; one longer text is a slice of its own.
MAX_SLICE = (1 << 19) - 64

with contextlib.suppress(AttributeError, OSError):  # where there is glibc: large arrays go back to the system when freed
    _libc = ctypes.CDLL(None)
    _libc.mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD: above the arrays of a slice, which are used again
    _libc.mallopt(-1, 16 << 20)  # M_TRIM_THRESHOLD

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2**64
_BASE_2 = np.uint64(0xD1342543DE82EF95)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)


class Words:
    """A word class: which bytes belong to words, and the byte each is read as."""

    def __init__(self, separators: bytes, lower: bool = True):
        self.read = np.arange(256, dtype=np.uint8)
        if lower:
            self.read[65:91] += 32
        self.inside = np.ones(256, dtype=bool)
        self.inside[list(separators)] = False


#: Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z.
ALNUM = Words(bytes(range(0x30)) + bytes(range(0x3A, 0x41)) + bytes(range(0x5B, 0x61)) + bytes(range(0x7B, 0x80)))
#: Words ``[^\x20\x09-\x0D]+`` after lower-casing A-Z, and as they stand.
SPACED = Words(b"\x20\x09\x0a\x0b\x0c\x0d")
SPACED_CASED = Words(b"\x20\x09\x0a\x0b\x0c\x0d", lower=False)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


_SPREAD = mix(np.arange(1, 257, dtype=np.uint64) * _BASE_2)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_table(n: int, base: np.uint64 = _BASE) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse."""
    have = _powers.get(int(base))
    if have is None or len(have[0]) < n:
        size = 1 << max(16, int(n).bit_length())
        p, q = np.full(size, base, dtype=np.uint64), np.full(size, pow(int(base), -1, 1 << 64), dtype=np.uint64)
        p[0] = q[0] = 1
        have = _powers[int(base)] = np.multiply.accumulate(p), np.multiply.accumulate(q)
    return have[0][:n], have[1][:n]


def range_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64 = _BASE) -> np.ndarray:
    """64-bit hashes of codes[starts[i]:ends[i]] by one prefix sum (polynomial modulo 2**64, finalised)."""
    n = len(codes)
    p, q = _power_table(n + 1, base)
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(codes.astype(np.uint64, copy=False) * p[:n], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * q[starts] + (ends - starts).astype(np.uint64))


def other_range_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """As range_hashes of bytes, by another base over random numbers for the bytes; both together are a 128-bit hash."""
    return range_hashes(_SPREAD[codes], starts, ends, _BASE_2)


def slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of slices of a string column; a null text has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + MAX_SLICE, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def words(buf: np.ndarray, offsets: np.ndarray, kind: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes as read, word starts, word ends, words before each text) of a slice; a word never crosses texts."""
    n = len(buf)
    here = np.zeros(n + 1, dtype=bool)
    here[:n] = kind.inside[buf]
    before = np.zeros(n + 1, dtype=bool)
    before[1:] = here[:n]
    head = np.zeros(n + 1, dtype=bool)  # a text begins here
    head[offsets] = True
    starts = np.flatnonzero(here & (~before | head))
    ends = np.flatnonzero(before & (~here | head))
    return kind.read[buf], starts, ends, np.searchsorted(starts, offsets)


def hashed_words(buf: np.ndarray, offsets: np.ndarray, kind: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, word starts, word ends, words before each text)."""
    low, starts, ends, firsts = words(buf, offsets, kind)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends, firsts
    return range_hashes(low, starts, ends), starts, ends, firsts


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive items; order matters. Empty if there are fewer."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out *= _BASE
        out += hashes[j : j + n]
    return mix(out)


def byte_grams(codes: np.ndarray, k: int) -> np.ndarray:
    """range_hashes of every k consecutive codes."""
    n = len(codes)
    if n < k:
        return np.zeros(0, np.uint64)
    p, q = _power_table(n + 1)
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(codes.astype(np.uint64) * p[:n], out=prefix[1:])
    return mix((prefix[k:] - prefix[:-k]) * q[: n - k + 1] + np.uint64(k))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost minimum in each window of ``width`` values, in doubling steps."""
    n = len(values)
    if n < width or width < 1:
        return np.zeros(0, np.int64)
    pos, span = np.arange(n, dtype=np.int32), 1
    while span < width:
        step = min(span, width - span)
        less = values[step:] < values[:-step]
        pos = np.where(less, pos[step:], pos[:-step])
        values = np.where(less, values[step:], values[:-step])
        span += step
    return pos.astype(np.int64)


def sliding_least(hashes: np.ndarray, width: int) -> np.ndarray:
    """Position in each window of ``width`` hashes of the one that is least by its top 40 bits, the leftmost of equals."""
    if len(hashes) < width or width < 1:
        return np.zeros(0, np.int64)
    parts, most = [], 1 << 24
    for lo in range(0, len(hashes) - width + 1, most - width):
        keys = hashes[lo : lo + most] & np.uint64(0xFFFFFFFFFF000000)
        keys |= np.arange(len(keys), dtype=np.uint64)
        span = 1
        while span < width:
            step = min(span, width - span)
            keys = np.minimum(keys[:-step], keys[step:])
            span += step
        parts.append((keys & np.uint64(0xFFFFFF)).astype(np.int64)[: most - width] + lo)
    return np.concatenate(parts)
