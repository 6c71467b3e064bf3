"""Semiring provenance as columns.

Three commutative semirings: boolean, probability (independent alternatives) and polynomials with natural coefficients. A
polynomial is a map from monomial to coefficient; factors of a monomial are sorted, "1" is the empty monomial.
"""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TIMES, PLUS = "⊗", " ⊕ "
MODES = ("boolean", "probability", "polynomial", "adaptive")
POLYNOMIAL_ROWS, PROBABILITY_ROWS = 1000, 10000  # up to so many rows, adaptive mode keeps that much detail


def adaptive_mode(rows: int, mode: str = "adaptive") -> str:
    """The mode that stands for a result of so many rows; fixed modes stay."""
    if mode != "adaptive":
        return mode
    return "polynomial" if rows <= POLYNOMIAL_ROWS else "probability" if rows <= PROBABILITY_ROWS else "boolean"


def token(model: str, function: str, *sources: str) -> str:
    return f"{model}:{function}:[{','.join(sources)}]"


def u64le(number: Column) -> Column:
    """Eight bytes, least first."""
    digits = F.lpad(F.hex(number.cast("long")), 16, "0")
    return F.unhex(F.concat(*(F.substring(digits, i, 2) for i in range(15, 0, -2))))


def polynomial_bytes(monomial: Column) -> Column:
    """One term of coefficient 1: number of terms, length, text, coefficient."""
    one = F.lit(struct.pack("<Q", 1))
    return F.concat(one, u64le(F.octet_length(monomial)), F.encode(monomial, "UTF-8"), one)


def row_polynomials(name: str, number: Column) -> Column:
    """polynomial_bytes of name + number + "]" for numbers from 0 on: all but the digits is constant for each count of digits."""
    text, one = name.encode(), struct.pack("<Q", 1)
    heads = [F.lit(one + struct.pack("<Q", len(text) + d + 1) + text) for d in range(1, 20)]
    digits = number.cast("string")
    return F.concat(F.element_at(F.array(*heads), F.length(digits)), digits.cast("binary"), F.lit(b"]" + one))


def row_number_in_batch() -> Column:
    """The place of a row in its partition, from 0. Tokens restart with each batch of a result, so no exchange is needed."""
    return F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)


def attach(frame: DataFrame, mode: str = "polynomial", model: str = "query_pipeline", function: str = "sql") -> DataFrame:
    """The result with a binary provenance column; one that is there already stays."""
    if any(c.lower() == "provenance" for c in frame.columns):
        return frame
    if mode == "boolean":
        value = F.lit(b"\x01")
    elif mode == "probability":
        value = F.lit(struct.pack("<d", 1.0))
    else:
        value = row_polynomials(f"{model}:{function}:[row_", row_number_in_batch())
    return frame.withColumn("provenance", value)


def decode(value: bytes | None) -> dict[str, int] | None:
    """The polynomial of its bytes, or None if they are none."""
    try:
        (terms,), at, out = struct.unpack_from("<Q", value), 8, {}
        for _ in range(terms):
            (size,) = struct.unpack_from("<Q", value, at)
            name = value[at + 8 : at + 8 + size].decode()
            (out[name],) = struct.unpack_from("<Q", value, at + 8 + size)
            at += 16 + size
        return out if at == len(value) else None
    except (struct.error, TypeError, UnicodeDecodeError):
        return None


def encode(poly: dict[str, int]) -> bytes:
    parts = [struct.pack("<Q", len(poly))]
    for name, c in sorted(poly.items()):
        parts += [struct.pack("<Q", len(name.encode())), name.encode(), struct.pack("<Q", c)]
    return b"".join(parts)


def describe(poly: dict[str, int]) -> str:
    return PLUS.join(name if c == 1 else f"{c}·{name}" for name, c in sorted(poly.items())) if poly else "0"


# aggregates over alternative derivations
def any_of(flag: Column) -> Column:
    return F.bool_or(flag)


def noisy_or(p: Column) -> Column:
    """1 - product(1 - p): the chance that one of the independent alternatives holds."""
    return F.lit(1.0) - F.product(F.lit(1.0) - p)


def sum_polynomials(frame: DataFrame, keys: list[str], poly: str = "poly") -> DataFrame:
    """The sum of the polynomials of each group, by an aggregate over terms (combined before the exchange)."""
    terms = frame.select(*keys, F.explode(poly).alias("_m", "_c")).groupBy(*keys, "_m").agg(F.sum("_c").alias("_c"))
    return terms.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("_m", "_c")))).alias(poly))


# rows of a composition
def both(a: Column, b: Column) -> Column:
    return a & b


def product(a: Column, b: Column) -> Column:
    return a * b


def monomial(name: Column) -> Column:
    """The polynomial of one source."""
    return F.create_map(name, F.lit(1).cast("long"))


def times(a: Column, b: Column) -> Column:
    """The product of two polynomials: factors joined and sorted, "1" neutral, coefficients multiplied, terms merged."""

    def joined(x: Column, y: Column) -> Column:
        factors = F.array_sort(F.filter(F.concat(F.split(x, TIMES), F.split(y, TIMES)), lambda f: f != "1"))
        return F.when(F.size(factors) == 0, F.lit("1")).otherwise(F.array_join(factors, TIMES))

    pairs = F.flatten(F.transform(F.map_entries(a), lambda x: F.transform(F.map_entries(b), lambda y: F.struct(joined(x["key"], y["key"]).alias("m"), (x["value"] * y["value"]).alias("c")))))

    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))  # noqa: E731  (a value made once, read often)

    def merged(pairs: Column) -> Column:
        """Entries of sorted pairs, equal monomials as one: a run begins where the one before differs."""

        def entry(i: Column, end: Column) -> Column:
            total = F.aggregate(F.slice(pairs, i + 1, end - i), F.lit(0).cast("long"), lambda s, p: s + p["c"])
            return F.struct(F.get(pairs, i)["m"].alias("key"), total.alias("value"))

        begins = F.filter(F.sequence(F.lit(0), F.size(pairs) - 1), lambda i: F.coalesce(F.get(pairs, i - 1)["m"] != F.get(pairs, i)["m"], F.lit(True)))
        return once(begins, lambda at: F.transform(at, lambda i, k: entry(i, F.coalesce(F.get(at, k + 1), F.size(pairs)))))

    entries = once(F.array_sort(pairs), merged)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.map_from_entries(entries)).otherwise(F.create_map().cast("map<string,bigint>"))


def polynomial_text(poly: Column) -> Column:
    """Terms in order of their text, joined by the sign of the sum, a coefficient of 1 left out."""
    terms = F.transform(F.array_sort(F.map_entries(poly)), lambda e: F.when(e["value"] == 1, e["key"]).otherwise(F.concat(e["value"].cast("string"), F.lit("·"), e["key"])))
    return F.array_join(terms, PLUS)
