"""Vectors and knowledge-graph scores over array columns, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _array(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("array<double>")


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return _sum(F.zip_with(_array(a), _array(b), lambda x, y: x * y))


def l2_distance(a: Column | str, b: Column | str) -> Column:
    """Euclidean distance; NULL if either side, a component or a length is missing or differs."""
    return F.sqrt(_sum(F.zip_with(_array(a), _array(b), lambda x, y: (x - y) * (x - y))))


def cosine_similarity(a: Column | str, b: Column | str) -> Column:
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def transe(h: Column | str, r: Column | str, t: Column | str) -> Column:
    """-|h + r - t|."""
    there = F.zip_with(_array(h), _array(r), lambda x, y: x + y)
    return -l2_distance(there, t)


def transh(h: Column | str, r: Column | str, t: Column | str, w: Column | str) -> Column:
    """-|h' + r - t'| with h' = h - (w·h) w, on the hyperplane of w as it is given (not normalised)."""

    def flat(e: Column | str) -> Column:
        along = dot(w, e)
        return F.zip_with(_array(e), _array(w), lambda x, y: x - along * y)

    return transe(flat(h), r, flat(t))


def nearest(vectors: DataFrame, query: list[float], k: int, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """The k rows of the least Euclidean distance to one query, exact: each task keeps k, ties go to the smaller key."""
    target = F.array(*(F.lit(float(x)) for x in query))
    return vectors.withColumn("distance", l2_distance(vector, target)).orderBy(F.asc_nulls_last("distance"), key).limit(k)
