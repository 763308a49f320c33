"""Distances between two array columns as Catalyst expressions, and the same over numpy blocks.

All arithmetic is in double. Cosine with a zero vector is 1, angular pi / 2; NaN in a vector gives NaN, which
sorts last. Lengths must be equal; callers check them, as zip_with would fill up with nulls.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from nearfield.errors import error

HAMMING_TOLERANCE, JACCARD_THRESHOLD = 1e-5, 0.5
BUILT_IN = ("euclidean", "sqeuclidean", "cosine", "manhattan", "chebyshev", "minkowski", "hamming", "jaccard", "angular", "canberra")
ALIASES = {"l2": "euclidean", "l1": "manhattan", "linf": "chebyshev"}


@dataclass(frozen=True)
class Metric:
    """A metric by name; p is Minkowski's exponent. A name that isn't built in is a registered metric's."""

    name: str
    p: float | None = None

    def __post_init__(self) -> None:
        low = self.name.lower()
        object.__setattr__(self, "name", ALIASES.get(low, low if low in BUILT_IN else self.name))
        if self.name == "minkowski" and not (self.p is not None and self.p > 0):
            raise error("Minkowski Error", f"the exponent must be positive, not {self.p}")

    @property
    def is_custom(self) -> bool:
        return self.name not in BUILT_IN

    def __str__(self) -> str:
        return f"minkowski_p{self.p:g}" if self.name == "minkowski" else self.name


def metric(of: str | Metric, p: float | None = None) -> Metric:
    return of if isinstance(of, Metric) else Metric(of, p)


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def dot(v: Column, q: Column) -> Column:
    return _sum(F.zip_with(v, q, lambda x, y: x * y))


def squared_norm(v: Column) -> Column:
    return F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x)


def magnitude(v: Column) -> Column:
    return F.sqrt(squared_norm(v))


def _each(v: Column, q: Column) -> Column:
    return F.zip_with(v, q, lambda x, y: F.abs(x - y))


def distance(m: str | Metric, v: Column, q: Column) -> Column:
    """The distance of two array columns."""
    m, v, q = metric(m), doubles(v), doubles(q)
    if m.is_custom:
        from nearfield.functions.registry import distance_udf

        return distance_udf(m.name)(v, q)
    if m.name == "minkowski":
        if m.p == 1:
            return _sum(_each(v, q))
        if m.p == 2:
            return distance("euclidean", v, q)
        if math.isinf(m.p):
            return distance("chebyshev", v, q)
        return F.pow(_sum(F.transform(_each(v, q), lambda x: F.pow(x, F.lit(float(m.p))))), F.lit(1.0 / m.p))
    if m.name in ("cosine", "angular"):
        zero = (squared_norm(v) == 0) | (squared_norm(q) == 0)
        if m.name == "cosine":
            return F.when(zero, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - dot(v, q) / F.sqrt(squared_norm(v) * squared_norm(q))))
        cos = dot(v, q) / F.sqrt(squared_norm(v) * squared_norm(q))
        return F.when(zero, math.pi / 2).otherwise(F.when(F.isnan(cos), cos).otherwise(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos)))))
    if m.name == "chebyshev":
        return F.aggregate(_each(v, q), F.lit(0.0), lambda s, x: F.greatest(s, x))
    if m.name == "hamming":
        return _sum(F.transform(_each(v, q), lambda x: F.when(x > HAMMING_TOLERANCE, 1.0).otherwise(0.0)))
    if m.name == "jaccard":
        on = lambda x: x > JACCARD_THRESHOLD
        both = _sum(F.zip_with(v, q, lambda x, y: F.when(on(x) & on(y), 1.0).otherwise(0.0)))
        either = _sum(F.zip_with(v, q, lambda x, y: F.when(on(x) | on(y), 1.0).otherwise(0.0)))
        return F.when(either == 0, 0.0).otherwise(1 - both / either)
    if m.name == "canberra":
        return _sum(F.zip_with(v, q, lambda x, y: F.when(F.abs(x) + F.abs(y) > 0, F.abs(x - y) / (F.abs(x) + F.abs(y))).otherwise(0.0)))
    squares = _sum(F.zip_with(v, q, lambda x, y: (x - y) * (x - y)))
    return squares if m.name == "sqeuclidean" else _sum(_each(v, q)) if m.name == "manhattan" else F.sqrt(squares)


def added(each: np.ndarray) -> np.ndarray:
    """The sum of each row from left to right, as Catalyst and SQL add. numpy adds so across columns alone; along a row it pairs numbers
    up, whose rounding parts distances that are equal here, or joins others, and so changes ranks."""
    if len(each) < 2:
        return np.array([functools.reduce(float.__add__, row, 0.0) for row in each.tolist()], np.float64)
    return np.asfortranarray(each).sum(axis=1)


def block_distance(m: Metric, rows: np.ndarray, q: np.ndarray, custom=None) -> np.ndarray:
    """The distances of a block's rows (doubles) from one query, or of each row from its own."""
    if m.is_custom:
        return custom.over(rows, q)
    with np.errstate(all="ignore"):
        if m.name in ("cosine", "angular"):
            a, b = added(rows * rows), added(np.atleast_2d(q * q))
            zero = (a == 0) | (b == 0)
            cos = added(rows * q) / np.sqrt(a * b)
            if m.name == "cosine":
                return np.where(zero, 1.0, np.maximum(0.0, 1 - cos))
            return np.where(zero, math.pi / 2, np.arccos(np.clip(cos, -1, 1)))
        if m.name == "jaccard":
            x, y = rows > JACCARD_THRESHOLD, q > JACCARD_THRESHOLD
            either = (x | y).sum(axis=1)
            return np.where(either == 0, 0.0, 1 - (x & y).sum(axis=1) / np.maximum(either, 1))
        each = np.abs(rows - q)
        if m.name == "hamming":
            return (each > HAMMING_TOLERANCE).sum(axis=1).astype(np.float64)
        if m.name == "canberra":
            size = np.abs(rows) + np.abs(q)
            return added(np.where(size > 0, each / np.where(size > 0, size, 1), np.where(np.isnan(size), np.nan, 0.0)))
        if m.name == "chebyshev" or m.name == "minkowski" and math.isinf(m.p):
            return each.max(axis=1, initial=0.0)
        if m.name == "manhattan" or m.name == "minkowski" and m.p == 1:
            return added(each)
        if m.name == "minkowski" and m.p != 2:
            return added(each**m.p) ** (1.0 / m.p)
        squares = added(each * each)
        return squares if m.name == "sqeuclidean" else np.sqrt(squares)


def to_int8(v: Column) -> Column:
    """trunc(clamp(127 x, -128, 127)); NaN and infinities give 0."""
    finite = lambda x: ~(F.isnan(x) | (F.abs(x) == float("inf")))
    return F.transform(doubles(v), lambda x: F.when(finite(x), F.greatest(F.lit(-128.0), F.least(F.lit(127.0), x * 127))).otherwise(0.0).cast("tinyint"))


def from_int8(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double") / 127)


def to_half(v: Column) -> Column:
    """Rounded to half precision; Spark has no such type, so numpy rounds and the result is float."""
    @F.pandas_udf("array<float>")
    def rounded(column: pd.Series) -> pd.Series:
        return column.map(lambda x: None if x is None else np.asarray(x, np.float32).astype(np.float16).astype(np.float32))

    return rounded(v)


def register_sql(spark: SparkSession) -> None:
    """The distances as SQL functions of two arrays: vector_euclidean(v, q) and so on; vector_minkowski takes p too."""
    each = {
        "sqeuclidean": "aggregate(zip_with(v, q, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x)",
        "euclidean": "sqrt(aggregate(zip_with(v, q, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x))",
        "manhattan": "aggregate(zip_with(v, q, (x, y) -> abs(x - y)), 0D, (s, x) -> s + x)",
        "chebyshev": "aggregate(zip_with(v, q, (x, y) -> abs(x - y)), 0D, (s, x) -> greatest(s, x))",
        "dot": "aggregate(zip_with(v, q, (x, y) -> x * y), 0D, (s, x) -> s + x)",
        "hamming": f"aggregate(zip_with(v, q, (x, y) -> if(abs(x - y) > {HAMMING_TOLERANCE}, 1D, 0D)), 0D, (s, x) -> s + x)",
        "canberra": "aggregate(zip_with(v, q, (x, y) -> if(abs(x) + abs(y) > 0, abs(x - y) / (abs(x) + abs(y)), 0D)), 0D, (s, x) -> s + x)",
    }
    each["jaccard"] = (
        f"if(exists(zip_with(v, q, (x, y) -> x > {JACCARD_THRESHOLD} or y > {JACCARD_THRESHOLD}), b -> b), "
        f"1D - aggregate(zip_with(v, q, (x, y) -> if(x > {JACCARD_THRESHOLD} and y > {JACCARD_THRESHOLD}, 1D, 0D)), 0D, (s, x) -> s + x)"
        f" / aggregate(zip_with(v, q, (x, y) -> if(x > {JACCARD_THRESHOLD} or y > {JACCARD_THRESHOLD}, 1D, 0D)), 0D, (s, x) -> s + x), 0D)"
    )
    for name, body in each.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION vector_{name}(v ARRAY<DOUBLE>, q ARRAY<DOUBLE>) RETURNS DOUBLE RETURN {body}")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION vector_minkowski(v ARRAY<DOUBLE>, q ARRAY<DOUBLE>, p DOUBLE) RETURNS DOUBLE RETURN power(aggregate(zip_with(v, q, (x, y) -> power(abs(x - y), p)), 0D, (s, x) -> s + x), 1 / p)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION vector_cosine(v ARRAY<DOUBLE>, q ARRAY<DOUBLE>) RETURNS DOUBLE RETURN if(vector_dot(v, v) = 0 or vector_dot(q, q) = 0, 1D, greatest(0D, 1 - vector_dot(v, q) / sqrt(vector_dot(v, v) * vector_dot(q, q))))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION vector_angular(v ARRAY<DOUBLE>, q ARRAY<DOUBLE>) RETURNS DOUBLE RETURN if(vector_dot(v, v) = 0 or vector_dot(q, q) = 0, pi() / 2, acos(greatest(-1D, least(1D, vector_dot(v, q) / sqrt(vector_dot(v, v) * vector_dot(q, q))))))")
