"""Filters of the rows that a search looks at, as an algebra over columns.

A filter turns a table with `id` and `pos` into the same table with what else it needs, and a condition on it.
Conditions stay in Catalyst, before the distances, and reach the scan; long lists come in by a join instead of a
literal. A null condition lets a row not pass, nor does its negation's inside: not of a null is true.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.plans.predicates import parse

#: Ids or bits that are written into the plan; longer lists are joined.
INLINE = 1_000


class Filter:
    """Make one with the class methods; combine with &, | and ~."""

    def __init__(self, prepare: Callable[[DataFrame, str], tuple[DataFrame, Column]]) -> None:
        self._prepare = prepare

    def prepare(self, df: DataFrame, prefix: str = "_f") -> tuple[DataFrame, Column]:
        return self._prepare(df, prefix)

    def apply(self, df: DataFrame) -> DataFrame:
        columns = df.columns
        prepared, condition = self.prepare(df)
        return prepared.where(condition).select(*columns)

    @classmethod
    def column(cls, condition: Column) -> Filter:
        return cls(lambda df, _: (df, condition))

    @classmethod
    def id_range(cls, least: int, most: int) -> Filter:
        """Both ends included."""
        return cls.column(F.col("id").between(least, most))

    @classmethod
    def id_set(cls, ids: Sequence[int] | DataFrame) -> Filter:
        """Ids as a list, or as the first column of a table of any size."""
        if not isinstance(ids, DataFrame):
            listed = sorted(set(ids))
            if len(listed) <= INLINE:
                return cls.column(F.col("id").isin(listed) if listed else F.lit(False))

        def prepare(df: DataFrame, prefix: str) -> tuple[DataFrame, Column]:
            table = ids if isinstance(ids, DataFrame) else df.sparkSession.createDataFrame([(i,) for i in listed], "id long")
            table = table.select(F.col(table.columns[0]).alias("id")).where("id is not null").distinct().withColumn(prefix, F.lit(True))
            return df.join(table, "id", "left"), F.coalesce(F.col(prefix), F.lit(False))

        return cls(prepare)

    @classmethod
    def boolean(cls, bits: Sequence[bool] | DataFrame) -> Filter:
        """A bit for each position; a position past the end is false. Or a table of (pos, bit)."""
        if not isinstance(bits, DataFrame) and len(bits) <= INLINE:
            return cls.column(F.col("pos").isin([i for i, b in enumerate(bits) if b]) if any(bits) else F.lit(False))

        def prepare(df: DataFrame, prefix: str) -> tuple[DataFrame, Column]:
            table = bits if isinstance(bits, DataFrame) else df.sparkSession.createDataFrame([(i, True) for i, b in enumerate(bits) if b], "pos long, bit boolean")
            table = table.where("bit").select("pos").distinct().withColumn(prefix, F.lit(True))
            return df.join(table, "pos", "left"), F.coalesce(F.col(prefix), F.lit(False))

        return cls(prepare)

    @classmethod
    def callback(cls, function: Callable[[int], bool]) -> Filter:
        """A Python predicate on the id, over Arrow batches."""
        @F.pandas_udf("boolean")
        def accepts(ids: pd.Series) -> pd.Series:
            return ids.map(lambda i: bool(function(int(i))))

        return cls.column(accepts("id"))

    @classmethod
    def predicate(cls, text: str) -> Filter:
        """A condition on metadata such as `country == "IN" AND score > 0.8`."""
        return cls(lambda df, _: (df, parse(text, df.columns)))

    @classmethod
    def equals(cls, column: str, value) -> Filter:
        return cls.column(F.col(column) == F.lit(value))

    @classmethod
    def gt(cls, column: str, value) -> Filter:
        return cls.column(F.col(column) > F.lit(value))

    @classmethod
    def lt(cls, column: str, value) -> Filter:
        return cls.column(F.col(column) < F.lit(value))

    @classmethod
    def custom(cls, function: Callable[[int], bool]) -> Filter:
        return cls.callback(function)

    @classmethod
    def all_of(cls, filters: Sequence[Filter]) -> Filter:
        """Of no filters: true."""
        return cls._combined(filters, lambda a, b: a & b, True)

    @classmethod
    def any_of(cls, filters: Sequence[Filter]) -> Filter:
        """Of no filters: false."""
        return cls._combined(filters, lambda a, b: a | b, False)

    compound = any_of

    @classmethod
    def _combined(cls, filters: Sequence[Filter], how, empty: bool) -> Filter:
        def prepare(df: DataFrame, prefix: str) -> tuple[DataFrame, Column]:
            conditions = []
            for k, f in enumerate(filters):
                df, condition = f.prepare(df, f"{prefix}_{k}")
                conditions.append(condition)
            return df, reduce(how, conditions, F.lit(empty)) if conditions else F.lit(empty)

        return cls(prepare)

    def __and__(self, other: Filter) -> Filter:
        return Filter.all_of([self, other])

    def __or__(self, other: Filter) -> Filter:
        return Filter.any_of([self, other])

    def __invert__(self) -> Filter:
        def prepare(df: DataFrame, prefix: str) -> tuple[DataFrame, Column]:
            df, condition = self.prepare(df, f"{prefix}_n")
            return df, ~F.coalesce(condition, F.lit(False))

        return Filter(prepare)
