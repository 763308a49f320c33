"""Typed metadata columns beside the vectors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.errors import error

#: The kinds of metadata with their Spark types and what a missing value becomes.
KINDS = {"int": ("bigint", 0), "float": ("double", 0.0), "string": ("string", ""), "tags": ("array<string>", []), "timestamp": ("timestamp", 0)}
RESERVED = {"id", "vector", "sq_norm", "pos", "version"}


@dataclass(frozen=True)
class Schema:
    fields: dict[str, str]

    def __post_init__(self) -> None:
        for name, kind in self.fields.items():
            if kind not in KINDS:
                raise error("Metadata Type Error", f"{name} has unknown type {kind}")
            if name.lower() in RESERVED:
                raise error("Metadata Type Error", f"{name} is reserved")

    def default(self, kind: str) -> Column:
        if kind == "tags":
            return F.expr("cast(array() as array<string>)")
        if kind == "timestamp":
            return F.timestamp_seconds(F.lit(0))
        return F.lit(KINDS[kind][1]).cast(KINDS[kind][0])

    def columns(self, df: DataFrame) -> list[Column]:
        """Every field, cast, with defaults for what is missing; integers serve as seconds in timestamp fields."""
        types, out = dict(df.dtypes), []
        extra = [c for c in df.columns if c not in self.fields and c not in RESERVED]
        if extra:
            raise error("Unknown Metadata Field", ", ".join(extra))
        for name, kind in self.fields.items():
            have = types.get(name)
            if have is None:
                out.append(self.default(kind).alias(name))
                continue
            if not self._fits(have, kind):
                raise error("Metadata Type Error", f"{name} is {have}, not {kind}")
            value = F.timestamp_seconds(F.col(name)) if kind == "timestamp" and have in ("bigint", "int") else F.col(name).cast(KINDS[kind][0])
            out.append(F.coalesce(value, self.default(kind)).alias(name))
        return out

    @staticmethod
    def _fits(have: str, kind: str) -> bool:
        whole = ("tinyint", "smallint", "int", "bigint")
        return have == "void" or have in {"int": whole, "float": (*whole, "float", "double"), "string": ("string",), "tags": ("array<string>",), "timestamp": (*whole, "timestamp")}[kind]


def infer(value) -> str:
    """The kind of a Python value: whole number, number, text, list of texts."""
    if isinstance(value, int):
        return "int"
    if isinstance(value, float):
        return "float"
    if isinstance(value, str):
        return "string"
    if isinstance(value, (list, tuple)) and all(isinstance(x, str) for x in value):
        return "tags"
    raise error("Metadata Type Error", f"no metadata type fits {type(value).__name__}")
