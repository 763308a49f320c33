"""Errors carry a kind, so that callers can tell them apart without parsing messages."""

from __future__ import annotations

import re


class VectorError(Exception):
    """`[Kind] detail`, on one line and without brackets in the detail."""

    def __init__(self, kind: str, detail: str) -> None:
        self.kind, self.detail = kind, re.sub(r"[\r\n\[\]]+", " ", detail).strip()
        super().__init__(f"[{kind}] {self.detail}")


class VectorValueError(VectorError, ValueError):
    """Wrong sizes, duplicate ids, an empty index or a bad exponent."""


class VectorIOError(VectorError, OSError):
    """A file or folder can't be read or written."""


class MetricNotFound(VectorError, KeyError):
    """No such metric in the registry."""


VALUE_KINDS = {"EmptyIndex", "Dimension Error", "Duplicate IDs", "Reshape Error", "Minkowski Error", "Negative ID"}


def error(kind: str, detail: str) -> VectorError:
    if kind == "IO Error":
        return VectorIOError(kind, detail)
    return VectorValueError(kind, detail) if kind in VALUE_KINDS else VectorError(kind, detail)
