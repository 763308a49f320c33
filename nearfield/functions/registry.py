"""Metrics that users register: Python functions of two lists, run over Arrow batches. One that comes with a form over blocks, which gives
the same distances for a whole matrix at once, is run in that form by batch searches."""

from __future__ import annotations

import logging
import threading
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from nearfield.errors import MetricNotFound
from nearfield.functions.distances import ALIASES, BUILT_IN

Function = Callable[[list[float], list[float]], float]
#: Of a matrix of doubles and one vector: the distance of each row.
Block = Callable[[np.ndarray, np.ndarray], np.ndarray]
#: What a metric that raises or returns no number gives: the largest single-precision number.
FAILED = 3.4028234663852886e38

_lock = threading.Lock()
_metrics: dict[str, Function] = {}
_blocks: dict[str, Block] = {}


def register_metric(name: str, function: Function, block: Block | None = None) -> None:
    """Adds a metric, or replaces the one of this name. Calling a function for each pair takes most of a batch search's time; block, where
    given, must say the same for all rows of a matrix."""
    with _lock:
        _metrics[name] = function
        _blocks.pop(name, None)
        if block is not None:
            _blocks[name] = block


def unregister_metric(name: str) -> None:
    with _lock:
        _metrics.pop(name, None)
        _blocks.pop(name, None)


def list_metrics() -> list[str]:
    with _lock:
        return sorted({*BUILT_IN, *_metrics} - {"minkowski"})


def get_metric(name: str) -> Function:
    with _lock:
        if name not in _metrics:
            raise MetricNotFound("MetricNotFound", f"no metric {name} is registered")
        return _metrics[name]


@dataclass(frozen=True)
class Guarded:
    """A metric whose errors are distances."""

    function: Function
    block: Block | None = None

    def __call__(self, a: list[float], b: list[float]) -> float:
        try:
            return float(self.function(a, b))
        except Exception:  # noqa: BLE001  whatever a user's function raises
            return FAILED

    def over(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        """The distance of each row. Rows for which the form over blocks fails are left to the function."""
        if self.block is not None:
            try:
                found = np.asarray(self.block(rows, q), np.float64)
                if found.shape == (len(rows),):
                    return found
            except Exception:  # noqa: BLE001
                logging.getLogger(__name__).debug("a metric's form over blocks failed", exc_info=True)
        return np.array([self(r.tolist(), q.tolist()) for r in rows], np.float64)


def guarded(function: Function, block: Block | None = None) -> Guarded:
    return Guarded(function, block)


def resolve(name: str) -> tuple[str, Guarded | None]:
    """A metric that nobody has registered falls back to euclidean, with a warning."""
    low = ALIASES.get(name.lower(), name.lower())
    if low in BUILT_IN:
        return low, None
    try:
        return name, guarded(get_metric(name), _blocks.get(name))
    except MetricNotFound:
        logging.getLogger(__name__).warning("no metric %s is registered; euclidean is used", name)
        return "euclidean", None


def distance_udf(name: str):
    """A function of two array columns."""
    known, function = resolve(name)
    if function is None:
        from nearfield.functions.distances import distance

        return lambda v, q: distance(known, v, q)

    @F.pandas_udf("double")
    def call(v: pd.Series, q: pd.Series) -> pd.Series:
        return pd.Series([function(np.asarray(a).tolist(), np.asarray(b).tolist()) for a, b in zip(v, q)], dtype="float64")

    return call
