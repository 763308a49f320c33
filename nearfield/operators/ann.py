"""Approximate search: rows in cells around centroids, of which a query looks at the nearest ones.

Centroids are learnt on a sample of bounded size; every row is put in a cell. With as many probes as cells the
result is that of the exact search. Stored by cell, a search reads only the cells that its queries probe.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearfield.errors import error
from nearfield.functions.distances import Metric, block_distance, metric
from nearfield.functions.registry import resolve
from nearfield.operators.search import Best, nearest_batch, query_blocks, ranked, vectors
from nearfield.plans.stable import stable
from nearfield.sources import storage
from nearfield.sources.paths import checked

#: Rows on which centroids are learnt, at most about so many, chosen by a hash of the id.
SAMPLE_ROWS = 50_000
#: Recall of the exact neighbours that a search is to reach, and rows, at most, whose neighbours are sought to measure it.
RECALL, TRIALS = 0.9, 200


@dataclass(frozen=True)
class Config:
    """m and ef_construction set the centroids: m for each square root of 16 rows, ef_construction rounds of learning;
    ef_search sets how many rows a query looks at, at least; it looks at more cells where RECALL takes them."""

    m: int = 16
    ef_construction: int = 16
    ef_search: int = 200
    max_elements: int = 10_000

    def __post_init__(self) -> None:
        for name, value in asdict(self).items():
            if value <= 0:
                raise error("Config Error", f"{name} must be positive, not {value}")

    def cells(self, n: int) -> int:
        return max(1, min(n, round(math.sqrt(n) * self.m / 16)))

    def probes(self, n: int) -> int:
        cells = self.cells(n)
        return min(cells, max(1, math.ceil(cells * 4 * self.ef_search / max(1, n))))


def learn(sample: np.ndarray, cells: int, rounds: int, seed: int = 7) -> np.ndarray:
    """Lloyd's rounds from random rows; a cell without rows keeps its centroid."""
    rng = np.random.default_rng(seed)
    centroids = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        cell = nearest_cells(sample, centroids, 1)[:, 0]
        counts = np.bincount(cell, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, cell, sample)
        centroids = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centroids)
    return centroids


def nearest_cells(rows: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    out = np.empty((len(rows), min(n, len(centroids))), np.int64)
    size = (centroids * centroids).sum(axis=1)
    for start in range(0, len(rows), 4096):
        some = rows[start : start + 4096]
        far = size[None, :] - 2 * np.nan_to_num(some) @ centroids.T
        out[start : start + 4096] = far.argmin(axis=1)[:, None] if n == 1 else np.argsort(far, axis=1, kind="stable")[:, :n]
    return out


def directed(rows: np.ndarray, m: Metric) -> np.ndarray:
    """What cells are told by: the vectors, or their directions under metrics that look at angles only."""
    if m.name not in ("cosine", "angular"):
        return rows
    size = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return rows / np.where(size > 0, size, 1)


class CellIndex:
    """Rows of (id, vector) in cells; add before build or after it. Adding writes the new rows only, removing only ids."""

    def __init__(self, spark: SparkSession, dim: int, of: str | Metric = "euclidean", config: Config = Config(), p: float | None = None) -> None:  # noqa: B008  frozen
        if not 0 < dim <= 4096:
            raise error("Dimension Error", f"the dimension must be from 1 to 4096, not {dim}")
        self.spark, self.dim, self.metric, self.config = spark, dim, metric(of, p), config
        self._segments: tuple[DataFrame, ...] = ()
        self._removed: tuple[DataFrame, ...] = ()  # (id, segment) of rows that are no longer valid
        self._centroids: np.ndarray | None = None
        self._n = self._deleted = self._next = 0
        self._enough: dict[int, int] = {}

    def rows(self) -> DataFrame:
        """(id, vector) of the valid rows."""
        return self.spark.createDataFrame([], "id long, vector array<float>") if self._rows is None else self._rows.select("id", "vector")

    @property
    def _rows(self) -> DataFrame | None:
        """The valid rows of all segments."""
        if not self._segments:
            return None
        every = functools.reduce(DataFrame.unionByName, self._segments)
        return every.join(functools.reduce(DataFrame.unionByName, self._removed), ["id", "segment"], "left_anti") if self._removed else every

    def _append(self, frame: DataFrame) -> None:
        frame = frame.withColumn("cell", F.lit(-1)) if self._centroids is None else self._celled(frame)
        self._segments += (stable(frame.select("id", "vector", "cell", F.lit(self._next).alias("segment"))),)
        self._next += 1
        self._enough = {}

    def add(self, data, ids: Sequence[int] | None = None) -> CellIndex:
        """A matrix of single-precision numbers with ids, or a table of (id, vector). Negative, double or null ids, wrong lengths and
        too many rows are errors."""
        if isinstance(data, DataFrame):
            frame = data.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<float>").alias("vector"))
        else:
            matrix = np.asarray(data, np.float32)
            if matrix.ndim != 2 or matrix.shape[1] != self.dim or len(ids) != len(matrix):
                raise error("Dimension Error", f"vectors must have {self.dim} numbers, and as many ids")
            frame = self.spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, matrix)], "id long, vector array<float>")
        f = frame.agg(F.count("*").alias("n"), F.sum((F.coalesce(F.size("vector"), F.lit(-1)) != self.dim).cast("int")).alias("wrong"), F.sum((F.coalesce("id", F.lit(-1)) < 0).cast("int")).alias("negative")).first()
        if f.wrong:
            raise error("Dimension Error", f"{f.wrong} vectors don't have {self.dim} numbers")
        if f.negative:
            raise error("Negative ID", "ids must be 0 or more")
        if self._n + f.n > self.config.max_elements:
            raise error("Row Limit", f"more than {self.config.max_elements} rows")
        if not frame.groupBy("id").count().where("count > 1").isEmpty() or (self._n and not self._rows.join(frame.select("id"), "id", "left_semi").isEmpty()):
            raise error("Duplicate IDs", "an id is there already or comes twice")
        if f.n:
            self._append(frame)
            self._n += f.n
        return self

    def remove(self, ids: Sequence[int] | DataFrame) -> int:
        """Removes rows by id and says how many there were; unknown ids are let pass."""
        if not self._n:
            return 0
        asked = ids.select(F.col(ids.columns[0]).cast("long").alias("id")).distinct() if isinstance(ids, DataFrame) else self.spark.createDataFrame([(int(i),) for i in set(ids)], "id long")
        gone = stable(self._rows.join(asked, "id", "left_semi").select("id", "segment"))
        n = gone.count()
        if n:
            self._removed += (gone,)
            self._n, self._deleted, self._enough = self._n - n, self._deleted + n, {}
        return n

    def update(self, id: int, vector) -> None:
        """Replaces a row's vector. An unknown id is an error."""
        matrix = np.asarray([vector], np.float32)
        if matrix.shape != (1, self.dim):
            raise error("Dimension Error", f"vectors must have {self.dim} numbers")
        if not self.remove([id]):
            raise error("Unknown ID", str(id))
        self.add(matrix, [id])

    def compact(self) -> None:
        """Rewrites the valid rows as one segment; centroids stay."""
        rows, self._segments, self._removed, self._deleted = self._rows, (), (), 0
        if self._n:
            self._segments = (stable(rows.withColumn("segment", F.lit(self._next))),)
            self._next += 1

    deleted_count = property(lambda self: self._deleted)

    def should_compact(self, ratio: float = 0.2) -> bool:
        return bool(self._n + self._deleted) and self._deleted / (self._n + self._deleted) > ratio

    def add_item(self, vector) -> int:
        """Appends one vector; its id is the number of rows added so far."""
        i = self._n + self._deleted
        self.add([vector], [i])
        return i

    insert = lambda self, vector, id: self.add([vector], [id])

    def build(self) -> CellIndex:
        """Learns the centroids and puts every row in a cell."""
        if self._rows is None or not self._n:
            raise error("EmptyIndex", "the index has no rows")
        share = min(1.0, SAMPLE_ROWS / self._n)
        sample = self._rows.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < F.lit(int(share * 1_000_000))).orderBy("id").select("vector").collect()  # about SAMPLE_ROWS
        self._centroids = learn(directed(np.nan_to_num(np.array([r.vector for r in sample], np.float64)), self.metric), self.config.cells(self._n), self.config.ef_construction)
        rows, self._segments, self._removed, self._deleted = self._rows, (), (), 0
        self._append(rows.select("id", "vector"))
        return self

    def probes(self, k: int = 10) -> int:
        """Cells that a search for k rows looks at: those of the settings, or as many as have RECALL of the k nearest rows of
        some rows of the table, themselves left out, by two standard errors. Measured against the exact search once for each k."""
        least, cells = self.config.probes(self._n), len(self._centroids)
        k = max(10, k)
        if least >= cells:
            return cells
        if k not in self._enough:
            trials = self._rows.orderBy(F.xxhash64("id"), "id").limit(max(20, min(TRIALS, 200_000 // k))).select(F.col("id").alias("q_id"), F.col("vector").alias("q")).collect()
            queries = self.spark.createDataFrame([(r.q_id, r.q) for r in trials], "q_id long, q array<float>")
            truth = nearest_batch(self._rows.select("id", "vector"), queries, k + 1, self.metric).where("id <> q_id")
            truth = truth.withColumn("rank", F.row_number().over(Window.partitionBy("q_id").orderBy("rank"))).where(F.col("rank") <= k)
            found = self._rows.select("id", "cell").join(F.broadcast(truth.select("q_id", "id")), "id").select("q_id", "cell").collect()
            order = nearest_cells(directed(np.array([r.q for r in trials], np.float64), self.metric), self._centroids, cells)
            place, at = np.argsort(order, axis=1), {r.q_id: i for i, r in enumerate(trials)}
            query = np.array([at[r.q_id] for r in found], np.int64)
            # hits[i, p]: neighbours of the i-th trial in its p + 1 nearest cells.
            hits = np.zeros((len(trials), cells))
            np.add.at(hits, (query, place[query, [r.cell for r in found]]), 1)
            recall = hits.cumsum(axis=1) / np.maximum(hits.sum(axis=1, keepdims=True), 1)
            sure = recall.mean(axis=0) - 2 * recall.std(axis=0) / math.sqrt(len(trials)) >= RECALL
            self._enough[k] = int(np.argmax(sure)) + 1 if sure.any() else cells
        return max(least, self._enough[k])

    def _celled(self, frame: DataFrame) -> DataFrame:
        sent, of = self.spark.sparkContext.broadcast(self._centroids), self.metric

        def put(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest_cells(directed(vectors(batch.column(1)), of), sent.value, 1)[:, 0].astype(np.int32))], ["id", "vector", "cell"])

        return frame.select("id", "vector").mapInArrow(put, "id long, vector array<float>, cell int")

    def search_batch(self, queries, k: int, probes: int | None = None) -> DataFrame:
        """(q_id, rank, id, dist); only rows in the probed cells are looked at."""
        if k <= 0:
            raise error("K Error", "k must be positive")
        if self._centroids is None:
            self.build()
        if not isinstance(queries, DataFrame):
            matrix = np.asarray(queries, np.float32)
            if matrix.ndim != 2 or matrix.shape[1] != self.dim:
                raise error("Dimension Error", f"queries must have {self.dim} numbers")
            queries = self.spark.createDataFrame([(i, q.tolist()) for i, q in enumerate(matrix)], "q_id long, q array<float>")
        name, custom = resolve(self.metric.name) if self.metric.is_custom else (None, None)
        m = Metric(name) if name else self.metric
        probes = probes or self.probes(k)
        blocks = []
        for q_ids, matrix in query_blocks(queries):
            probed = nearest_cells(directed(matrix, self.metric), self._centroids, probes)
            cells = np.unique(probed).tolist()
            rows = self._rows.select("id", "vector", "cell")
            if len(cells) < len(self._centroids):
                rows = rows.where(F.col("cell").isin(cells))
            sent = self.spark.sparkContext.broadcast((q_ids, matrix, probed))
            blocks.append(ranked(rows.mapInArrow(functools.partial(_probe, sent, k, m, custom), "q_id long, id long, dist double"), k))
        return functools.reduce(DataFrame.unionByName, blocks) if blocks else self.spark.createDataFrame([], "q_id long, rank int, id long, dist double")

    def search(self, q, k: int, probes: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        found = self.search_batch([q], k, probes).orderBy("rank").collect()
        return np.array([r.id for r in found], np.int64), np.array([r.dist for r in found])

    def __len__(self) -> int:
        return self._n

    def get_user_id(self, position: int) -> int:
        """The id of the row at a position in order of id; -1 past the end."""
        found = self._rows.orderBy("id").select("id").limit(position + 1).collect() if self._rows is not None and position >= 0 else []
        return found[position].id if len(found) > position else -1

    def info(self) -> dict[str, str]:
        return {"type": "cells", "dim": str(self.dim), "metric": str(self.metric), "size": str(self._n), "cells": str(0 if self._centroids is None else len(self._centroids)), **{k: str(v) for k, v in asdict(self.config).items()}, "memory_mb": f"{(4 * self.dim + 12) * self._n / 1e6:.2f}"}

    def validate(self) -> list[str]:
        wrong = self._rows.where(F.size("vector") != self.dim).count() if self._rows is not None else 0
        n = self._rows.count() if self._rows is not None else 0
        return [f"wrong dimensions: {wrong}"] * bool(wrong) + [f"{n} rows, {self._n} expected"] * (n != self._n)

    def save(self, path: str, root: str = "") -> None:
        """Rows by cell, so that a later search reads the probed ones only."""
        if self._centroids is None:
            self.build()
        storage.write(self._rows.drop("segment"), {"dim": self.dim, "metric": self.metric.name, "p": self.metric.p, "config": asdict(self.config), "centroids": self._centroids.tolist(), "n": self._n, "probes": {str(k): n for k, n in self._enough.items()}}, checked(path, root), "cell")

    @classmethod
    def load(cls, spark: SparkSession, path: str, root: str = "") -> CellIndex:
        rows, m = storage.read(spark, checked(path, root))
        out = cls(spark, m["dim"], Metric(m["metric"], m["p"]), Config(**m["config"]))
        out._segments, out._next = (rows.select("id", "vector", F.col("cell").cast("int").alias("cell"), F.lit(0).alias("segment")),), 1
        out._centroids, out._n = np.array(m["centroids"]), m["n"]
        out._enough = {int(k): n for k, n in m.get("probes", {}).items()}
        return out


def _probe(sent, k: int, m: Metric, custom, batches):
    q_ids, matrix, probed = sent.value
    best = Best(q_ids, k)
    by_cell: dict[int, list[int]] = {}
    for i, cells in enumerate(probed):
        for c in cells.tolist():
            by_cell.setdefault(c, []).append(i)
    for batch in batches:
        ids, rows, cell = batch.column(0).to_numpy(), vectors(batch.column(1)), batch.column(2).to_numpy()
        for c in np.unique(cell).tolist():
            at = np.flatnonzero(cell == c)
            some = rows[at]
            for i in by_cell.get(c, ()):
                best.add(i, ids[at], block_distance(m, some, matrix[i], custom))
    yield best.batch()


class Index:
    """One face for both kinds: 'brute' (or 'exact', 'gpu'), with a precision, and 'hnsw' (or 'ivf')."""

    EXACT, CELLS, PRECISIONS = ("brute", "bruteforce", "exact", "gpu"), ("hnsw", "ivf", "ann"), ("fp32", "fp16", "int8")

    def __init__(self, spark: SparkSession, kind: str, dim: int, of: str | Metric = "euclidean", precision: str = "fp32", config: Config | None = None) -> None:
        from nearfield.operators.index import VectorIndex

        low = kind.lower()
        if low not in self.EXACT + self.CELLS or precision not in self.PRECISIONS:
            raise ValueError(f"unknown kind {kind} or precision {precision}")
        self.kind, self.precision = low, precision
        self._index = VectorIndex(spark, dim, of) if low in self.EXACT else CellIndex(spark, dim, of, config or Config())

    def _rounded(self, v) -> np.ndarray:
        v = np.asarray(v, np.float32)
        if self.precision == "fp16":
            return v.astype(np.float16).astype(np.float32)
        if self.precision == "int8":
            whole = np.trunc(np.clip(np.where(np.isfinite(v), v, 0) * 127, -128, 127))
            return (whole / 127).astype(np.float32)
        return v

    def add_item(self, vector) -> int:
        return self._index.add_item(self._rounded(vector))

    def add(self, data, ids) -> None:
        self._index.add(self._rounded(data), ids)

    def build(self) -> None:
        self._index.build()

    def search(self, q, k: int) -> tuple[np.ndarray, np.ndarray]:
        return self._index.search(self._rounded(q), k)

    def __len__(self) -> int:
        return len(self._index)

    def save(self, path: str, root: str = "") -> None:
        self._index.save(path, root)
