"""The exact index: an append-only list of segments and the rows that are no longer valid.

Adding writes only the new rows, removing only their positions; readers see a union less an anti-join, both of
which Catalyst pushes filters through. compact() rewrites. Each change swaps the state under a lock, so a
search, which takes the state once, sees one version.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.errors import error
from nearfield.functions.distances import Metric, metric, squared_norm
from nearfield.operators import search
from nearfield.operators.filters import Filter
from nearfield.operators.metadata import KINDS, Schema, infer
from nearfield.operators.positions import with_positions
from nearfield.plans.monitor import Collector
from nearfield.plans.stable import stable
from nearfield.sources import storage
from nearfield.sources.paths import checked

MAX_DIM, MAX_ROWS = 4096, 1_000_000
#: Relative difference that a stored squared norm may have.
NORM_TOLERANCE = 1e-3


@dataclass(frozen=True)
class State:
    segments: tuple[DataFrame, ...] = ()
    removed: tuple[DataFrame, ...] = ()  # (pos, version) of rows that are no longer valid
    slots: int = 0
    deleted: int = 0
    version: int = 0
    schema: Schema = field(default_factory=lambda: Schema({}))


class VectorIndex:
    """max_rows bounds a batch and the whole index; None lifts it."""

    def __init__(self, spark: SparkSession, dim: int, of: str | Metric = "euclidean", p: float | None = None, max_rows: int | None = MAX_ROWS, max_dim: int = MAX_DIM) -> None:
        if not 0 < dim <= max_dim:
            raise error("Dimension Error", f"the dimension must be from 1 to {max_dim}, not {dim}")
        self.spark, self.dim, self.metric, self.max_rows = spark, dim, metric(of, p), max_rows
        self._state, self._lock = State(), threading.RLock()
        self._bits: dict[str, Sequence[bool] | DataFrame] = {}
        self._collector: Collector | None = None
        self.max_deleted_ratio = 0.2

    @classmethod
    def minkowski(cls, spark: SparkSession, dim: int, p: float, **options) -> VectorIndex:
        return cls(spark, dim, Metric("minkowski", p), **options)

    # Ingest

    def _frame(self, data, ids, metadata: dict[str, Sequence] | None) -> DataFrame:
        if isinstance(data, DataFrame):
            return data
        matrix = np.asarray(data, np.float32)
        if matrix.ndim != 2 or matrix.shape[1] != self.dim:
            raise error("Dimension Error", f"vectors must have {self.dim} numbers")
        ids = [int(i) for i in ids]
        if len(ids) != len(matrix) or any(len(v) != len(ids) for v in (metadata or {}).values()):
            raise error("Dimension Error", "as many ids and metadata values as vectors are needed")
        names, kinds = list(metadata or {}), []
        for name in names:
            declared = self._state.schema.fields.get(name)
            if declared is None:
                raise error("Unknown Metadata Field", name)
            for value in metadata[name]:
                kind = infer(value) if value is not None else declared
                if kind != declared and (kind, declared) not in {("int", "float"), ("int", "timestamp")}:
                    raise error("Metadata Type Error", f"{name} is {declared}, not {kind}")
            kinds.append("bigint" if declared == "timestamp" else KINDS[declared][0])
        rows = [(i, v.tolist(), k, *(float(metadata[n][k]) if kinds[j] == "double" and metadata[n][k] is not None else metadata[n][k] for j, n in enumerate(names))) for k, (i, v) in enumerate(zip(ids, matrix))]
        types = "".join(f", `{n}` {t}" for n, t in zip(names, kinds))
        return self.spark.createDataFrame(rows, f"id long, vector array<float>, _order long{types}")

    def add(self, data, ids: Sequence[int] | None = None, metadata: dict[str, Sequence] | None = None) -> VectorIndex:
        """Appends a matrix with ids (and metadata by name), or a table of (id, vector, metadata...).

        Positions follow the order given, or the ids of a table. Duplicate and negative ids, null or wrong vectors
        and too many rows are errors, and nothing is added then.
        """
        frame = self._frame(data, ids, metadata)
        with self._lock:
            state = self._state
            order = "_order" if "_order" in frame.columns else "id"
            columns = state.schema.columns(frame.drop("_order"))
            rows = frame.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<float>").alias("vector"), *([order] if order != "id" else []), *columns)
            found = rows.agg(
                F.count("*").alias("n"), F.sum((F.col("id") < 0).cast("int")).alias("negative"), F.sum(F.col("id").isNull().cast("int")).alias("null"),
                F.sum((F.coalesce(F.size("vector"), F.lit(-1)) != self.dim).cast("int")).alias("wrong"), F.sum(F.exists("vector", F.isnull).cast("int")).alias("holes"),
            ).first()
            if not found.n:
                return self
            if found.wrong or found.holes:
                raise error("Dimension Error", f"{found.wrong or found.holes} vectors don't have {self.dim} numbers")
            if found.negative or found.null:
                raise error("Negative ID", "ids must be 0 or more")
            if self.max_rows is not None and (found.n > self.max_rows or found.n + len(self) > self.max_rows):
                raise error("Row Limit", f"more than {self.max_rows} rows")
            if not repeated_ids(rows).isEmpty() or (len(self) and not rows.join(self.rows().select("id"), "id", "left_semi").isEmpty()):
                raise error("Duplicate IDs", "an id is there already or comes twice")
            placed = with_positions(rows, order, "pos", state.slots).drop("_order")
            segment = stable(placed.withColumn("sq_norm", squared_norm(F.col("vector"))).withColumn("version", F.lit(state.version + 1).cast("long")))
            self._state = replace(state, segments=(*state.segments, segment), slots=state.slots + found.n, version=state.version + 1)
        return self

    def add_with_progress(self, data, ids: Sequence[int], progress: Callable[[int, int], None], chunk: int = 10_000) -> VectorIndex:
        """add() in chunks; progress hears (rows so far, all rows) after each."""
        ids = list(ids)
        if len(set(ids)) != len(ids):
            raise error("Duplicate IDs", "an id comes twice")
        for start in range(0, len(ids), chunk):
            self.add(data[start : start + chunk], ids[start : start + chunk])
            progress(min(start + chunk, len(ids)), len(ids))
        return self

    def add_item(self, vector) -> int:
        """Appends one vector; its id is the number of slots so far."""
        with self._lock:
            i = self._state.slots
            self.add([vector], [i])
            return i

    def build(self) -> VectorIndex:
        """Nothing is to be built; added rows are searchable at once."""
        return self

    def set_metadata_schema(self, fields: dict[str, str]) -> None:
        with self._lock:
            if self._state.slots:
                raise error("Metadata Type Error", "the schema is set before rows are added")
            self._state = replace(self._state, schema=Schema(dict(fields)))

    # Rows

    def rows(self, state: State | None = None) -> DataFrame:
        """The valid rows: id, vector, pos, sq_norm, version and metadata."""
        state = state or self._state
        if not state.segments:
            fields = "".join(f", `{n}` {KINDS[k][0]}" for n, k in state.schema.fields.items())
            return self.spark.createDataFrame([], f"id long, vector array<float>{fields}, pos long, sq_norm double, version long")
        every = reduce(DataFrame.unionByName, state.segments)
        return every.join(reduce(DataFrame.unionByName, state.removed), ["pos", "version"], "left_anti") if state.removed else every

    def __len__(self) -> int:
        return self._state.slots - self._state.deleted

    capacity = property(lambda self: self._state.slots)
    deleted_count = property(lambda self: self._state.deleted)
    version = property(lambda self: self._state.version)
    schema = property(lambda self: self._state.schema)

    # Changes

    def _ids(self, ids) -> DataFrame:
        return ids.select(F.col(ids.columns[0]).alias("id")).distinct() if isinstance(ids, DataFrame) else self.spark.createDataFrame([(int(i),) for i in set(ids)], "id long")

    def remove(self, ids: Sequence[int] | DataFrame) -> int:
        """Removes rows by id and says how many there were; unknown ids are let pass."""
        with self._lock:
            state = self._state
            gone = stable(self.rows().join(self._ids(ids), "id", "left_semi").select("pos", "version"))
            n = gone.count()
            if n:
                self._state = replace(state, removed=(*state.removed, gone), deleted=state.deleted + n, version=state.version + 1)
            return n

    def update(self, id: int, vector) -> None:
        """Replaces a row's vector; position and metadata stay. An unknown id is an error."""
        matrix = np.asarray([vector], np.float32)
        if matrix.shape != (1, self.dim):
            raise error("Dimension Error", f"vectors must have {self.dim} numbers")
        with self._lock:
            state = self._state
            old = stable(self.rows().where(F.col("id") == int(id)))
            if old.isEmpty():
                raise error("Unknown ID", str(id))
            new = old.withColumn("vector", F.array(*[F.lit(float(x)) for x in matrix[0]]).cast("array<float>")).withColumn("sq_norm", squared_norm(F.col("vector")))
            new = stable(new.withColumn("version", F.lit(state.version + 1).cast("long")))
            self._state = replace(state, segments=(*state.segments, new), removed=(*state.removed, old.select("pos", "version")), version=state.version + 1)

    def compact(self) -> None:
        """Rewrites the valid rows as one segment, with positions without gaps in the same order."""
        with self._lock:
            state, n = self._state, len(self)
            again = with_positions(self.rows().withColumnRenamed("pos", "_old"), "_old").drop("_old")
            self._state = replace(state, segments=(stable(again),) if n else (), removed=(), slots=n, deleted=0, version=state.version + 1)

    def set_max_deleted_ratio(self, ratio: float) -> None:
        if not 0 <= ratio <= 1:
            raise error("Ratio Error", "the ratio must be from 0 to 1")
        self.max_deleted_ratio = ratio

    def should_compact(self) -> bool:
        return bool(self.capacity) and self.deleted_count / self.capacity > self.max_deleted_ratio

    # Search

    def _checked(self, n: int) -> State:
        state = self._state
        if state.slots == state.deleted:
            raise error("EmptyIndex", "the index has no rows")
        if n != self.dim:
            raise error("Dimension Error", f"a query has {n} numbers, the index {self.dim}")
        return state

    def _filtered(self, state: State, filter: Filter | str | None) -> DataFrame:
        rows = self.rows(state)
        if filter is None:
            return rows
        return (Filter.boolean(self._bits[filter]) if isinstance(filter, str) else filter).apply(rows)

    def search_table(self, q, k: int, filter: Filter | str | None = None, order: str = "id") -> DataFrame:
        """(id, dist) of the k nearest rows that the filter (or the named bit filter) lets through."""
        state = self._checked(len(q))
        return search.nearest(self._filtered(state, filter), q, k, self.metric, order)

    def search(self, q, k: int, filter: Filter | str | None = None, version: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the k nearest rows, k at most. With a version, the index must still have it."""
        began = time.perf_counter()
        if version is not None and version != self.version:
            raise error("ConcurrentModification", f"version {version} was asked for, {self.version} is there")
        found = self.search_table(q, k, filter).collect()
        if self._collector:
            self._collector.record_query((time.perf_counter() - began) * 1e6)
        return np.array([r.id for r in found], np.int64), np.array([r.dist for r in found], np.float64)

    def search_batch(self, queries, k: int, filter: Filter | str | None = None) -> DataFrame:
        """(q_id, rank, id, dist) for a matrix of queries, numbered from 0, or a table of (q_id, q)."""
        if isinstance(queries, DataFrame):
            wrong = queries.where(F.coalesce(F.size("q"), F.lit(-1)) != self.dim).first()
            state = self._checked(self.dim if wrong is None else len(wrong.q or []))
        else:
            matrix = np.asarray(queries, np.float32)
            state = self._checked(matrix.shape[1] if matrix.ndim == 2 else -1)
            queries = self.spark.createDataFrame([(i, q.tolist()) for i, q in enumerate(matrix)], "q_id long, q array<float>")
        began = time.perf_counter()
        out = search.nearest_batch(self._filtered(state, filter), queries, k, self.metric)
        if self._collector:
            # Monitored batches run here, so that their time is known, and count as one query each.
            out = stable(out)
            self._collector.record_query((time.perf_counter() - began) * 1e6)
        return out

    def search_filtered(self, q, k: int, predicate: str) -> tuple[np.ndarray, np.ndarray]:
        return self.search(q, k, Filter.predicate(predicate))

    def search_callback(self, q, k: int, accepts: Callable[[int], bool]) -> tuple[np.ndarray, np.ndarray]:
        return self.search(q, k, Filter.callback(accepts))

    def search_allowed(self, q, k: int, allowed_ids: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
        return self.search(q, k, Filter.id_set(allowed_ids))

    def search_positions(self, q, k: int) -> DataFrame:
        """(pos, dist) of the k nearest rows, by distance and then by position."""
        rows = self.rows(self._checked(len(q))).drop("id").withColumnRenamed("pos", "id")
        return search.nearest(rows, q, k, self.metric).withColumnRenamed("id", "pos")

    def update_boolean_filter(self, name: str, bits: Sequence[bool] | DataFrame) -> None:
        self._bits[name] = bits

    def get_boolean_filter(self, name: str):
        return self._bits.get(name)

    # What it holds

    def info(self) -> dict[str, str]:
        slots, n = self.capacity, len(self)
        memory = slots * 40 + 4 * self.dim * n + 4 * n  # an estimate: a slot, its vector and its norm
        return {"type": "exact", "dim": str(self.dim), "metric": str(self.metric), "size": str(n), "capacity": str(slots), "deleted": str(self.deleted_count), "version": str(self.version), "max_deleted_ratio": str(self.max_deleted_ratio), "memory_mb": f"{memory / 1e6:.2f}"}

    def validate(self) -> list[str]:
        """All that is wrong, as sentences; none if nothing is."""
        rows = self.rows()
        report = validate(rows, self.dim)
        return [f"{r.issue}: {r.n}" for r in report.where("n > 0").orderBy("issue").collect()]

    def __repr__(self) -> str:
        return f"VectorIndex(dim={self.dim}, metric={self.metric}, entries={self.capacity})"

    # Files

    def manifest(self) -> dict:
        return {"dim": self.dim, "metric": self.metric.name, "p": self.metric.p, "version": self.version, "schema": self.schema.fields, "ratio": self.max_deleted_ratio, "slots": self.capacity, "max_rows": self.max_rows}

    def save(self, path: str, root: str = "") -> None:
        """Into a folder, whose path must be a relative one inside the allowed folders."""
        storage.write(self.rows(), self.manifest(), checked(path, root))

    @classmethod
    def load(cls, spark: SparkSession, path: str, root: str = "") -> VectorIndex:
        rows, m = storage.read(spark, checked(path, root))
        out = cls(spark, m["dim"], Metric(m["metric"], m["p"]), max_rows=m["max_rows"])
        n = rows.count()
        out._state = State((rows,) if n else (), (), m["slots"], m["slots"] - n, m["version"], Schema(m["schema"]))
        out.max_deleted_ratio = m["ratio"]
        return out

    # Monitoring

    def enable_metrics(self, port: int | None = None) -> Collector:
        self._collector = Collector(self.dim, str(self.metric), lambda: len(self), port)
        return self._collector

    def metrics(self) -> dict:
        return self._collector.snapshot() if self._collector else {}

    def update_recall_estimate(self, k: int, recall: float) -> None:
        if self._collector:
            self._collector.update_recall(k, recall)


def repeated_ids(rows: DataFrame) -> DataFrame:
    """(id, n) of ids that come more than once; add() refuses tables that have any."""
    return rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


def validate(rows: DataFrame, dim: int) -> DataFrame:
    """(issue, n): duplicate ids, wrong dimensions and wrong norms, all of them, in one table."""
    off = F.abs(squared_norm(F.col("vector")) - F.col("sq_norm")) > NORM_TOLERANCE * F.greatest(F.lit(1.0), F.col("sq_norm"))
    twice = repeated_ids(rows).agg(F.count("*").alias("n")).select(F.lit("duplicate ids").alias("issue"), "n")
    others = rows.agg(F.coalesce(F.sum((F.size("vector") != dim).cast("long")), F.lit(0)).alias("dims"), F.coalesce(F.sum(off.cast("long")), F.lit(0)).alias("norms"))
    return twice.unionByName(others.select(F.expr("stack(2, 'wrong dimensions', dims, 'wrong norms', norms) as (issue, n)")))


class ThreadSafeIndex:
    """An index whose calls go one after another. Searches without a filter."""

    def __init__(self, *args, **options) -> None:
        self._index, self._lock = VectorIndex(*args, **options), threading.RLock()

    def __getattr__(self, name: str):
        if name not in {"add", "remove", "update", "compact", "version", "search", "search_batch", "save"}:
            raise AttributeError(name)
        with self._lock:
            found = getattr(self._index, name)
        if not callable(found):
            return found

        def call(*args, **options):
            with self._lock:
                return found(*args, **options)

        return call

    @classmethod
    def load(cls, spark: SparkSession, path: str, root: str = "") -> ThreadSafeIndex:
        out = cls.__new__(cls)
        out._index, out._lock = VectorIndex.load(spark, path, root), threading.RLock()
        return out
