"""Exact nearest neighbours: one query, a batch, shards and all pairs.

One query is a projection, a sort and a limit, which Spark runs as a top-k per partition and one merge. A batch of
bounded size is sent to all tasks and goes over the table in Arrow blocks: each task keeps the k best rows of each query, so
what is shuffled is k rows for each query and task, whatever the table's size. A larger batch meets the table in a grid of
blocks of queries and chunks of rows, both of bounded size, and never passes the driver.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.errors import error
from nearfield.functions.distances import Metric, block_distance, distance, metric
from nearfield.functions.registry import resolve

#: Numbers in a block of queries or rows (64 MB as doubles): what is sent to all tasks at most, and what a cell of the grid holds of either.
QUERY_BLOCK = 8_000_000
#: Rows whose distances from a query are worked out at once.
BLOCK_ROWS = 500


def vector_literal(q) -> Column:
    return F.array(*[F.lit(float(x)) for x in q])


def nearest(corpus: DataFrame, q, k: int, m: str | Metric = "euclidean", order: str = "id") -> DataFrame:
    """(id, dist) of the k rows nearest to one vector, by distance and then by id; NaN comes last."""
    found = corpus.select("id", *([order] if order != "id" else []), distance(m, F.col("vector"), vector_literal(q)).alias("dist"))
    return found.orderBy(F.asc_nulls_last("dist"), order).limit(max(0, k)).select("id", "dist")


def nearest_by_expression(corpus: DataFrame, queries: DataFrame, k: int, m: str | Metric = "euclidean") -> DataFrame:
    """(q_id, rank, id, dist) within Catalyst, for few queries, as their table is sent to all tasks: more numbers than QUERY_BLOCK are an error."""
    if batch_size(queries)[0] > QUERY_BLOCK:
        raise error("Row Limit", "too many queries to send to all tasks; nearest_batch takes any number")
    pairs = corpus.select("id", "vector").join(F.broadcast(queries.select("q_id", "q")), F.lit(True)).select("q_id", "id", distance(m, F.col("vector"), F.col("q")).alias("dist"))
    return ranked(pairs, k)


def ranked(pairs: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("q_id").orderBy(F.asc_nulls_last("dist"), "id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("q_id", F.col("rank").cast("int").alias("rank"), "id", "dist")


def nearest_batch(corpus: DataFrame, queries: DataFrame, k: int, m: str | Metric = "euclidean") -> DataFrame:
    """(q_id, rank, id, dist) for each query row (q_id, q), k rows at most for each."""
    m = metric(m)
    if m.is_custom:
        name, custom = resolve(m.name)
        m = Metric(name)
    else:
        custom = None
    numbers, dim = batch_size(queries)
    rows, schema = corpus.select("id", "vector").where("vector is not null"), "q_id long, id long, dist double"
    if numbers <= QUERY_BLOCK:
        sent = corpus.sparkSession.sparkContext.broadcast(block_of(queries))
        return ranked(rows.mapInArrow(functools.partial(_best, sent, k, m, custom), schema), k)
    blocks, chunks = -(-numbers // QUERY_BLOCK), max(1, -(-rows.count() * dim // QUERY_BLOCK))
    left = rows.select("id", "vector", F.pmod(F.xxhash64("id", "vector"), F.lit(chunks)).alias("chunk"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    right = queries.where("q is not null").select("q_id", "q", F.explode(F.expr(f"sequence(0L, {chunks - 1}L)")).alias("chunk"), F.pmod(F.xxhash64("q_id"), F.lit(blocks)).cast("int").alias("block"))

    def cell(some: pa.Table, asked: pa.Table) -> pa.Table:
        found = Best(asked.column("q_id").to_numpy(), k)
        matrix = vectors(asked.column("q").combine_chunks())
        for batch in some.to_batches():
            found.look(m, custom, batch.column("id").to_numpy(), vectors(batch.column("vector"), matrix.shape[1]), matrix)
        return pa.Table.from_batches([found.batch()])

    return ranked(left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInArrow(cell, schema), k)


def batch_size(queries: DataFrame) -> tuple[int, int]:
    """Numbers in all queries, and in one. Queries of unlike lengths are an error."""
    n = queries.agg(F.count("q").alias("n"), F.min(F.size("q")).alias("least"), F.max(F.size("q")).alias("most")).first()
    if n.n and n.least != n.most:
        raise error("Dimension Error", f"queries have from {n.least} to {n.most} numbers")
    return n.n * (n.most or 0), n.most or 0


def block_of(queries: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The ids and the matrix of queries whose number of numbers has been checked."""
    table = queries.select("q_id", "q").where("q is not null").toArrow()
    if not table.num_rows:
        return np.zeros(0, np.int64), np.zeros((0, 0))
    return table.column("q_id").cast(pa.int64()).to_numpy(), vectors(table.column("q").combine_chunks())


def query_blocks(queries: DataFrame):
    """The queries in blocks of bounded size, dealt by a hash, a job for each block; those of one block at once."""
    numbers, _ = batch_size(queries)
    blocks = max(1, -(-numbers // QUERY_BLOCK))
    for block in range(blocks):
        q_ids, matrix = block_of(queries.where(F.pmod(F.xxhash64("q_id"), F.lit(blocks)) == block) if blocks > 1 else queries)
        if len(q_ids):
            yield q_ids, matrix


def vectors(column: pa.Array, dim: int | None = None) -> np.ndarray:
    """A list column without null lists as a matrix of doubles; a null number is NaN. Lists of unlike lengths, or of others than dim, are an error."""
    n = len(column)
    if not n:
        return np.zeros((0, dim or 0))
    flat = column.flatten()
    width = len(flat) // n if dim is None else dim
    if len(flat) != n * width or (np.diff(column.offsets.to_numpy()) != width).any():
        raise error("Dimension Error", f"vectors don't all have {width} numbers")
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, width)


class Best:
    """The k best rows so far of each query; ties go by id, NaN comes last. A place that isn't filled has NaN and the largest id."""

    EMPTY = np.iinfo(np.int64).max

    def __init__(self, q_ids: np.ndarray, k: int) -> None:
        self.q_ids, self.k, n = q_ids, max(0, k), len(q_ids)
        self.ids, self.dist = np.full((n, self.k), self.EMPTY), np.full((n, self.k), np.nan)

    def add(self, q: int, ids: np.ndarray, dist: np.ndarray) -> None:
        """Rows for one query."""
        if not self.k:
            return
        if not np.isnan(self.dist[q, -1]):
            keep = ~(dist > self.dist[q, -1])
            ids, dist = ids[keep], dist[keep]
        if len(ids) > 4 * self.k + 16:
            keep = ~(dist > np.partition(dist, self.k - 1)[self.k - 1])
            ids, dist = ids[keep], dist[keep]
        self._merge(slice(q, q + 1), ids[None, :], dist[None, :])

    def _merge(self, some, ids: np.ndarray, dist: np.ndarray) -> None:
        ids, dist = np.concatenate([self.ids[some], ids], axis=1), np.concatenate([self.dist[some], dist], axis=1)
        order = np.lexsort((ids, dist), axis=-1)[:, : self.k]  # NaN sorts last
        self.ids[some], self.dist[some] = np.take_along_axis(ids, order, axis=1), np.take_along_axis(dist, order, axis=1)

    def look(self, m: Metric, custom, ids: np.ndarray, rows: np.ndarray, matrix: np.ndarray) -> None:
        """All rows for all queries."""
        if not len(ids) or not self.k or not len(matrix):
            return
        if m.name not in ("euclidean", "sqeuclidean", "cosine") or custom or np.isnan(rows).any() or np.isnan(matrix).any():
            # In parts that fit a core's cache, by columns, as distances are added up; a function that takes each row by itself has them as they are.
            step = BLOCK_ROWS if not custom or custom.block else len(ids)
            for start in range(0, len(ids), step):
                part, some = ids[start : start + step], rows[start : start + step]
                some = np.asfortranarray(some) if not custom or custom.block else some
                for i, q in enumerate(matrix):
                    self.add(i, part, block_distance(m, some, q, custom))
            return
        squares, width = (rows * rows).sum(axis=1), min(len(ids), self.k + 16)
        step = max(1, min(256, 4_000_000 // (width * max(1, rows.shape[1])), 8_000_000 // len(ids)))
        for start in range(0, len(matrix), step):
            self._look(m, ids, rows, squares, matrix[start : start + step], np.arange(start, min(start + step, len(matrix))), width)

    def _look(self, m: Metric, ids: np.ndarray, rows: np.ndarray, squares: np.ndarray, asked: np.ndarray, at: np.ndarray, width: int) -> None:
        """One product of matrices tells which rows can be among the k best; only those get exact distances."""
        norms = (asked * asked).sum(axis=1)
        rough = asked @ rows.T
        if m.name == "cosine":
            size = np.sqrt(norms[:, None] * squares[None, :])
            rough = np.where(size == 0, 1.0, 1 - rough / np.where(size == 0, 1, size))
        else:
            rough *= -2
            rough += norms[:, None]
            rough += squares[None, :]
        slack = 1e-9 * (1 + norms + squares.max())
        bound = self.dist[at, -1] ** 2 if m.name == "euclidean" else self.dist[at, -1]
        with np.errstate(invalid="ignore"):
            busy = np.flatnonzero(~(rough.min(axis=1) > bound + slack))
        if not len(busy):
            return
        rough, asked, at, slack = rough[busy], asked[busy], at[busy], slack[busy]
        if width < len(ids):
            near = np.argpartition(rough, width - 1, axis=1)[:, :width]
            of = np.take_along_axis(rough, near, axis=1)
            # More rows than these may be among the best only where ties or rounding reach past them.
            last = np.partition(of, self.k - 1, axis=1)[:, self.k - 1]
            unsure = of.max(axis=1) <= last + 2 * slack
        else:
            near, unsure = np.broadcast_to(np.arange(len(ids)), (len(busy), len(ids))), np.zeros(len(busy), bool)
        for j in np.flatnonzero(unsure):
            some = np.flatnonzero(rough[j] <= last[j] + 2 * slack[j])
            self.add(int(at[j]), ids[some], block_distance(m, rows[some], asked[j]))
        sure = ~unsure
        if sure.any():
            found = rows[near[sure]]
            self._merge(at[sure], ids[near[sure]], block_distance(m, found.reshape(-1, rows.shape[1]), np.repeat(asked[sure], near.shape[1], axis=0)).reshape(found.shape[:2]))

    def batch(self) -> pa.RecordBatch:
        q, place = np.nonzero(self.ids != self.EMPTY)
        return pa.RecordBatch.from_arrays([pa.array(self.q_ids[q], pa.int64()), pa.array(self.ids[q, place]), pa.array(self.dist[q, place], from_pandas=False)], ["q_id", "id", "dist"])


def _best(sent, k: int, m: Metric, custom, batches):
    q_ids, matrix = sent.value
    best = Best(q_ids, k)
    for batch in batches:
        best.look(m, custom, batch.column(0).to_numpy(), vectors(batch.column(1), matrix.shape[1] if len(matrix) else None), matrix)
    yield best.batch()


def pairwise(queries: DataFrame, corpus: DataFrame, m: str | Metric = "euclidean") -> DataFrame:
    """(q_id, id, dist) of each query and each row: as many rows as both have, multiplied."""
    m = metric(m)
    blocks = []
    for ids, matrix in query_blocks(queries):
        sent = corpus.sparkSession.sparkContext.broadcast((ids, matrix))

        def each(batches, sent=sent):
            q_ids, qs = sent.value
            for batch in batches:
                rows = vectors(batch.column(1))
                for i, q in zip(q_ids, qs):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), i)), batch.column(0), pa.array(block_distance(m, rows, q))], ["q_id", "id", "dist"])

        blocks.append(corpus.select("id", "vector").mapInArrow(each, "q_id long, id long, dist double"))
    return functools.reduce(DataFrame.unionByName, blocks) if blocks else corpus.sparkSession.createDataFrame([], "q_id long, id long, dist double")


def shards(corpus: DataFrame, n: int) -> DataFrame:
    """Adds `shard`: contiguous and equal runs of positions, what is left over in the last."""
    total = corpus.count()
    size = max(1, total // max(1, n))
    return corpus.withColumn("shard", F.least(F.floor(F.col("pos") / size), F.lit(n - 1)).cast("int"))


def nearest_sharded(corpus: DataFrame, queries: DataFrame, k: int, n: int, m: str | Metric = "euclidean") -> DataFrame:
    """As nearest_batch, by way of the k best of each shard. A shard is a run of positions wherever its rows lie: each task keeps the
    k best of each query and shard that it meets, so no vector moves; then shards are merged."""
    m = metric(m)
    numbers, _ = batch_size(queries)
    if m.is_custom or numbers > QUERY_BLOCK:
        return nearest_batch(shards(corpus, n), queries, k, m)
    sent = corpus.sparkSession.sparkContext.broadcast(block_of(queries))

    def each(batches):
        q_ids, matrix = sent.value
        best: dict[int, Best] = {}
        for batch in batches:
            ids, rows, shard = batch.column(0).to_numpy(), vectors(batch.column(1), matrix.shape[1] if len(matrix) else None), batch.column(2).to_numpy()
            for x in np.unique(shard).tolist():
                at = np.flatnonzero(shard == x)
                best.setdefault(x, Best(q_ids, k)).look(m, None, ids[at], rows[at], matrix)
        for x, found in best.items():
            out = found.batch()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(out.num_rows, x, np.int32)), *out.columns], ["shard", "q_id", "id", "dist"])

    placed = shards(corpus, n).select("id", "vector", "shard").where("vector is not null")
    found = placed.mapInArrow(each, "shard int, q_id long, id long, dist double")
    rank = F.row_number().over(Window.partitionBy("shard", "q_id").orderBy(F.asc_nulls_last("dist"), "id"))
    return ranked(found.withColumn("rank", rank).where(F.col("rank") <= k).select("q_id", "id", "dist"), k)
