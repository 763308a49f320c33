"""Streams of vectors: appended to an index batch by batch, or matched with one as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from nearfield.functions.distances import Metric
from nearfield.operators.index import VectorIndex
from nearfield.operators.search import nearest_batch


def add_stream(stream: DataFrame, index: VectorIndex, checkpoint: str, **trigger) -> StreamingQuery:
    """Appends each micro-batch of (id, vector, ...). A batch that comes again after a failure adds only the ids that aren't there."""

    def append(batch: DataFrame, _: int) -> None:
        index.add(batch.join(index.rows().select("id"), "id", "left_anti").dropDuplicates(["id"]))

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def search_stream(queries: DataFrame, index: VectorIndex, k: int, path: str, checkpoint: str, m: str | Metric | None = None, **trigger) -> StreamingQuery:
    """Writes the k nearest of each micro-batch of (q_id, q) to Parquet, a folder for each batch, replaced if it comes again."""

    def match(batch: DataFrame, n: int) -> None:
        nearest_batch(index.rows(), batch, k, m or index.metric).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return queries.writeStream.foreachBatch(match).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def latency_windows(log: DataFrame, ts: str, latency: str, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Count and mean of latencies by tumbling window, on a stream or a table; later events than `late` are let go."""
    return log.withWatermark(ts, late).groupBy(F.window(ts, width)).agg(F.count("*").alias("n"), F.avg(latency).alias("mean")).select(F.col("window.start").alias("start"), "n", "mean")
