"""Contiguous shards of nearly equal bytes, with DataFrame operations only.

Sizes are put in range partitions by id; each partition's total is known from one aggregation, a running sum
over those few totals gives each partition's start, and a running sum within the partition gives each row's. The
line of bytes is then cut at equal targets. Only ids, sizes and checksums are shuffled, never texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm.common import partitions, stable


def assign(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot, start): size is the text's UTF-8 bytes plus 1, start the bytes before
    the row, shard the cut in which the row's middle lies and slot its place in the shard from 0.

    Rows are in order of id (null first), then checksum, then size; rows equal in all three are alike, so which of them is first
    doesn't matter. A null text has no bytes and checksum 0. An empty table gives no rows. As sizes are positive,
    a shard is empty only if a single row is larger than a target or there are fewer rows than shards.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + F.lit(1).cast("long")).alias("size"), F.crc32(text.cast("binary")).alias("crc"))
    # The last key splits a group of equal rows over partitions.
    order = ["id", "crc", "size", "tie"]
    dealt = keys.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(partitions(docs.sparkSession), *order)
    dealt = stable(dealt.withColumn("part", F.spark_partition_id()))
    totals = dealt.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))  # a row per partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(every).alias("all_bytes"),
    )
    inside = Window.partitionBy("part").orderBy(*order)
    placed = (
        dealt.join(F.broadcast(starts), "part")
        .withColumn("start", F.col("bytes_before") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .withColumn("place", F.col("rows_before") + F.row_number().over(inside) - 1)
        .withColumn("shard", F.expr(f"cast(((2 * start + size) * {shards}) div (2 * all_bytes) as int)"))
    )
    placed = stable(placed.select("id", "size", "crc", "shard", "place", "start"))
    firsts = placed.groupBy("shard").agg(F.min("place").alias("first"))  # a row per shard
    return placed.join(F.broadcast(firsts), "shard").select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("place") - F.col("first")).alias("slot"), "start"
    )


def write(docs: DataFrame, path: str, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the rows with all their columns below `path`, a folder `shard=n` for each shard. Ids must be unique here."""
    placed = assign(docs, shards, id_col, text_col).select(id_col, "shard")
    docs.join(placed, id_col).write.partitionBy("shard").parquet(path)
