"""Gapless positions without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.plans.stable import stable


def with_positions(df: DataFrame, order: str, name: str = "pos", first: int = 0) -> DataFrame:
    """Adds 0, 1, 2 ... in order of a column, from `first` on: range partitions, their counts, and a count within each."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stable(df.repartitionByRange(tasks, order).withColumn("_part", F.spark_partition_id()))
    counts = dealt.groupBy("_part").count()  # a row for each partition
    before = F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_part", before.alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    return dealt.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + inside - 1 + F.lit(first)).drop("_part", "_start")
