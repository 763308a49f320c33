"""Comparisons of benchmark records, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def regressions(records: DataFrame, stats: list[str], threshold: float = 0.25) -> DataFrame:
    """(dataset, stat, before, now, change, worse): the last record of each dataset against the one before, by `ts`."""
    long = records.select("dataset", "ts", F.expr(f"stack({len(stats)}, {', '.join(f"'{s}', cast({s} as double)" for s in stats)}) as (stat, now)"))
    order = Window.partitionBy("dataset", "stat").orderBy("ts")
    back = Window.partitionBy("dataset", "stat").orderBy(F.desc("ts"))
    last = long.withColumn("before", F.lag("now").over(order)).withColumn("n", F.row_number().over(back)).where("n = 1 and before is not null")
    change = F.try_divide(F.col("now") - F.col("before"), F.col("before"))
    return last.select("dataset", "stat", "before", "now", change.alias("change"), (F.coalesce(change, F.lit(0.0)) > threshold).alias("worse"))


def compare(old: DataFrame, new: DataFrame, threshold: float = 0.2, ignored: tuple[str, ...] = ()) -> DataFrame:
    """(path, old, new, change, worse) for two tables of (path, value); for paths ending in `speedup`, less is worse."""
    both = old.select("path", F.col("value").alias("old")).join(new.select("path", F.col("value").alias("new")), "path")
    both = both.where(~F.col("path").isin(list(ignored))) if ignored else both
    change = F.try_divide(F.col("new") - F.col("old"), F.abs("old"))
    worse = F.when(F.col("path").endswith("speedup"), change < -threshold).otherwise(change > threshold)
    return both.select("path", "old", "new", change.alias("change"), F.coalesce(worse, F.lit(False)).alias("worse"))


def recall_at_k(exact: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """(q_id, recall): the share of the exact k nearest that a search found."""
    truth = exact.where(F.col("rank") <= k).select("q_id", "id")
    hit = found.where(F.col("rank") <= k).select("q_id", "id").withColumn("hit", F.lit(1))
    return truth.join(hit, ["q_id", "id"], "left").groupBy("q_id").agg((F.count("hit") / F.count("*")).alias("recall"))


def dashboard(records: DataFrame, stats: list[str]) -> DataFrame:
    """(dataset, records, and the mean of each figure): one row for each dataset."""
    return records.groupBy("dataset").agg(F.count("*").alias("records"), *(F.avg(s).alias(s) for s in stats))


def timings(exact_ms: float, approximate_ms: float, recall: float) -> dict:
    """An exact and an approximate search side by side: times, how much faster the approximate one is, and what it finds."""
    return {"exact_ms": exact_ms, "approximate_ms": approximate_ms, "speedup": exact_ms / approximate_ms if approximate_ms else float("inf"), "recall": recall}
