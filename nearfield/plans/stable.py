"""Copies of tables in the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

from nearfield.errors import error


def shared_folder(spark: SparkSession) -> str:
    """The cluster names it in spark.checkpoint.dir; only where it doesn't and the session is a local one, as in tests, one is made here."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local[") and sc.master != "local":
            raise error("Path Error", "spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get()


def stable(df: DataFrame) -> DataFrame:
    """A copy in the shared folder, so that a lost executor or a second reader sees the same rows."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
