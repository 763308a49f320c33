"""An index as a folder: Parquet rows and a manifest, written last, that makes them valid."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from nearfield.errors import error


def write(rows: DataFrame, manifest: dict, path: str, partition_by: str | None = None) -> None:
    """Rows go to a new folder below `path`; the manifest that names it is added only when they are complete, so a
    reader sees the last complete state, and an old one can be read on meanwhile."""
    folder = f"rows-{uuid.uuid4().hex}"
    try:
        writer = rows.write
        if partition_by:
            writer = writer.partitionBy(partition_by)
        writer.parquet(f"{path}/{folder}")
        line = json.dumps(manifest | {"folder": folder, "written": _next(rows.sparkSession, path)})
        rows.sparkSession.createDataFrame([(line,)], "value string").coalesce(1).write.mode("append").text(f"{path}/manifest")
    except Exception as e:
        raise error("IO Error", f"Failed to write {path}: {type(e).__name__}") from e


def _manifests(spark: SparkSession, path: str) -> list[dict]:
    return [json.loads(r.value) for r in spark.read.text(f"{path}/manifest").collect()]


def _next(spark: SparkSession, path: str) -> int:
    try:
        return 1 + max((m["written"] for m in _manifests(spark, path)), default=0)
    except Exception:  # noqa: BLE001  no manifest yet
        return 1


def read(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    try:
        manifest = max(_manifests(spark, path), key=lambda m: m["written"])
        return spark.read.parquet(f"{path}/{manifest['folder']}"), manifest
    except Exception as e:
        raise error("IO Error", f"Failed to open file {path}: {type(e).__name__}") from e
