"""Lets the Python workers of a local session find this package, wherever the session was started.

On a cluster the package comes with --py-files or is installed; nothing is written there.
"""

from __future__ import annotations

import os
import re
import shutil
import tempfile

from pyspark.sql import SparkSession

import nearfield


def ship(spark: SparkSession) -> None:
    """Once for each context."""
    sc = spark.sparkContext
    if getattr(sc, "_nearfield_shipped", False) or not re.match(r"local(\[|$)", sc.master):
        return
    package = os.path.dirname(os.path.realpath(nearfield.__file__))
    base = os.path.join(os.path.realpath(tempfile.mkdtemp()), "nearfield_package")
    sc.addPyFile(shutil.make_archive(base, "zip", os.path.dirname(package), os.path.basename(package)))
    sc._nearfield_shipped = True
