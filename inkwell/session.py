"""Sessions, and sending this package to executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to all executors, once a session.

    Functions of the package are pickled by reference, so workers import it; the
    archive goes through Spark's own file server.
    """
    sc = spark.sparkContext
    if getattr(sc, "_inkwell_shipped", False):
        return spark
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(), "inkwell.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(here)))
    sc.addPyFile(path)
    sc._inkwell_shipped = True
    return spark
