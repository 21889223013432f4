"""Making this package known to the Python workers of a cluster."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once for a Spark context.

    Python functions are sent by the name of their module, so a worker that can't import the package can't run them.  The
    archive is handed over by the driver and needs no folder that the machines share.
    """
    context = spark.sparkContext
    if getattr(context, "_terrafold_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="terrafold-package-"), "terrafold.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(package):
            for n in sorted(names):
                if n.endswith(".py"):
                    z.write(os.path.join(folder, n), os.path.relpath(os.path.join(folder, n), os.path.dirname(package)))
    context.addPyFile(path)
    context._terrafold_shipped = True
