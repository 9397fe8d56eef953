"""The package on the workers, wherever the driver was started from."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession, *modules: str) -> SparkSession:
    """Send this package (and ``modules``, files beside it) to the executors, once per application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return spark
    package = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(package)
    # Executors fetch the archive from here as they start, so it stays until the driver ends.
    folder = tempfile.mkdtemp(prefix="strideframe-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, "strideframe.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for where, _, names in os.walk(package):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(where, name)
                out.write(path, os.path.relpath(path, root))
        for name in modules:
            if os.path.isfile(path := os.path.join(root, name)):
                out.write(path, name)
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)
    return spark
