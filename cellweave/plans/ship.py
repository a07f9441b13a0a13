"""This package on the executors, wherever the driver was started."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package's sources to the application's Python files, once.

    Python workers import what a function's module needs by name; they may run on
    other machines, or from another folder than the driver.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    top = Path(__file__).resolve().parent.parent
    if top.is_dir():  # else it runs from such a file already
        folder = tempfile.mkdtemp(prefix="cellweave-ship-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = f"{folder}/cellweave_sources.zip"
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
            for source in sorted(top.rglob("*.py")):
                out.write(source, source.relative_to(top.parent))
        sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)
