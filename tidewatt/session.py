"""What a Spark session needs to run this library's Python functions."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers, once per application, unless their path has it anyway."""
    root, sc = Path(__file__).resolve().parents[1], spark.sparkContext
    if sc.applicationId in _shipped or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    folder = tempfile.mkdtemp(prefix="tidewatt-")
    atexit.register(shutil.rmtree, folder, True)
    package = Path(folder, "package", "tidewatt")
    shutil.copytree(root / "tidewatt", package, ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(f"{folder}/tidewatt", "zip", package.parent))
    _shipped.add(sc.applicationId)
