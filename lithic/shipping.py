"""Make this package importable in Python workers, wherever the session's executors run."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package's source to the session's Python files, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    here = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="lithic-"), "lithic.zip")
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted(here.rglob("*.py")):
            out.write(path, path.relative_to(here.parent))
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)
