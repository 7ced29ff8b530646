"""Making the package importable for the Python workers of a session."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's source files to the session's executors, once per application.

    Spark's own file server hands the archive to the executors, so nothing has to be installed there.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    path = os.path.join(tempfile.mkdtemp(prefix="feedloom-"), "feedloom.zip")
    Path(path).write_bytes(data.getvalue())
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)
