"""Sends this package to the executors, for sessions whose Python workers don't find it by themselves."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def shipped(spark: SparkSession) -> SparkSession:
    """Adds a zip of the package to the session's Python files, once for each application."""
    app = spark.sparkContext.applicationId
    if app not in _SENT:
        here = Path(__file__).resolve().parent
        path = Path(tempfile.mkdtemp(prefix="kairospark-code-")) / "kairospark.zip"
        with zipfile.ZipFile(path, "w") as out:
            for p in sorted(here.rglob("*.py")):
                out.write(p, p.relative_to(here.parent))
        spark.sparkContext.addPyFile(str(path))
        _SENT.add(app)
    return spark
