"""Where queries and operators put what they write."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_LOCAL: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """A fresh path in the folder that the session names in spark.checkpoint.dir. Where that is unset, as in tests, in a temporary folder of this machine, for a local session only: on a cluster executors couldn't read it, so there it raises."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        root = _LOCAL[app] = _LOCAL.get(app) or "file://" + tempfile.mkdtemp(prefix="kairospark-")
    return f"{root.rstrip('/')}/kairospark-{uuid.uuid4().hex}"
