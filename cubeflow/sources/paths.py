"""Where intermediate datasets go: a folder that all machines share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def work_path(spark: SparkSession, kind: str) -> str:
    """A new path in spark.checkpoint.dir, or in a folder of our own where that is unset and all run in this process (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='cubeflow-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{kind}-{uuid.uuid4().hex}"
