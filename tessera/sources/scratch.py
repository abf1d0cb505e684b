"""A folder that driver and executors share, for tables written on the way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``; in local mode, where none is named, under a
    temporary folder.  Elsewhere executors could not see that, and the call is refused."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        top = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return f"{top.rstrip('/')}/tessera/{name}-{uuid.uuid4().hex}"
