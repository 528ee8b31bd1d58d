"""Folders for tables in between, in the place that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir; under a temporary folder only where it is unset and everything is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tabloom-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found}/{name}-{uuid.uuid4().hex}"
