"""Folders for what queries write and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder in the one that the cluster shares; a local one only where none is set and all runs in one process, as in tests."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("a cluster needs spark.checkpoint.dir, a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="factloom-")
    return f"{shared.rstrip('/')}/facts-{uuid.uuid4().hex}"
