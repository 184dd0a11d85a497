"""A folder for tables that live as long as a query, on the storage that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

SETTING = "spark.checkpoint.dir"


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one ``spark.checkpoint.dir`` names. Only a local session may do without that setting."""
    shared = spark.conf.get(SETTING, None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {SETTING} to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="lorekeep-")
        spark.conf.set(SETTING, shared)
    return f"{shared.rstrip('/')}/lorekeep/{name}-{uuid.uuid4().hex}"
