"""A new folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """URI of a folder below ``spark.checkpoint.dir`` that is not there yet; without that setting a temporary one, on a local master only."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = os.path.join(tempfile.gettempdir(), "checkpoints", spark.sparkContext.applicationId)
    if "://" not in root and not root.startswith("file:"):
        root = f"file://{os.path.abspath(root)}"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
