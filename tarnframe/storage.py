"""A folder that the driver and all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

LOCAL_FOLDER = "/tmp/checkpoints/tarnframe"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the cluster's ``spark.checkpoint.dir``; only local sessions may lack one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = LOCAL_FOLDER
    return f"{folder}/{name}-{uuid.uuid4()}"
