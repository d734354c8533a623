"""The folder for checkpoints that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def checkpoints(spark: SparkSession) -> str:
    """spark.checkpoint.dir, put to use. Where it is unset, local mode gets a new folder; a cluster gets an error."""
    context = spark.sparkContext
    at = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="recordspark-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(at)
    return at
