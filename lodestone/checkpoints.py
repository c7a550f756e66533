"""Where lineage is cut: files in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir where it is set. Where it is not, a temporary folder serves in local mode only, as in tests: on a
    cluster the driver's disk is no place that executors can read."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context.getCheckpointDir()


def fresh_folder(spark: SparkSession) -> str:
    """A folder of its own in the shared one, for files that a query writes and reads again."""
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` as files in the shared folder, so that a lost executor loses nothing of it."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
