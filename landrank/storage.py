"""Where lineage is cut: the checkpoint folder that the cluster names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _prepared(spark: SparkSession):
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="landrank-"))
    return context


def durable(df: DataFrame) -> DataFrame:
    """df checkpointed to spark.checkpoint.dir, which all executors share; to a folder of our own only where it is unset and all
    tasks run here."""
    _prepared(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's name beside the checkpoints, where all executors can write."""
    return f"{_prepared(spark).getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex}"
