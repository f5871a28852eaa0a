"""Reliable lineage cuts that survive the loss of an executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; a temporary one only where the setting is absent."""
    jsc = spark.sparkContext._jsc.sc()
    known = jsc.getCheckpointDir()
    if known.isDefined():
        return known.get()
    shared = spark.conf.get("spark.checkpoint.dir", None)
    folder = shared or tempfile.mkdtemp(prefix="ragloom-checkpoint-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder of its own in the checkpoint folder, which all executors see."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Write df to the checkpoint folder and continue from the written copy."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
