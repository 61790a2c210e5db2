"""The folder that driver and executors share, and tables without their lineage in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, or that setCheckpointDir was given; one on this machine only in local mode."""
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not current.isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(folder or f"{tempfile.gettempdir()}/checkpoints")
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
    return current.get()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df without its lineage, through a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
