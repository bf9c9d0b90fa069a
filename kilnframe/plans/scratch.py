"""Cutting lineage in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> None:
    """Uses spark.checkpoint.dir; sets a folder of our own only where that is unset, none was set before, and no executor is
    on another machine. Such a folder goes when the driver exits."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isEmpty():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="kilnframe-checkpoints-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        shared = "file://" + own
    sc.setCheckpointDir(shared)


def cut(df: DataFrame) -> DataFrame:
    """df, computed and kept in reliable storage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
