"""Cutting lineage where a result is read more than once or its partitions must stay as they are."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of ``df``.

    The folder is the one the session names in ``spark.checkpoint.dir``. Only a session whose executors
    all run on this machine, as in tests, may leave it unset and gets a folder of it; on a cluster, whose
    executors could not read one, that is an error. Each partition becomes one file, and rows keep their
    partition and their order within it.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", "")
        if not folder:
            if not sc.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="rankloom-")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Has the shuffle files and checkpoints that nothing refers to any more removed now; else they stay until the driver happens to collect its garbage."""
    spark.range(1).collect()  # the session refers to its last execution until another one ends
    gc.collect()
    spark._jvm.System.gc()
