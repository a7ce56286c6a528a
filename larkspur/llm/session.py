"""Settings that the jobs take from the session."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The address of the folder that the driver and all executors share."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        raise ValueError("spark.checkpoint.dir names no shared folder")
    return folder.rstrip("/")


def cut(df: DataFrame, free: bool = False) -> DataFrame:
    """df computed and written to the shared checkpoint folder, so that a lost executor does not bring back its whole past. With free, shuffles and checkpoints that only earlier frames used are deleted first."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            raise ValueError("spark.checkpoint.dir names no shared folder")
        sc.setCheckpointDir(folder)
    if free:
        gc.collect()
        sc._jvm.System.gc()  # Spark deletes what belongs to frames that nothing refers to any more, but only when the driver's memory is collected
    return df.checkpoint()


def buckets(docs: DataFrame) -> int:
    """Into how many groups packed rows of docs are dealt: as many as the session's shuffle partitions, and twice the parts that docs is read in, so that a group stays small whatever the input."""
    return max(16, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * docs.rdd.getNumPartitions())
