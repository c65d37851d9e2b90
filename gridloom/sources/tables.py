"""Parquet tables of one data folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, which ``spark.checkpoint.dir`` names.

    Where nothing is set, a session with a local master gets a new temporary
    folder; on a cluster that is an error, as each machine would write to its
    own disk.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = getattr(spark.sparkContext, "_gridloom_folder", None) or tempfile.mkdtemp(prefix="gridloom-")
        spark.sparkContext._gridloom_folder = folder
    return folder


def checkpoint(df: DataFrame, spark: SparkSession) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores.

    For costly steps over a plain scan of few files or row groups.  A scan
    with enough partitions is left alone, so only small inputs are shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    have = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df.repartition(cores) if have < cores else df
