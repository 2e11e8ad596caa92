"""The folder that every executor and the driver share, and tables kept in it."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, which also becomes its checkpoint folder.

    Where the setting is absent a temporary folder takes its place, but only if the master is local: on a cluster no other
    machine would see it.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="kinlink-")
        sc.setCheckpointDir(found)
    elif sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage: lost executors cost nothing that came before."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
