"""Stage tables: lineage cut where several later steps read one result."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``; one of our own in local mode where
    none is named. On a cluster, whose executors would not see a folder of the driver, that is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if named is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quantloom-stages-"))
    return sc.getCheckpointDir()


def staged(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
