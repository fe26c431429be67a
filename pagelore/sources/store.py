"""The shared folder for what a job writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one is set in local mode, as in tests, where there is none."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="jobs"))
    return sc.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def dealt(table: DataFrame) -> DataFrame:
    """The rows of a table, dealt over all cores if it has fewer files than there are cores: a file that was written as one
    group of rows is read by one task, however many there are. For work that takes far longer than moving the rows."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table if len(table.inputFiles()) >= cores else table.repartition(cores)


def stored(df: DataFrame) -> DataFrame:
    """The rows of ``df``, worked out once and read back from the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
