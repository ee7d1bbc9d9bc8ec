"""Tables that a job writes for itself, in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of this driver that ``sweep`` hasn't removed.
_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it isn't set, a folder below /tmp if all tasks run on this machine (tests); else an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file:///tmp/checkpoints/marlgrove"
    return at.rstrip("/")


def folder(spark: SparkSession) -> str:
    """A new folder name below the shared one."""
    _MADE.append(f"{shared_dir(spark)}/marlgrove-{uuid.uuid4().hex}")
    return _MADE[-1]


def written(df: DataFrame) -> DataFrame:
    """The same rows, from a table: computed once, however often they are read, and kept where an executor is lost."""
    at = folder(df.sparkSession)
    df.write.parquet(at)
    return df.sparkSession.read.parquet(at)


def sweep(spark: SparkSession) -> None:
    """Removes the folders. Results that are not written yet may still read theirs."""
    while _MADE:
        path = spark._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
