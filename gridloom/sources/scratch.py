"""Tables written to the cluster's shared folder to cut lineage or to be read several times."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_path(spark: SparkSession, kind: str = "table") -> str:
    """A new path under ``spark.checkpoint.dir``; on a single machine a temporary folder stands in where that is unset, on a cluster it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not single_machine(spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-gridloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/gridloom-{kind}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def single_machine(master: str) -> bool:
    """Whether a master URL runs all tasks in the driver's own process."""
    return master == "local" or master.startswith("local[")


_written: list[str] = []


def drop_scratch(spark: SparkSession) -> None:
    """Delete the tables that this process has written; for the end of a job, when nothing reads them any more."""
    for path in _written:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _written.clear()


def durable(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet and read back."""
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
