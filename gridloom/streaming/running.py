"""Running metrics over prediction chunks as they arrive."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.sources.scratch import scratch_path

SUMS = ("n", "sa", "sp", "saa", "spp", "sap", "se", "see")


def moment_sums() -> list:
    """The mergeable sums behind the band metrics: a stream keeps nothing else."""
    a, p = F.col("actual"), F.col("predicted")
    e = p - a
    a, p = F.when(e.isNotNull(), a), F.when(e.isNotNull(), p)
    return [F.count(e).alias("n"), F.sum(a).alias("sa"), F.sum(p).alias("sp"), F.sum(a * a).alias("saa"), F.sum(p * p).alias("spp"), F.sum(a * p).alias("sap"), F.sum(F.abs(e)).alias("se"), F.sum(e * e).alias("see")]


def metrics_from_sums(sums: DataFrame, key: str) -> DataFrame:
    """r2, rmse, mae and pearson_r from the sums; NULL for one row or a constant side."""
    n = F.col("n")
    va, vp = F.col("saa") - F.col("sa") * F.col("sa") / n, F.col("spp") - F.col("sp") * F.col("sp") / n
    cov = F.col("sap") - F.col("sa") * F.col("sp") / n
    known = n > 1
    return sums.select(
        key, "n", F.when(known & (va > 0), 1 - F.col("see") / va).alias("r2"), F.when(known, F.sqrt(F.col("see") / n)).alias("rmse"), F.when(known, F.col("se") / n).alias("mae"),
        F.when(known & (va > 0) & (vp > 0), cov / F.sqrt(va * vp)).alias("pearson_r"),
    )


def stream_metrics(spark: SparkSession, path: str, schema: T.StructType, key: str = "band", files_per_trigger: int = 1) -> DataFrame:
    """A streaming frame of the sums by band over Parquet files that arrive at ``path``, for complete or update mode."""
    chunks = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return chunks.groupBy(key).agg(*moment_sums())


def run_available(spark: SparkSession, path: str, schema: T.StructType, key: str = "band") -> DataFrame:
    """All chunks that are there, taken through the stream, as a table of metrics.

    Each trigger writes the state to the shared folder; the last one counts.
    """
    out = scratch_path(spark, "stream")

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("trigger", F.lit(number)).write.mode("overwrite").parquet(f"{out}/{number:06d}")

    query = stream_metrics(spark, path, schema, key).writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", scratch_path(spark, f"offsets-{uuid.uuid4().hex[:6]}")).trigger(availableNow=True).start()
    query.awaitTermination()
    every = spark.read.option("recursiveFileLookup", "true").parquet(out)
    last = every.agg(F.max("trigger").alias("trigger"))
    return metrics_from_sums(every.join(F.broadcast(last), "trigger"), key)
