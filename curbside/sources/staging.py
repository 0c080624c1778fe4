"""Tables written to the shared folder so that a result is computed once and its size is known.

A staged table cuts lineage, survives the loss of executors, and gives the planner its true
size on disk: joins against it become broadcasts only when that size is under the session's
broadcast threshold.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named by `spark.checkpoint.dir`; a private one only in local sessions without it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        folder = tempfile.mkdtemp(prefix="curbside-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def staged_path(spark: SparkSession, label: str) -> str:
    """A new path under this application's own folder, which may be deleted once the application has ended."""
    return f"{shared_folder(spark)}/curbside/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def stage(
    df: DataFrame, label: str = "table", partition_by: str | None = None, compression: str | None = None
) -> DataFrame:
    """Write `df` to the shared folder and return it as a scan of that table.

    With `partition_by`, each value of that column is a folder of its own, and a filter on it reads no other.
    With `compression`, that codec instead of the session's.
    """
    spark = df.sparkSession
    path = staged_path(spark, label)
    writer = df.write if partition_by is None else df.hint("rebalance", partition_by).write.partitionBy(partition_by)
    writer.mode("error").parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path).select(*[F.col(f"`{c}`") for c in df.columns])
