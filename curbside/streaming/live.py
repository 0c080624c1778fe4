"""Hourly request counts and running bandit weights over streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from curbside.functions.numeric import ieee_div
from curbside.operators.learning import IDS


def stream_parquet(spark: SparkSession, folder: str, schema, file_filter: str | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if file_filter:
        reader = reader.option("pathGlobFilter", file_filter)
    return reader.parquet(folder)


def hourly_requests(trips: DataFrame, lateness: str = "2 hours", zone: str = "PULocationID",
                    at: str = "request_datetime") -> DataFrame:
    """Requests per zone and hour; rows later than `lateness` behind the newest are dropped.

    In append mode an hour is emitted once, after the watermark has passed its end.
    """
    counted = (
        trips.withColumn(at, F.col(at).cast("timestamp"))
        .withWatermark(at, lateness)
        .groupBy(F.window(at, "1 hour").alias("w"), F.col(zone))
        .agg(F.count("*").alias("num_trips"))
    )
    return counted.select(F.col("w.start").alias("hour_start"), F.col(zone), "num_trips")


def running_weights(log: DataFrame, reward: Column, eta: float = 0.1, ids=IDS) -> DataFrame:
    """EXP3 log weight of every played (arm, action) so far; the state is one sum per pair."""
    return log.groupBy(*ids, "action").agg((F.lit(eta) * F.sum(ieee_div(reward, F.col("prob")))).alias("log_w"))


def append_to(result: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write closed rows as Parquet until the input is used up."""
    return (
        result.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def changes_to(result: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write the rows that each batch has changed as Parquet, one folder a batch.

    A batch writes what its own rows touched, however many rows there are in all. A batch that runs again after a
    failure replaces its own folder.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        result.writeStream.outputMode("update")
        .foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def current_rows(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The latest row of each key out of the changes at `path`."""
    changes = spark.read.parquet(path)
    rest = [c for c in changes.columns if c not in (*keys, "batch")]
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_row"))
    return last.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])
