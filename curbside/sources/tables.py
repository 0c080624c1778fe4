"""Parquet and CSV scans with declared schemas, and the matching sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from curbside.schemas import RAW_TRIPS
from curbside.sources.staging import stage


def read_parquet(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """CSV with a header row; a row that does not fit the schema fails the job."""
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("mode", "FAILFAST")
        .option("enforceSchema", False)
        .csv(path)
    )


def trip_columns() -> list[str]:
    """The columns of a raw trip record, in the order of its file."""
    return [part.split()[0] for part in RAW_TRIPS.split(", ")]


def scan_trips(spark: SparkSession, path: str, kind: str = "csv") -> DataFrame:
    """Raw trip records at `path` with their declared columns (`schemas.RAW_TRIPS`) and `bad_row`: whether a record does
    not read as one (text that is no number or time, a missing zone or request time). No row is left out or fails the job."""
    schema = f"{RAW_TRIPS}, _corrupt STRING"
    reader = spark.read.schema(schema)
    if kind == "csv":
        options = {"header": True, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
        rows = reader.options(**options).csv(path)
    else:
        rows = spark.read.schema(RAW_TRIPS).parquet(path).withColumn("_corrupt", F.lit(None).cast("string"))
    missing = F.col("PULocationID").isNull() | F.col("DOLocationID").isNull() | F.col("request_datetime").isNull()
    return rows.withColumn("bad_row", F.col("_corrupt").isNotNull() | missing).drop("_corrupt")


def stage_trips(rows: DataFrame, label: str = "raw-trips") -> tuple[DataFrame, int]:
    """The good rows of `scan_trips` as a table with a folder for each `request_month` (its first day), and how many bad
    rows there were. The records are read once; a filter on the month then reads no other month's files."""
    month = F.trunc(F.to_date("request_datetime"), "month")
    staged = stage(rows.withColumn("request_month", month), label, partition_by="request_month", compression="zstd")
    return staged.where("NOT bad_row").drop("bad_row"), staged.where("bad_row").count()


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """Parquet; with `partition_by`, rows are gathered by those columns, large values in several tasks."""
    if partition_by:
        df.hint("rebalance", *partition_by).write.mode(mode).partitionBy(*partition_by).parquet(path)
    else:
        df.write.mode(mode).parquet(path)


#: Compressed text is read a file a task, so that many rows go into one.
ROWS_A_FILE = 1_000_000


def write_csv(
    df: DataFrame, path: str, order_by: list[str] | None = None, mode: str = "overwrite", compression: str | None = None
) -> None:
    """Sorted CSV with a header; the sort is a range partitioning, so files follow in key order. With `compression`
    ("gzip"), at its fastest and at most `ROWS_A_FILE` rows in a file."""
    out = df.orderBy(*order_by) if order_by else df
    writer = out.write.mode(mode).option("header", True)
    if compression:
        small = {"compression": compression, "maxRecordsPerFile": ROWS_A_FILE, "zlib.compress.level": "BEST_SPEED"}
        writer = writer.options(**small)
    writer.csv(path)
