"""Scans and sinks, and the tables that go through them."""

from pyspark.sql import functions as F

from curbside import schemas
from curbside.catalog.registry import query
from curbside.catalog.sql import r4
from curbside.functions.numeric import r4 as round4
from curbside.operators import demand
from curbside.operators.trips import derive_trips
from curbside.sources import tables
from curbside.sources.staging import staged_path

ORDERS = "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE"


@query("a1_parquet_scan", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def parquet_scan(t):
    return tables.read_parquet(t.spark, f"{t.sf_dir}/orders.parquet", ORDERS)


@query(
    "a1_raw_trips",
    """SELECT PULocationID, day_of_week, request_hour, count(*) AS trips, (SELECT count(*) FROM trips WHERE trip_miles = 0) AS bad_rows
       FROM trips WHERE trip_miles <> 0 AND request_date >= DATE '1995-01-01' AND request_date < DATE '1995-04-01' GROUP BY 1, 2, 3""",
)
def raw_trips(t):
    """Trip records from text files to the demand of one quarter. Records of zero miles are written with text in place of
    the number, so they do not read as trips."""
    path = staged_path(t.spark, "raw-trip-files")
    columns = [name for name in tables.trip_columns() if name in t.raw.columns]
    miles = F.when(F.col("trip_miles") == 0, "n/a").otherwise(F.col("trip_miles").cast("string"))
    tables.write_csv(t.raw.select(*columns).withColumn("trip_miles", miles), path, compression="gzip")
    kept, bad = tables.stage_trips(tables.scan_trips(t.spark, path))
    quarter = kept.where((F.col("request_month") >= F.lit("1995-01-01").cast("date")) & (F.col("request_month") < F.lit("1995-04-01").cast("date")))
    counted = derive_trips(quarter).groupBy(*demand.SLOT).agg(F.count("*").alias("trips"))
    return counted.withColumn("bad_rows", F.lit(bad).cast("bigint"))


@query("a2_parquet_read", "SELECT PULocationID, DOLocationID, day_of_week, request_hour, count(*) AS n FROM trips GROUP BY 1, 2, 3, 4")
def parquet_read(t):
    path = staged_path(t.spark, "trips")
    tables.write_parquet(t.trips, path)
    kept = tables.read_parquet(t.spark, path, t.trips.schema)
    return kept.groupBy("PULocationID", "DOLocationID", "day_of_week", "request_hour").agg(F.count("*").alias("n"))


@query("a3_csv_scan", "SELECT * FROM graph", one_pass=True)
def csv_scan(t):
    path = staged_path(t.spark, "graph-csv")
    tables.write_csv(t.graph, path)
    return tables.read_csv(t.spark, path, schemas.GRAPH)


@query("a4_parquet_sink", "SELECT CAST(request_date AS VARCHAR) AS request_date, count(*) AS trips FROM trips GROUP BY 1")
def parquet_sink(t):
    """Processed trips partitioned by date, read back with the date as a partition column."""
    path = staged_path(t.spark, "trips-by-date")
    month = F.trunc("request_date", "month").alias("month")
    tables.write_parquet(t.trips.select("*", month), path, partition_by=["month"])
    return tables.read_parquet(t.spark, path).groupBy(F.col("request_date").cast("string")).agg(F.count("*").alias("trips"))


@query(
    "a5_sorted_csv_sink",
    f"""SELECT PULocationID, day_of_week, request_hour, {r4('historical_poisson')} AS historical_poisson,
        avg_historical_acceptance, latent_poisson FROM latent""",
)
def sorted_csv_sink(t):
    path = staged_path(t.spark, "latent-csv")
    tables.write_csv(t.latent, path, order_by=["PULocationID", "day_of_week", "request_hour"])
    back = tables.read_csv(t.spark, path, schemas.LATENT)
    return back.withColumn("historical_poisson", round4("historical_poisson"))
