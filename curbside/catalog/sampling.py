"""Samples, splits, ranked cuts and array functions."""

from pyspark.sql import functions as F

from curbside.catalog.registry import query
from curbside.catalog.sql import unit
from curbside.operators import sampling

SAMPLE = 5000
HASH = "CAST('0x' || substr(md5(trip_key || ':42'), 1, 13) AS BIGINT)"


@query(
    "g5_sampled_trips",
    f"SELECT trip_key, PULocationID, DOLocationID FROM trips ORDER BY {HASH}, trip_key LIMIT {SAMPLE}",
)
def sampled_trips(t):
    rows = t.trips.select("trip_key", "PULocationID", "DOLocationID")
    return sampling.sample_rows(rows, SAMPLE, ["trip_key"])


@query(
    "g6_split_trips",
    f"""SELECT trip_key, CASE WHEN {unit('trip_key', 42)} < 0.15 THEN 'test'
        WHEN {unit('trip_key', 43)} < 0.15 THEN 'validation' ELSE 'train' END AS split FROM trips""",
)
def split_trips(t):
    return sampling.split_rows(t.trips.select("trip_key"), ["trip_key"])


@query("g7_first_slots", "SELECT PULocationID, day_of_week, request_hour, latent_poisson FROM latent ORDER BY 1, 2, 3 LIMIT 10")
def first_slots(t):
    order = ["PULocationID", "day_of_week", "request_hour"]
    return sampling.first_rows(t.latent.select(*order, "latent_poisson"), 10, order)


@query(
    "g4_activated_arms",
    """SELECT zone, day, hour, CAST(row_number() OVER (PARTITION BY day, hour ORDER BY demand DESC, zone) <= 6 AS INT) AS active
       FROM demand""",
)
def activated_arms(t):
    return sampling.activate_top(t.demand, 6, ["day", "hour"], score="demand", arm="zone").select(
        "zone", "day", "hour", "active"
    )


@query(
    "i11_array_functions",
    """SELECT PULocationID, day_of_week, CAST(sum(num_trips) AS BIGINT) AS trips, CAST(count(*) AS INT) AS hours_seen,
       CAST(24 - count(*) AS INT) AS hours_missing, max(request_hour) AS last_hour
       FROM (SELECT PULocationID, day_of_week, request_hour, sum(num_trips) AS num_trips FROM counts GROUP BY 1, 2, 3) GROUP BY 1, 2""",
    one_pass=True,
)
def array_functions(t):
    """The day's hours as one array per zone: list, count below, running total, explode."""
    per_hour = t.counts.groupBy("PULocationID", "day_of_week", "request_hour").agg(F.sum("num_trips").alias("n"))
    packed = per_hour.groupBy("PULocationID", "day_of_week").agg(
        F.array_sort(F.collect_list(F.struct("request_hour", "n"))).alias("h")
    )
    hours = F.col("h.request_hour")
    return packed.select(
        "PULocationID",
        "day_of_week",
        F.aggregate("h", F.lit(0).cast("bigint"), lambda a, x: a + x["n"]).alias("trips"),
        F.size("h").alias("hours_seen"),
        F.size(F.array_except(F.sequence(F.lit(0), F.lit(23)), hours)).alias("hours_missing"),
        F.element_at(hours, -1).alias("last_hour"),
    )
