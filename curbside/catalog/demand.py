"""Observed and latent demand."""

from pyspark.sql import functions as F

from curbside.catalog.registry import query
from curbside.catalog.sql import r2, r4
from curbside.functions import calendar
from curbside.functions.numeric import clip, clip_low, first_number, r2 as round2, r4 as round4
from curbside.operators import demand
from curbside.operators.market import acceptance
from curbside.plans.demand_plan import TRIP_COLUMNS
from curbside.sources.staging import stage

GRID = """(SELECT d.request_date, d.day_of_week, CAST(h.range AS INT) AS request_hour, z.PULocationID
           FROM dates d CROSS JOIN zones z CROSS JOIN range(24) h)"""


@query("e7_calendar_days", "SELECT DISTINCT CAST(request_date AS VARCHAR) AS request_date, day_of_week FROM trips")
def calendar_days(t):
    return demand.calendar_days(t.trips).withColumn("request_date", F.col("request_date").cast("string"))


@query("e8_pickup_zones", "SELECT DISTINCT PULocationID FROM trips")
def pickup_zones(t):
    return demand.pickup_zones(t.trips)


@query("e9_hourly_counts", "SELECT * REPLACE (CAST(request_date AS VARCHAR) AS request_date) FROM counts")
def hourly_counts(t):
    return demand.hourly_counts(t.trips).withColumn("request_date", F.col("request_date").cast("string"))


@query("d2_date_zone_grid", "SELECT CAST(request_date AS VARCHAR) AS request_date, day_of_week, PULocationID FROM dates CROSS JOIN zones", one_pass=True)
def date_zone_grid(t):
    return demand.date_zone_grid(t.counts).withColumn("request_date", F.col("request_date").cast("string"))


@query(
    "e10_hourly_grid",
    f"SELECT PULocationID, day_of_week, request_hour, count(*) AS cells FROM {GRID} GROUP BY 1, 2, 3",
    one_pass=True,
)
def hourly_grid(t):
    return demand.hourly_grid(t.counts).groupBy(*demand.SLOT).agg(F.count("*").alias("cells"))


@query(
    "d3_zero_filled_counts",
    f"""SELECT g.PULocationID, g.request_hour, CAST(sum(coalesce(c.num_trips, 0)) AS BIGINT) AS num_trips, count(*) AS cells,
        count(*) FILTER (WHERE c.num_trips IS NULL) AS empty_cells
        FROM {GRID} g LEFT JOIN counts c USING (request_date, day_of_week, request_hour, PULocationID) GROUP BY 1, 2""",
)
def zero_filled_counts(t):
    return (
        demand.zero_filled_counts(t.trips)
        .groupBy("PULocationID", "request_hour")
        .agg(
            F.sum("num_trips").alias("num_trips"),
            F.count("*").alias("cells"),
            F.count_if(F.col("num_trips") == 0).alias("empty_cells"),
        )
    )


HISTORICAL = f"SELECT PULocationID, day_of_week, request_hour, {r4('historical_poisson')} AS historical_poisson FROM historical"


@query("e11_historical_demand", HISTORICAL, one_pass=True)
def historical_demand(t):
    return t.historical.withColumn("historical_poisson", round4("historical_poisson"))


@query(
    "e11_historical_demand_by_grid",
    f"""SELECT PULocationID, day_of_week, request_hour, {r4('avg(coalesce(num_trips, 0))')} AS historical_poisson
        FROM {GRID} LEFT JOIN counts USING (request_date, day_of_week, request_hour, PULocationID) GROUP BY 1, 2, 3""",
)
def historical_demand_by_grid(t):
    return demand.historical_demand_by_grid(t.trips).withColumn("historical_poisson", round4("historical_poisson"))


@query(
    "d4_trips_with_edge",
    "SELECT trip_key, PULocationID, DOLocationID, baseline_distance, baseline_fare "
    "FROM trips LEFT JOIN graph USING (PULocationID, DOLocationID)",
    keep=("trip_key", *TRIP_COLUMNS),
)
def trips_with_edge(t):
    edges = t.graph.drop("baseline_time")
    return t.kept_trips.select("trip_key", "PULocationID", "DOLocationID").join(edges, ["PULocationID", "DOLocationID"], "left")


@query("e12_implied_surge", f"SELECT trip_key, {r4('implied_surge')} AS implied_surge FROM priced", keep=("trip_key", *TRIP_COLUMNS))
def implied_surge(t):
    return demand.priced_trips(t.kept_trips, t.graph, t.fit).select("trip_key", round4("implied_surge").alias("implied_surge"))


@query("e13_trip_acceptance", f"SELECT trip_key, {r4('p_accept')} AS p_accept FROM priced", keep=("trip_key", *TRIP_COLUMNS))
def trip_acceptance(t):
    return demand.priced_trips(t.kept_trips, t.graph, t.fit).select("trip_key", round4("p_accept").alias("p_accept"))


@query(
    "e14_mean_acceptance",
    f"SELECT PULocationID, day_of_week, request_hour, {r4('avg_historical_acceptance')} AS avg_historical_acceptance FROM acceptance",
)
def mean_acceptance(t):
    return demand.mean_acceptance(t.priced).withColumn("avg_historical_acceptance", round4("avg_historical_acceptance"))


@query(
    "d5_historical_with_acceptance",
    f"""SELECT PULocationID, day_of_week, request_hour, {r4('historical_poisson')} AS historical_poisson,
        {r4('avg_historical_acceptance')} AS avg_historical_acceptance
        FROM historical LEFT JOIN acceptance USING (PULocationID, day_of_week, request_hour)""",
)
def historical_with_acceptance(t):
    joined = t.historical.join(demand.mean_acceptance(t.priced), demand.SLOT, "left")
    return joined.withColumns({c: round4(c) for c in ("historical_poisson", "avg_historical_acceptance")})


LATENT = f"""SELECT PULocationID, day_of_week, request_hour, {r4('historical_poisson')} AS historical_poisson,
    avg_historical_acceptance, latent_poisson FROM latent"""


@query("e15_latent_demand", LATENT)
def latent_demand(t):
    return t.latent.withColumn("historical_poisson", round4("historical_poisson"))


@query("e16_smallest_acceptance", "SELECT min(avg_historical_acceptance) AS min_acceptance FROM latent")
def smallest_acceptance(t):
    return demand.smallest_acceptance(t.latent)


LOOKUP = f"""SELECT PULocationID AS zone, day_of_week AS day, request_hour AS hour,
    {r4('coalesce(latent_poisson, historical_poisson, 0)')} AS demand FROM latent"""


@query("k1_demand_lookup", LOOKUP)
def demand_lookup(t):
    return demand.demand_lookup(t.latent).withColumn("demand", round4("demand"))


@query("k2_dense_demand", f"SELECT zone, day, hour, {r4('demand')} AS demand FROM demand")
def dense_demand(t):
    return t.demand.withColumn("demand", round4("demand"))


@query(
    "i1_date_parts",
    """SELECT o_orderkey, CAST(extract(day FROM o_orderdate) AS INT) AS day, CAST(extract(hour FROM asked) AS INT) AS hour,
       CAST((extract(day FROM o_orderdate) + 3) % 7 AS INT) AS formula_day_of_week, CAST(extract(dow FROM asked) AS INT) AS day_of_week,
       CAST((epoch_us(asked) - epoch_us(o_orderdate)) // 1000000 AS BIGINT) AS seconds
       FROM (SELECT *, o_orderdate + INTERVAL '1' HOUR * CAST(o_orderkey % 24 AS INT) AS asked FROM orders)""",
)
def date_parts(t):
    asked = F.expr("o_orderdate + make_dt_interval(0, CAST(o_orderkey % 24 AS INT))")
    return t.table("orders").withColumn("asked", asked).select(
        "o_orderkey",
        F.dayofmonth("o_orderdate").alias("day"),
        F.hour("asked").alias("hour"),
        calendar.weekday_from_day_of_month(F.col("o_orderdate")).alias("formula_day_of_week"),
        calendar.weekday(F.col("asked")).alias("day_of_week"),
        calendar.whole_seconds_between("o_orderdate", "asked").alias("seconds"),
    )


@query(
    "i2_exponential",
    f"""SELECT event_id, {r4('exp(-0.4 * (value / 10 - 1.0))')} AS acceptance FROM events""",
)
def exponential(t):
    return t.table("events").select("event_id", round4(acceptance(F.col("value") / 10)).alias("acceptance"))


@query(
    "i3_rounding",
    f"""SELECT trip_key, {r2('base_passenger_fare')} AS fare_cents, {r2('bcf')} AS bcf_cents,
        {r2('sales_tax')} AS tax_cents FROM raw""",
)
def rounding(t):
    return t.raw.select(
        "trip_key",
        round2("base_passenger_fare").alias("fare_cents"),
        round2("bcf").alias("bcf_cents"),
        round2("sales_tax").alias("tax_cents"),
    )


@query(
    "i4_clipping",
    f"""SELECT trip_key, CASE WHEN trip_miles < 1 THEN 1.0 ELSE trip_miles END AS at_least_one,
        CAST(greatest(5, least(40, trip_miles)) AS DOUBLE) AS within FROM trips""",
)
def clipping(t):
    return t.trips.select(
        "trip_key", clip_low("trip_miles", 1.0).alias("at_least_one"), clip("trip_miles", 5.0, 40.0).alias("within")
    )


@query(
    "i5_null_repair",
    f"""SELECT zone, day, hour, {r4('coalesce(a.avg_historical_acceptance, 0)')} AS acceptance, {r4('demand')} AS demand
        FROM demand LEFT JOIN acceptance a ON a.PULocationID = zone AND a.day_of_week = day AND a.request_hour = hour""",
)
def null_repair(t):
    slots = t.latent.join(
        stage(demand.mean_acceptance(t.priced), "acceptance").withColumnRenamed("avg_historical_acceptance", "a"),
        demand.SLOT,
        "left",
    )
    return demand.densify_demand(
        slots.select(
            F.col("PULocationID").alias("zone"),
            F.col("day_of_week").alias("day"),
            F.col("request_hour").alias("hour"),
            round4(first_number("a")).alias("acceptance"),
            round4(first_number("latent_poisson", "historical_poisson")).alias("demand"),
        ),
        t.zones,
    ).fillna(0.0, ["acceptance"]).select("zone", "day", "hour", "acceptance", "demand")
