"""Trip columns, filters and the origin-destination graph."""

from pyspark.sql import functions as F

from curbside.catalog.registry import query
from curbside.catalog.sql import mean_cents, r2, r4
from curbside.functions.calendar import weekday_from_day_of_month
from curbside.functions.numeric import r4 as round4
from curbside.operators import graph, trips
from curbside.operators.demand import MIN_ACCEPTANCE, hours_of_day, mean_acceptance

KEY = "trip_key"


@query("b1_waiting_time", "SELECT trip_key, waiting_time FROM trips")
def waiting_time(t):
    return t.trips.select(KEY, "waiting_time")


@query("b2_request_date", "SELECT trip_key, CAST(request_date AS VARCHAR) AS request_date, CAST(extract(day FROM request_date) AS INT) AS day_of_month FROM trips")
def request_date(t):
    return t.trips.select(KEY, F.col("request_date").cast("string"), F.dayofmonth("request_date").alias("day_of_month"))


@query(
    "b3_day_of_week",
    "SELECT trip_key, day_of_week, CAST((extract(day FROM request_date) + 3) % 7 AS INT) AS formula_day_of_week FROM trips",
)
def day_of_week(t):
    formula = weekday_from_day_of_month(F.col("asked")).alias("formula_day_of_week")
    kept = t.raw.withColumn("asked", F.col("request_datetime"))
    return trips.derive_trips(kept).select(KEY, "day_of_week", formula)


@query("b4_request_hour", "SELECT trip_key, request_hour FROM trips")
def request_hour(t):
    return t.trips.select(KEY, "request_hour")


@query("b5_base_fare", "SELECT trip_key, base_fare FROM trips")
def base_fare(t):
    return t.trips.select(KEY, "base_fare")


@query("b6_congestion_tax", f"SELECT trip_key, {r4('congestion_tax')} AS congestion_tax FROM trips")
def congestion_tax(t):
    return t.trips.select(KEY, round4("congestion_tax").alias("congestion_tax"))


@query("b7_driver_income", "SELECT trip_key, driver_income FROM trips")
def driver_income(t):
    return t.trips.select(KEY, "driver_income")


@query(
    "b8_processed_trips",
    "SELECT trip_key, PULocationID, DOLocationID, trip_miles, trip_time, waiting_time, CAST(request_date AS VARCHAR) AS request_date, day_of_week, "
    f"request_hour, base_fare, {r4('congestion_tax')} AS congestion_tax, driver_income FROM trips",
)
def processed_trips(t):
    return t.trips.withColumns(
        {"congestion_tax": round4("congestion_tax"), "request_date": F.col("request_date").cast("string")}
    )


@query("b9_column_subset", "SELECT PULocationID, day_of_week, request_hour, DOLocationID FROM trips")
def column_subset(t):
    return t.trips.select("PULocationID", "day_of_week", "request_hour", "DOLocationID")


@query("b10_hour_list", "SELECT PULocationID, CAST(len(range(24)) AS INT) AS n_hours, CAST(list_sum(range(24)) AS INT) AS sum_hours FROM zones")
def hour_list(t):
    listed = t.trips.select("PULocationID").distinct().withColumn("request_hour", hours_of_day())
    total = F.aggregate("request_hour", F.lit(0), lambda a, x: a + x)
    return listed.select("PULocationID", F.size("request_hour").alias("n_hours"), total.alias("sum_hours"))


@query(
    "b11_conditional_column",
    "SELECT PULocationID, DOLocationID, CASE WHEN baseline_fare IS NULL THEN 'imputed' ELSE 'observed' END AS fare_kind FROM edges",
)
def conditional_column(t):
    kind = F.when(F.col("baseline_fare").isNull(), "imputed").otherwise("observed")
    return graph.edge_means(t.trips).select(*graph.EDGE, kind.alias("fare_kind"))


@query(
    "c1_off_peak_trips",
    "SELECT trip_key, day_of_week, request_hour, base_fare FROM trips WHERE day_of_week IN (2, 3) AND request_hour IN (2, 3)",
)
def off_peak_trips(t):
    return trips.off_peak(t.trips).select(KEY, "day_of_week", "request_hour", "base_fare")


@query(
    "c2_null_and_threshold_tests",
    """SELECT count(*) AS edges, count(*) FILTER (WHERE baseline_fare IS NULL) AS without_fare,
       count(*) FILTER (WHERE baseline_fare > 0) AS positive_fare,
       (SELECT count(*) FROM acceptance WHERE avg_historical_acceptance > 0.01) AS usable_slots FROM edges""",
)
def null_and_threshold_tests(t):
    usable = mean_acceptance(t.priced).agg(F.count_if(F.col("avg_historical_acceptance") > MIN_ACCEPTANCE)).scalar()
    return graph.edge_means(t.trips).agg(
        F.count("*").alias("edges"),
        F.count_if(F.col("baseline_fare").isNull()).alias("without_fare"),
        F.count_if(F.col("baseline_fare") > 0).alias("positive_fare"),
    ).withColumn("usable_slots", usable)


@query(
    "e1_distance_time_means",
    f"SELECT PULocationID, DOLocationID, {r2('avg(trip_miles)')} AS baseline_distance, "
    f"{r2('avg(trip_time)')} AS baseline_time FROM trips GROUP BY 1, 2",
)
def distance_time_means(t):
    return graph.distance_time_means(t.trips)


@query(
    "e2_off_peak_means",
    f"SELECT PULocationID, DOLocationID, {r2('avg(trip_miles)')} AS baseline_distance, "
    f"{mean_cents('base_fare')} AS baseline_fare FROM trips WHERE day_of_week IN (2, 3) AND request_hour IN (2, 3) GROUP BY 1, 2",
)
def off_peak_means(t):
    return graph.off_peak_means(t.trips)


@query(
    "d1_joined_edge_means",
    "SELECT PULocationID, DOLocationID, baseline_distance, baseline_time, baseline_fare FROM edges",
)
def joined_edge_means(t):
    return graph.join_means(graph.distance_time_means(t.trips), graph.off_peak_means(t.trips))


@query(
    "e3_off_peak_fit",
    f"SELECT {r4('intercept')} AS intercept, {r4('price_per_mile')} AS price_per_mile FROM fit",
)
def off_peak_fit(t):
    return graph.off_peak_fit(graph.edge_means(t.trips)).select(
        round4("intercept").alias("intercept"), round4("price_per_mile").alias("price_per_mile")
    )


@query(
    "e4_fit_rmse",
    f"SELECT {r4('sqrt(avg(pow(baseline_fare - (intercept + price_per_mile * off_peak_distance), 2)))')} AS rmse "
    "FROM edges, fit WHERE baseline_fare IS NOT NULL",
)
def fit_rmse(t):
    return graph.off_peak_fit(graph.edge_means(t.trips)).select(round4("rmse").alias("rmse"))


@query(
    "e5_whole_graph_fit",
    f"SELECT {r4('intercept')} AS intercept, {r4('price_per_mile')} AS price_per_mile FROM graph_fit",
    one_pass=True,
)
def whole_graph_fit(t):
    return graph.fit_line(t.graph).select(
        round4("intercept").alias("intercept"), round4("price_per_mile").alias("price_per_mile")
    )


@query("e6_baseline_graph", "SELECT * FROM graph", one_pass=True)
def baseline_graph(t):
    return t.graph
