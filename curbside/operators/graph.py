"""The origin-destination graph: mean distance, time and baseline fare per edge."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from curbside.functions.numeric import mean_cents_rounded, r2
from curbside.operators.trips import OFF_PEAK_DAYS, OFF_PEAK_HOURS, is_off_peak
from curbside.sources.staging import stage

EDGE = ["PULocationID", "DOLocationID"]
DEFAULT_DISTANCE = 5.0


def distance_time_means(trips: DataFrame) -> DataFrame:
    """Mean distance and time of every edge over all hours."""
    return trips.groupBy(*EDGE).agg(
        r2(F.avg("trip_miles")).alias("baseline_distance"),
        r2(F.avg("trip_time")).alias("baseline_time"),
    )


def off_peak_means(trips: DataFrame, days=OFF_PEAK_DAYS, hours=OFF_PEAK_HOURS) -> DataFrame:
    """Mean distance and base fare of the edges that have off-peak trips."""
    return (
        trips.where(is_off_peak(days, hours))
        .groupBy(*EDGE)
        .agg(
            r2(F.avg("trip_miles")).alias("baseline_distance"),
            mean_cents_rounded("base_fare").alias("baseline_fare"),
        )
    )


def edge_means(trips: DataFrame, days=OFF_PEAK_DAYS, hours=OFF_PEAK_HOURS) -> DataFrame:
    """`distance_time_means` full-joined with `off_peak_means`, in one aggregation of one scan.

    Every off-peak edge is also an all-hours edge, so the join is a conditional aggregate.
    """
    quiet = is_off_peak(days, hours)
    return trips.groupBy(*EDGE).agg(
        r2(F.avg("trip_miles")).alias("baseline_distance"),
        r2(F.avg("trip_time")).alias("baseline_time"),
        r2(F.avg(F.when(quiet, F.col("trip_miles")))).alias("off_peak_distance"),
        mean_cents_rounded("base_fare", when=quiet).alias("baseline_fare"),
    )


def join_means(distance_time: DataFrame, baseline: DataFrame) -> DataFrame:
    """Full equi-join on the edge with merged keys; the second distance column is dropped."""
    return distance_time.join(baseline.drop("baseline_distance"), EDGE, "full")


def fit_line(edges: DataFrame, x: str = "baseline_distance", y: str = "baseline_fare") -> DataFrame:
    """Least squares over edges, each with weight 1: one row (intercept, price_per_mile, rmse).

    Where all edges have the same distance the slope is 0 and the intercept the mean fare.
    """
    sums = edges.where(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_slope(y, x).alias("price_per_mile"),
        F.regr_sxx(y, x).alias("sxx"),
        F.regr_syy(y, x).alias("syy"),
        F.regr_sxy(y, x).alias("sxy"),
        F.avg(y).alias("mean"),
        F.count("*").alias("n"),
    )
    unexplained = F.col("syy") - F.when(F.col("sxx") != 0, F.col("sxy") * F.col("sxy") / F.col("sxx")).otherwise(0.0)
    level = F.col("sxx") == 0
    return sums.select(
        F.when(level, F.col("mean")).otherwise(F.col("intercept")).alias("intercept"),
        F.when(level, F.lit(0.0)).otherwise(F.col("price_per_mile")).alias("price_per_mile"),
        F.sqrt(F.greatest(unexplained, F.lit(0.0)) / F.when(F.col("n") > 0, F.col("n"))).alias("rmse"),
    )


def impute_fares(edges: DataFrame, fit: DataFrame) -> DataFrame:
    """Edges without an off-peak fare get the fitted one. `fit` enters as a one-row subquery."""
    line = fit.select(F.struct("intercept", "price_per_mile")).scalar()
    guessed = r2(F.col("baseline_distance") * F.col("line.price_per_mile") + F.col("line.intercept"))
    return edges.withColumn("line", line).select(
        *EDGE, "baseline_distance", "baseline_time", F.coalesce("baseline_fare", guessed).alias("baseline_fare")
    )


def off_peak_fit(edges: DataFrame) -> DataFrame:
    """The fit of off-peak fare on off-peak distance, from `edge_means`."""
    return fit_line(edges, x="off_peak_distance", y="baseline_fare")


def baseline_graph(trips: DataFrame, days=OFF_PEAK_DAYS, hours=OFF_PEAK_HOURS) -> tuple[DataFrame, DataFrame]:
    """(graph, fit). The trips are scanned once: the edge means are staged and read twice."""
    edges = stage(edge_means(trips, days, hours), "edge-means")
    fit = off_peak_fit(edges)
    return impute_fares(edges, fit), fit


def fare_lookup(
    pairs: DataFrame,
    graph: DataFrame,
    fit: DataFrame,
    origin: str = "zone",
    dest: str = "dest",
    default_distance: float = DEFAULT_DISTANCE,
) -> DataFrame:
    """Add `fare`: the edge's fare if the edge exists, else the fitted fare of a default distance.

    A present edge with a null fare keeps the null; only a missing edge takes the default.
    """
    edges = graph.select(
        F.col("PULocationID").alias(origin),
        F.col("DOLocationID").alias(dest),
        F.col("baseline_fare").alias("edge_fare"),
        F.lit(True).alias("has_edge"),
    )
    default = fit.select(F.lit(default_distance) * F.col("price_per_mile") + F.col("intercept")).scalar()
    return (
        pairs.join(edges, [origin, dest], "left")
        .withColumn("fare", F.when(F.col("has_edge"), F.col("edge_fare")).otherwise(default))
        .drop("edge_fare", "has_edge")
    )


def densify_fares(
    graph: DataFrame, zones: DataFrame, fit: DataFrame, default_distance: float = DEFAULT_DISTANCE
) -> DataFrame:
    """Dense (zone, dest, fare) over the zone domain, whose size the map fixes (262 in the source data).

    `zones` should be staged, so that the planner sees its size."""
    ids = zones.select(F.col("PULocationID").alias("zone"))
    pairs = ids.crossJoin(ids.withColumnRenamed("zone", "dest"))
    return fare_lookup(pairs, graph, fit, default_distance=default_distance)
