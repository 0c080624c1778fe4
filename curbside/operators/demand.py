"""Observed and latent hour-of-week demand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from curbside.functions.numeric import clip_low, first_number, ieee_div, r2
from curbside.sources.staging import stage

SLOT = ["PULocationID", "day_of_week", "request_hour"]
DATED_SLOT = ["request_date", "day_of_week", "request_hour", "PULocationID"]
THETA = 0.4
MIN_ACCEPTANCE = 0.01


def hours_of_day() -> Column:
    return F.sequence(F.lit(0), F.lit(23))


def days_of_week() -> Column:
    return F.sequence(F.lit(0), F.lit(6))


def calendar_days(trips: DataFrame) -> DataFrame:
    return trips.select("request_date", "day_of_week").distinct()


def pickup_zones(trips: DataFrame) -> DataFrame:
    return trips.select("PULocationID").distinct()


def hourly_counts(trips: DataFrame) -> DataFrame:
    """Trips per (date, weekday, hour, zone)."""
    return trips.groupBy(*DATED_SLOT).agg(F.count("*").alias("num_trips"))


def date_zone_grid(trips: DataFrame) -> DataFrame:
    """Every observed date for every zone: a cross join of two tables whose sizes the planner sees.

    Dates and zones come from one pass over `trips`.
    """
    seen = stage(trips.select("request_date", "day_of_week", "PULocationID").distinct(), "dated-zones")
    days, zones = stage(calendar_days(seen), "dates"), stage(pickup_zones(seen), "zones")
    return zones.crossJoin(days).select("request_date", "day_of_week", "PULocationID")


def hourly_grid(trips: DataFrame) -> DataFrame:
    """`date_zone_grid` with all 24 hours, so that hours without a trip count as zero."""
    return date_zone_grid(trips).withColumn("request_hour", F.explode(hours_of_day()))


def zero_filled_counts(trips: DataFrame) -> DataFrame:
    """Trips per hour of the grid. `trips` is read twice: stage it, or give the counted trips' columns only."""
    return hourly_grid(trips).join(hourly_counts(trips), DATED_SLOT, "left").fillna(0, ["num_trips"])


def historical_demand_by_grid(trips: DataFrame) -> DataFrame:
    """Mean trips per slot over the dates, written out over the full date grid."""
    return zero_filled_counts(trips).groupBy(*SLOT).agg(F.avg("num_trips").alias("historical_poisson"))


def historical_demand(counts: DataFrame) -> DataFrame:
    """The same mean as trips in the slot over dates with that weekday, without the date grid.

    `counts` is `hourly_counts`; stage it, and the trips are scanned once.
    """
    per_slot = counts.groupBy(*SLOT).agg(F.sum("num_trips").alias("trips"))
    days = stage(calendar_days(counts).groupBy("day_of_week").agg(F.count("*").alias("n_dates")), "weekdays")
    slots = pickup_zones(counts).crossJoin(days).withColumn("request_hour", F.explode(hours_of_day()))
    return slots.join(per_slot, SLOT, "left").select(
        *SLOT, (F.coalesce("trips", F.lit(0)) / F.col("n_dates")).alias("historical_poisson")
    )


def historical_demand_of(trips: DataFrame) -> DataFrame:
    return historical_demand(stage(hourly_counts(trips), "hourly-counts"))


def priced_trips(trips: DataFrame, graph: DataFrame, fit: DataFrame, theta: float = THETA,
                 drop_bad_miles: bool = False) -> DataFrame:
    """Add each trip's implied surge and acceptance probability.

    `graph` should be a staged table: it is then broadcast if, and only if, it is small enough.
    """
    edges = graph.select("PULocationID", "DOLocationID", "baseline_distance", "baseline_fare")
    if drop_bad_miles:
        trips = trips.where(F.col("trip_miles") > 0)
    a = F.col("a")
    per_mile = ieee_div(F.col("base_fare") - a, F.col("trip_miles"))
    ratio = (per_mile * F.col("baseline_distance") + a) / F.col("baseline_fare")
    surge = F.when(F.col("baseline_fare") > 0, ratio).otherwise(F.lit(1.0))
    return (
        trips.join(edges, ["PULocationID", "DOLocationID"], "left")
        .withColumn("a", fit.select("intercept").scalar())
        .withColumn("implied_surge", clip_low(surge, 1.0))
        .withColumn("p_accept", F.exp(F.lit(-theta) * (F.col("implied_surge") - 1.0)))
        .drop("a")
    )


def mean_acceptance(priced: DataFrame) -> DataFrame:
    return priced.groupBy(*SLOT).agg(F.avg("p_accept").alias("avg_historical_acceptance"))


def latent_demand(historical: DataFrame, acceptance: DataFrame, min_acceptance: float = MIN_ACCEPTANCE) -> DataFrame:
    """Observed rate over acceptance where acceptance is large enough; both rounded after the division."""
    h, p = F.col("historical_poisson"), F.col("avg_historical_acceptance")
    lifted = F.when(p > min_acceptance, ieee_div(h, p)).otherwise(h)
    return (
        historical.join(acceptance, SLOT, "left")
        .withColumn("latent_poisson", r2(lifted))
        .withColumn("avg_historical_acceptance", r2("avg_historical_acceptance"))
        .select(*SLOT, "historical_poisson", "avg_historical_acceptance", "latent_poisson")
    )


def smallest_acceptance(latent: DataFrame) -> DataFrame:
    return latent.agg(F.min("avg_historical_acceptance").alias("min_acceptance"))


def demand_lookup(latent: DataFrame) -> DataFrame:
    """Usable rate per slot: latent, else historical, else 0; null and NaN both count as missing."""
    return latent.select(
        F.col("PULocationID").alias("zone"),
        F.col("day_of_week").alias("day"),
        F.col("request_hour").alias("hour"),
        first_number("latent_poisson", "historical_poisson").alias("demand"),
    )


def densify_demand(lookup: DataFrame, zones: DataFrame) -> DataFrame:
    """Every zone x 7 days x 24 hours; slots without an estimate get 0."""
    grid = (
        zones.select(F.col("PULocationID").alias("zone"))
        .withColumn("day", F.explode(days_of_week()))
        .withColumn("hour", F.explode(hours_of_day()))
    )
    return grid.join(lookup, ["zone", "day", "hour"], "left").fillna(0.0, ["demand"])
