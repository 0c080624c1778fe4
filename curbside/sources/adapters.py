"""Adapters that give the test tables the shape of trip records and decision logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from curbside.functions.menu import menu_array
from curbside.operators.blocks import next_values


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trip per order line: customer nation to supplier nation. Every 50th part has zero miles."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    rows = (
        li.join(o, li.l_orderkey == o.o_orderkey)
        .join(c, o.o_custkey == c.c_custkey)
        .join(s, li.l_suppkey == s.s_suppkey)
    )
    asked = "o_orderdate + make_dt_interval(0, CAST(o_orderkey % 24 AS INT))"
    picked = f"{asked} + make_dt_interval(0, 0, 0, 60 + l_partkey % 900)"
    return rows.selectExpr(
        "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS trip_key",
        "CAST(c_nationkey + 1 AS INT) AS PULocationID",
        "CAST(s_nationkey + 1 AS INT) AS DOLocationID",
        f"{asked} AS request_datetime",
        f"{picked} - make_dt_interval(0, 0, 0, 30) AS on_scene_datetime",
        f"{picked} AS pickup_datetime",
        f"{picked} + make_dt_interval(0, 0, 0, l_quantity * 180) AS dropoff_datetime",
        "concat('B', l_suppkey) AS originating_base_num",
        "CASE WHEN l_partkey % 50 = 0 THEN 0D ELSE l_quantity END AS trip_miles",
        "CAST(l_quantity * 180 AS BIGINT) AS trip_time",
        "3D + 2.5D * l_quantity + l_extendedprice / 5000D AS base_passenger_fare",
        "l_extendedprice * 3D / 100000D AS bcf",
        "l_extendedprice * l_tax / 1000D AS sales_tax",
        "CASE WHEN l_returnflag = 'A' THEN 2.75D ELSE 0D END AS congestion_surcharge",
        "CASE WHEN l_linestatus = 'O' THEN 1.5D ELSE 0D END AS cbd_congestion_fee",
        "l_extendedprice / 2000D AS driver_pay",
        "l_tax * 10D AS tips",
        "'N' AS shared_request_flag",
        "'N' AS shared_match_flag",
        "'N' AS access_a_ride_flag",
        "'N' AS wav_request_flag",
        "'N' AS wav_match_flag",
    )


def as_decisions(events: DataFrame) -> DataFrame:
    """Each event as a decision, with its time: the event type is the action, the user the arm."""
    return events.selectExpr(
        "ts",
        "'log' AS run",
        "0 AS agent",
        "user_id AS arm",
        "CAST(day(ts) AS INT) AS episode",
        "event_id AS step",
        "CAST(event_id * 7 % 10 AS INT) AS state",
        "CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 "
        "WHEN 'signup' THEN 3 ELSE 4 END AS action",
        "0.2D AS prob",
        "value AS reward",
        "CAST(event_id % 20 AS INT) AS n_taxis",
    )


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One logged decision per event, with the state that the arm's next one found."""
    log = as_decisions(table(spark, sf_dir, "events")).drop("ts")
    log = next_values(log, ["run", "agent", "arm"], "step", {"next_state": "state"})
    return log.withColumn("done", F.col("next_state").isNull())


def firm_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions of four firms: the user decides the firm and the zone."""
    return table(spark, sf_dir, "events").selectExpr(
        "CAST(day(ts) - 1 AS INT) AS iteration",
        "CAST(user_id % 4 AS INT) AS firm_id",
        "CAST(1 + user_id DIV 4 % 25 AS INT) AS zone",
        "event_id AS step",
        "CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 "
        "WHEN 'signup' THEN 3 ELSE 4 END AS action",
        "0.2D AS prob",
        "value AS reward",
        "CAST(event_id % 20 AS INT) AS n_taxis",
    )


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profit of four firms over 210 iterations; order totals stand for revenue."""
    return (
        table(spark, sf_dir, "orders")
        .groupBy(
            (F.col("o_orderkey") % 210).cast("int").alias("iteration"),
            (F.col("o_custkey") % 4).cast("int").alias("firm_id"),
        )
        .agg(F.sum("o_totalprice").alias("profit"))
    )


def single_platform_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly revenue of the single platform as text, with months that do not read as a number."""
    month = (F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate") - 1
    cents = F.round(F.sum("o_totalprice") * 100).cast("bigint").cast("string")
    return (
        table(spark, sf_dir, "orders")
        .groupBy(month.cast("int").alias("Episode"))
        .agg(F.when(F.count("*") % 2 == 1, "missing").otherwise(cents).alias("Revenue"))
    )


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sweep run per order."""
    return table(spark, sf_dir, "orders").selectExpr(
        "CAST(o_custkey % 4 AS INT) AS deviator",
        "o_orderkey AS seed",
        "o_totalprice AS duration",
        "o_orderstatus <> 'F' AS success",
    )


def scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("scenario")).distinct()


def policy(zones: DataFrame, scenario_names: DataFrame) -> DataFrame:
    """A price for every scenario, platform, zone and hour of the week, from a fixed rule."""
    names = scenario_names.agg(F.array_sort(F.collect_set("scenario"))).scalar()
    grid = (
        zones.select("zone", F.explode(names).alias("scenario"))
        .withColumn("platform", F.explode(F.sequence(F.lit(0), F.lit(3))))
        .withColumn("day", F.explode(F.sequence(F.lit(0), F.lit(6))))
        .withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    )
    pick = F.expr("1 + (zone * 3 + platform * 5 + day * 7 + hour + length(scenario)) % 5")
    return grid.select(
        "scenario", "platform", "zone", "day", "hour", F.element_at(menu_array(), pick.cast("int")).alias("multiplier")
    )
