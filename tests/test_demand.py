import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from curbside.operators import demand, graph, trips
from curbside.plans.demand_plan import estimate_demand, save_demand
from curbside.sources import tables
from curbside import schemas

RAW = (
    "PULocationID int, DOLocationID int, request_datetime timestamp_ntz, pickup_datetime timestamp_ntz, trip_miles double, "
    "trip_time bigint, base_passenger_fare double, bcf double, sales_tax double, congestion_surcharge double, "
    "cbd_congestion_fee double, driver_pay double, tips double, wav_match_flag string, extra string"
)


def raw_trips(spark, n=600, seed=1):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        asked = dt.datetime(2026, 1, 1) + dt.timedelta(minutes=rng.randrange(60 * 24 * 21))
        pu = 1 if rng.random() < 0.4 else rng.randrange(1, 7)
        miles = 0.0 if rng.random() < 0.03 else rng.randrange(1, 200) / 10
        rows.append(
            (pu, rng.randrange(1, 9), asked, asked + dt.timedelta(seconds=rng.randrange(900)), miles, 60,
             3 + 2 * miles + rng.random(), 0.1, 0.2, 2.75, 1.5, 9.0, 1.0, "N", "kept")
        )
    return spark.createDataFrame(rows, RAW)


def test_derived_columns_and_dropped_columns(spark):
    out = trips.derive_trips(raw_trips(spark))
    assert "extra" in out.columns and not set(out.columns) & set(schemas.DROPPED_TRIP_COLUMNS)
    formula = trips.derive_trips(raw_trips(spark), "day_of_month")
    assert formula.schema["request_date"].dataType.simpleString() == "int"
    # January 2026 begins on a Thursday, so both weekday rules agree
    assert out.groupBy("day_of_week").count().exceptAll(formula.groupBy("day_of_week").count()).isEmpty()
    with pytest.raises(ValueError):
        trips.derive_trips(raw_trips(spark), "lunar")


def test_grid_form_equals_fast_form(spark):
    kept = trips.derive_trips(raw_trips(spark))
    slow = {tuple(r[:3]): r[3] for r in demand.historical_demand_by_grid(kept).select(*demand.SLOT, "historical_poisson").collect()}
    fast = {tuple(r[:3]): r[3] for r in demand.historical_demand_of(kept).collect()}
    assert slow.keys() == fast.keys()
    assert all(math.isclose(slow[k], fast[k], abs_tol=1e-12) for k in slow)


def test_one_pass_edges_equal_the_full_join(spark):
    kept = trips.derive_trips(raw_trips(spark))
    joined = graph.join_means(graph.distance_time_means(kept), graph.off_peak_means(kept))
    folded = graph.edge_means(kept).drop("off_peak_distance")
    cols = [*graph.EDGE, "baseline_distance", "baseline_time", "baseline_fare"]
    assert joined.select(cols).exceptAll(folded.select(cols)).isEmpty()
    assert folded.select(cols).exceptAll(joined.select(cols)).isEmpty()


def test_fit_and_rmse(spark):
    edges = spark.createDataFrame([(1.0, 5.0), (2.0, 7.0), (3.0, 10.0), (4.0, None)], "baseline_distance double, baseline_fare double")
    row = graph.fit_line(edges).first()
    assert math.isclose(row.price_per_mile, 2.5) and math.isclose(row.intercept, 7 / 3)
    residuals = [5 - 7 / 3 - 2.5, 7 - 7 / 3 - 5, 10 - 7 / 3 - 7.5]
    assert math.isclose(row.rmse, math.sqrt(sum(r * r for r in residuals) / 3))


def test_missing_edge_takes_the_default_but_null_fare_stays(spark):
    edges = spark.createDataFrame(
        [(1, 1, 2.0, 1.0, 9.0), (1, 2, 2.0, 1.0, None)],
        "PULocationID int, DOLocationID int, baseline_distance double, baseline_time double, baseline_fare double",
    )
    zones = spark.createDataFrame([(1,), (2,)], "PULocationID int")
    fit = spark.createDataFrame([(8.0, 3.0)], "intercept double, price_per_mile double")
    got = {(r.zone, r.dest): r.fare for r in graph.densify_fares(edges, zones, fit).collect()}
    assert got == {(1, 1): 9.0, (1, 2): None, (2, 1): 23.0, (2, 2): 23.0}


def priced(spark, rows):
    trip = spark.createDataFrame(rows, "PULocationID int, DOLocationID int, day_of_week int, request_hour int, base_fare double, trip_miles double")
    edges = spark.createDataFrame(
        [(1, 1, 4.0, 10.0), (1, 2, 0.0, 10.0), (1, 3, 4.0, 0.0)],
        "PULocationID int, DOLocationID int, baseline_distance double, baseline_fare double",
    )
    fit = spark.createDataFrame([(2.0,)], "intercept double")
    return demand.priced_trips(trip, edges, fit)


def test_implied_surge_traps(spark):
    rows = [
        (1, 1, 0, 0, 22.0, 4.0),  # (20/4*4+2)/10 = 2.2
        (1, 1, 0, 1, 4.0, 4.0),   # below 1, clipped
        (1, 1, 0, 2, 22.0, 0.0),  # zero miles, infinite surge
        (1, 1, 0, 3, 2.0, 0.0),   # zero over zero
        (1, 3, 0, 4, 22.0, 4.0),  # baseline fare 0
        (1, 9, 0, 5, 22.0, 4.0),  # no edge
    ]
    got = {r.request_hour: (r.implied_surge, r.p_accept) for r in priced(spark, rows).collect()}
    assert math.isclose(got[0][0], 2.2) and math.isclose(got[0][1], math.exp(-0.4 * (got[0][0] - 1)))
    assert got[1] == (1.0, 1.0) and got[2] == (math.inf, 0.0)
    assert math.isnan(got[3][0]) and math.isnan(got[3][1])
    assert got[4] == (1.0, 1.0) and got[5] == (1.0, 1.0)


def test_nan_acceptance_reaches_latent_and_falls_back_in_the_lookup(spark):
    history = spark.createDataFrame([(1, 0, h, 2.0) for h in range(4)], schemas.HISTORICAL)
    acceptance = spark.createDataFrame(
        [(1, 0, 0, float("nan")), (1, 0, 1, 0.5), (1, 0, 2, 0.005)], "PULocationID int, day_of_week int, request_hour int, avg_historical_acceptance double"
    )
    latent = demand.latent_demand(history, acceptance)
    got = {r.request_hour: r.latent_poisson for r in latent.collect()}
    assert math.isnan(got[0]) and got[1] == 4.0 and got[2] == 2.0 and got[3] == 2.0
    assert {r.hour: r.demand for r in demand.demand_lookup(latent).collect()} == {0: 2.0, 1: 4.0, 2: 2.0, 3: 2.0}
    dense = demand.densify_demand(demand.demand_lookup(latent), spark.createDataFrame([(1,), (2,)], "PULocationID int"))
    assert dense.count() == 2 * 168 and dense.agg(F.sum("demand")).first()[0] == 10.0


def test_workflow_tables_round_trip(spark, tmp_path):
    out = estimate_demand(raw_trips(spark))
    bad = out.latent.where("avg_historical_acceptance > 0.01 AND avg_historical_acceptance <= 1 AND latent_poisson < historical_poisson - 0.005")
    assert bad.isEmpty()
    save_demand(out, str(tmp_path / "csv"), csv=True)
    back = tables.read_csv(spark, str(tmp_path / "csv" / "graph"), schemas.GRAPH)
    assert back.exceptAll(out.graph).isEmpty() and back.count() == out.graph.count()
    save_demand(out, str(tmp_path / "parquet"))
    assert tables.read_parquet(spark, str(tmp_path / "parquet" / "latent_mle_params")).count() == out.latent.count()


def test_csv_that_does_not_fit_fails(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("PULocationID,DOLocationID,baseline_distance,baseline_time,baseline_fare\n1,x,1,1,1\n")
    with pytest.raises(Exception):
        tables.read_csv(spark, str(tmp_path / "bad.csv"), schemas.GRAPH).collect()


def test_small_staged_graph_is_broadcast_and_trips_are_pruned(spark):
    from curbside.sources.staging import stage

    kept = stage(trips.derive_trips(raw_trips(spark)), "trips")
    edges, fit = graph.baseline_graph(kept)
    plan = demand.mean_acceptance(demand.priced_trips(kept, edges, fit))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "Cartesian" not in plan
    assert "driver_income" not in plan and "waiting_time" not in plan
