"""Small frames on which results were once wrong."""

import math

from pyspark.sql import functions as F

from curbside.functions.numeric import mean_cents_rounded
from curbside.operators import graph, replay, sampling


def test_mean_of_large_amounts_counts_all(spark):
    mean = lambda xs: spark.createDataFrame([(x,) for x in xs], "x double").agg(mean_cents_rounded("x").alias("m")).first().m
    assert mean([1.0, 3.0, 1e14]) == (1e14 + 4) / 3
    assert mean([1.0, 2.0, None]) == 1.5 and mean([0.01, 0.02]) == 0.02
    assert math.isnan(mean([1.0, float("nan")])) and mean([1.0, float("inf")]) == float("inf") and mean([]) is None


def test_line_through_one_distance_is_level(spark):
    edges = spark.createDataFrame([(2.0, 5.0), (2.0, 7.0)], "baseline_distance double, baseline_fare double")
    line = graph.fit_line(edges).first()
    assert (line.intercept, line.price_per_mile, line.rmse) == (6.0, 0.0, 1.0)
    assert graph.fit_line(edges.limit(0)).first().intercept is None


def test_activation_keeps_rows_without_score_or_group(spark):
    rows = [("a", 1, 0.5), ("a", 2, None), ("a", 3, 0.7), (None, 1, 0.1), ("b", 1, None)]
    got = sampling.activate_top(spark.createDataFrame(rows, "g string, arm int, score double"), 2, ["g"])
    assert {(r.g, r.arm): r.active for r in got.collect()} == {("a", 1): 1, ("a", 2): 0, ("a", 3): 1, (None, 1): 1, ("b", 1): 0}


def test_sarsa_stops_at_the_end_of_an_episode(spark):
    schema = "run string, agent int, arm int, episode int, step bigint, state int, action int, reward double, next_state int"
    for following in (0, 1):
        rows = [("r", 0, 0, 1, 0, 0, 0, 0.0, 1), ("r", 0, 0, 2, 1, 1, following, 1.0, None), ("r", 0, 0, 2, 2, 0, 0, 0.0, 1)]
        values = replay.sarsa_replay(spark.createDataFrame(rows, schema), F.col("reward"), 0.5, 0.9, 2, 2)
        assert {(r.state, r.action): r.q for r in values.collect()}[0, 0] == 0.0
