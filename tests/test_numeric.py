import math

import pytest
from pyspark.sql import functions as F

from curbside.functions import calendar, hashing, menu, numeric
from curbside.operators import market

NAN, INF = float("nan"), float("inf")


def column(spark, values, expr):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double")
    return [r[0] for r in rows.orderBy("i").select(expr.alias("y")).collect()]


def same(a, b):
    return len(a) == len(b) and all(
        x == y or (x is not None and y is not None and math.isnan(x) and math.isnan(y)) for x, y in zip(a, b)
    )


def test_r2_keeps_null_nan_and_infinity(spark):
    got = column(spark, [1.005, 0.125, -0.125, None, NAN, INF, -INF], numeric.r2("x"))
    assert same(got, [math.floor(100.49999999999999 + 0.5) / 100, 0.13, -0.12, None, NAN, INF, -INF])


def test_division_by_zero_follows_ieee(spark):
    rows = spark.createDataFrame(
        [(0, 1.0, 0.0), (1, -1.0, 0.0), (2, 0.0, 0.0), (3, None, 0.0), (4, 1.0, None), (5, 6.0, 4.0), (6, NAN, 0.0)],
        "i int, n double, d double",
    )
    got = [r[0] for r in rows.orderBy("i").select(numeric.ieee_div("n", "d")).collect()]
    assert same(got, [INF, -INF, NAN, None, None, 1.5, NAN])


def test_clips_keep_null_and_nan(spark):
    assert same(column(spark, [0.5, 2.0, None, NAN], numeric.clip_low("x", 1.0)), [1.0, 2.0, None, NAN])
    assert same(column(spark, [-1.0, 0.5, 9.0, None, NAN], numeric.clip("x", 0.0, 1.0)), [0.0, 0.5, 1.0, None, NAN])


def test_first_number_skips_null_and_nan(spark):
    rows = spark.createDataFrame([(NAN, 2.0), (None, NAN), (3.0, 1.0)], "a double, b double")
    assert [r[0] for r in rows.select(numeric.first_number("a", "b")).collect()] == [2.0, 0.0, 3.0]


def test_mean_of_cents(spark):
    rows = spark.createDataFrame(
        [("a", 10.01), ("a", 10.02), ("b", 1.0), ("b", NAN), ("c", None)], "k string, x double"
    )
    got = dict(rows.groupBy("k").agg(numeric.mean_cents_rounded("x")).collect())
    assert got["a"] == 10.02 and math.isnan(got["b"]) and got["c"] is None


def test_waiting_time_truncates_toward_zero(spark):
    rows = spark.sql(
        "SELECT timestamp_ntz'2026-03-08 01:59:59.5' a, timestamp_ntz'2026-03-08 03:00:01' b"
    )
    both = rows.select(calendar.whole_seconds_between("a", "b"), calendar.whole_seconds_between("b", "a")).first()
    assert tuple(both) == (3601, -3601)


def test_weekday_rules_agree_only_in_a_thursday_month(spark):
    rows = spark.sql("SELECT timestamp_ntz'2026-01-01 00:00:00' a UNION ALL SELECT timestamp_ntz'2026-02-01 00:00:00'")
    got = sorted(rows.select(calendar.weekday(F.col("a")), calendar.weekday_from_day_of_month(F.col("a"))).collect())
    assert [tuple(r) for r in got] == [(0, 4), (4, 4)]


def test_slot_clock_wraps_the_week(spark):
    day, hour = calendar.slot_clock(F.lit(1), start_day=6, start_hour=23)
    assert tuple(spark.range(1).select(day, hour).first()) == (0, 0)


def test_unit_hash_is_uniform_and_repeatable(spark):
    u = spark.range(20000).select(hashing.unit_hash("id").alias("u"))
    low, high, mean = u.agg(F.min("u"), F.max("u"), F.avg("u")).first()
    assert 0 <= low and high < 1 and abs(mean - 0.5) < 0.01


def test_reward_scales(spark):
    rows = spark.createDataFrame([(500.0, 2), (50.0, 2), (50.0, 0)], "reward double, n_taxis int")
    assert [r[0] for r in rows.select(menu.reward_per_taxi()).collect()] == [1.0, 0.25, 0.0]
    assert [r[0] for r in rows.select(menu.reward_share(normalizer=100.0)).collect()] == [1.0, 0.5, 0.5]


def test_inventory_bins(spark):
    rows = spark.createDataFrame([(0,), (9,), (10,), (500,)], "n int")
    assert [r[0] for r in rows.select(menu.inventory_bin("n")).collect()] == [0, 0, 1, 9]


@pytest.mark.parametrize(
    "fleet, total, split",
    [(5000, 5000, [1250] * 4), ([5000], 5000, [1250] * 4), ([2900, 700, 700, 700], 5000, [2900, 700, 700, 700])],
)
def test_fleet_sizes(fleet, total, split):
    assert market.total_fleet(fleet) == total
    assert market.platform_fleets(fleet) == split


@pytest.mark.parametrize("fleet", [[2500, 2500], [], "5000"])
def test_fleet_of_wrong_length(fleet):
    for parse in (market.total_fleet, market.platform_fleets):
        with pytest.raises(ValueError, match="the number of inputs is not equal to the number of agents."):
            parse(fleet)
