import pytest
from pyspark.sql import functions as F

from curbside.operators import reports


@pytest.fixture(scope="module")
def timeline(spark):
    rows = [(i, k, float(10 * k + i)) for i in range(6) for k in range(3) if not (i == 2 and k == 1)]
    return spark.createDataFrame(rows, "iteration int, firm_id int, profit double")


def test_wide_form_fills_missing_cells_and_firms(timeline):
    rows = {r.iteration: r for r in reports.firm_columns(timeline, "profit").collect()}
    assert rows[2].firm_1 == 0.0 and rows[3].firm_1 == 13.0 and all(r.firm_3 == 0.0 for r in rows.values())


def test_phase_summary_uses_the_filled_grid(timeline):
    rows = {r.firm_id: r for r in reports.phase_summary(timeline, 0, [100, 50, 10, 10], 2, 4).collect()}
    assert rows[1].before_freeze_mean_revenue == 10.5 and rows[1].freeze_phase_mean_revenue == 6.5
    assert rows[0].role == "deviator" and rows[1].role == "frozen_then_unfrozen"
    assert rows[1].final_cumulative_rev_per_taxi == (10 + 11 + 0 + 13 + 14 + 15) / 50
    late = {r.firm_id: r for r in reports.phase_summary(timeline, 0, 400, 10, 20, reset=True).collect()}
    assert late[0].freeze_phase_mean_revenue is None and late[1].role == "frozen_reset_learning"


def test_phase_bounds():
    assert reports.phase_bounds(70, 70) == (70, 140) and reports.phase_bounds(70, 70, 100) == (70, 100)
    with pytest.raises(ValueError, match="no iteration is frozen"):
        reports.phase_bounds(70, 70, 70)


def test_value_column(spark):
    def frame(schema):
        return spark.createDataFrame([], schema)

    assert reports.value_column(frame("Episode int, profit double, Revenue string")) == "Revenue"
    assert reports.value_column(frame("Episode int, a double, b double, note string")) == "b"
    assert reports.value_column(frame("Episode int, a double"), "a") == "a"
    with pytest.raises(ValueError):
        reports.value_column(frame("Episode int, a double"), "z")
    with pytest.raises(ValueError):
        reports.value_column(frame("Episode int, note string"))


def test_interval_labels_drop_the_partial_interval(spark):
    log = spark.createDataFrame([("r", 0, 1, e, e % 5) for e in range(25)], "run string, agent int, arm int, episode int, action int")
    out = reports.interval_multipliers(log, 25)
    assert out.columns[3:] == ["0-10", "10-20"]
    assert out.first()["0-10"] == 1.5


def test_moving_window_one_is_identity(timeline):
    out = reports.centered_mean(timeline, ["firm_id"], "profit", window=1)
    assert out.where(F.col("moving_avg") != F.col("profit")).isEmpty()


def test_sweeps(spark):
    grid = reports.sweep_grid(spark.createDataFrame([(42,), (43,)], "seed int"))
    assert grid.count() == 8
    log = spark.createDataFrame([(0, 42, 1.5, True), (1, 42, 2.5, False)], "deviator int, seed int, duration double, success boolean")
    assert tuple(reports.sweep_summary(log).first()) == (2, 1, 1, 4.0)
    assert reports.failed_runs(log).first().deviator == 1
