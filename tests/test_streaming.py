import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from curbside.operators.replay import exp3_stable
from curbside.streaming import live, ordered


def test_late_requests_are_dropped_and_hours_close_once(spark, tmp_path):
    def save(name, rows):
        spark.createDataFrame(rows, "request_datetime timestamp_ntz, PULocationID int").coalesce(1).write.parquet(str(tmp_path / "in" / name))

    start = dt.datetime(2026, 1, 5)
    save("a", [(start + dt.timedelta(minutes=m), 1) for m in (5, 10, 70)])
    folder, out, state = str(tmp_path / "in" / "*"), str(tmp_path / "out"), str(tmp_path / "state")
    schema = "request_datetime timestamp_ntz, PULocationID int"

    def run():
        live.append_to(live.hourly_requests(live.stream_parquet(spark, folder, schema)), out, state).awaitTermination()

    run()
    save("b", [(start + dt.timedelta(hours=6), 1)])
    run()
    save("c", [(start + dt.timedelta(minutes=20), 1), (start + dt.timedelta(hours=12), 2)])
    run()
    got = {(r.hour_start, r.PULocationID): r.num_trips for r in spark.read.parquet(out).collect()}
    assert got[start, 1] == 2  # the row of minute 20 came after the hour had closed
    assert got[start + dt.timedelta(hours=1), 1] == 1 and got[start + dt.timedelta(hours=6), 1] == 1
    assert all(zone != 2 for _, zone in got)  # its hour is still open


def test_running_weights_add_up_over_batches(spark, tmp_path):
    schema = "run string, agent int, arm int, action int, reward double, prob double"
    folder, out, state = str(tmp_path / "in" / "*"), str(tmp_path / "out"), str(tmp_path / "state")
    for name, rewards in (("a", (1.0, 2.0)), ("b", (3.0,))):
        rows = [("r", 0, 1, 0, r, 0.5) for r in rewards]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / name))
        weights = live.running_weights(live.stream_parquet(spark, folder, schema), F.col("reward"), 0.1)
        live.changes_to(weights, out, state).awaitTermination()
    assert abs(live.current_rows(spark, out, ["run", "agent", "arm", "action"]).first().log_w - 1.2) < 1e-12


def test_a_batch_writes_only_what_it_changed(spark, tmp_path):
    """Many arms in the first batch, one in the second: the second writes one row, and the result is that of both at once."""
    schema = "run string, agent int, arm int, action int, reward double, prob double"
    folder, out, state = str(tmp_path / "in" / "*"), str(tmp_path / "out"), str(tmp_path / "state")
    batches = [[("r", 0, arm, arm % 5, 1.0 + arm, 0.5) for arm in range(500)], [("r", 0, 7, 2, 4.0, 0.5), ("r", 0, 7, 2, 1.0, 0.25)]]
    for name, rows in zip("ab", batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / name))
        live.changes_to(live.running_weights(live.stream_parquet(spark, folder, schema), F.col("reward"), 0.1), out, state).awaitTermination()
    written = {r["batch"]: r["count"] for r in spark.read.parquet(out).groupBy("batch").count().collect()}
    assert sorted(written.values()) == [1, 500]
    now = {(r.arm, r.action): r.log_w for r in live.current_rows(spark, out, ["run", "agent", "arm", "action"]).collect()}
    every = live.running_weights(spark.createDataFrame(batches[0] + batches[1], schema), F.col("reward"), 0.1).collect()
    assert now == {(r.arm, r.action): r.log_w for r in every}


DECISIONS = "run string, agent int, arm int, episode int, step int, action int, reward double, at timestamp"
START = dt.datetime(2026, 1, 5)


def decision(arm, minute, action=None, reward=None):
    """One whose place in its arm's log is its minute."""
    reward = (minute * 7 + arm) % 10 / 10 if reward is None else reward
    return ("r", 0, arm, 0, minute, (minute + arm) % 5 if action is None else action, reward, START + dt.timedelta(minutes=minute))


@pytest.fixture
def follow(spark, tmp_path):
    """Adds rows to the stream, runs it, and gives the rows that each batch has written."""
    folder, out, state = (str(tmp_path / name) for name in ("in", "out", "state"))

    def run(rows):
        spark.createDataFrame(rows, DECISIONS).coalesce(1).write.mode("append").parquet(folder)
        weights = ordered.ordered_weights(live.stream_parquet(spark, folder, DECISIONS), F.col("reward"), "at")
        with ordered.keyed_state(spark):
            live.changes_to(weights, out, state).awaitTermination()
        return live.current_rows(spark, out, ["run", "agent", "arm", "action"]), spark.read.parquet(out)

    return run


def test_ordered_weights_are_those_of_the_log_in_order(spark, follow):
    """Rows of an arm out of order, within a file and over two; an hour counts once the watermark has passed its end."""
    every = [decision(arm, minute) for arm in (1, 2, 3) for minute in range(0, 360, 7)]
    first, later = [r for r in every if r[4] % 2 and r[4] < 200], [r for r in every if not (r[4] % 2 and r[4] < 200)]
    late = [r for r in later if r[4] <= 69]  # the newest of the first file, 189, less two hours
    follow(first[::-1])
    now, _ = follow(later[::-1])
    taken = [r for r in first + later if r not in late and r[4] < 180]
    twin = exp3_stable(spark.createDataFrame(taken, DECISIONS), F.col("reward"))
    assert late and {(r.arm, r.action): r.log_w for r in now.collect()} == {(r.arm, r.action): r.log_w for r in twin.collect()}
    assert {r.arm: r.n_updates for r in now.collect()} == {a: sum(r[2] == a for r in taken) for a in (1, 2, 3)}


def test_ordered_weights_write_only_what_a_batch_changed(spark, follow):
    follow([decision(arm, 5, 0, 1.0) for arm in range(100)] + [decision(999, 300, 0, 1.0)])
    _, written = follow([decision(7, 200, 1, 1.0), decision(999, 700, 0, 1.0)])
    by_batch = {b: {r.arm for r in rows} for b, rows in _by(written.collect(), "batch")}
    assert list(map(len, by_batch.values())) == [100, 2] and list(by_batch.values())[1] == {7, 999}
    assert max(r.n_updates for r in written.where("arm = 7").collect()) == 2


def test_ordered_weights_are_none_while_the_period_is_open(follow):
    now, written = follow([decision(1, 0), decision(1, 170)])
    assert {r.n_updates for r in now.collect()} in (set(), {0})
    assert written.isEmpty()


@pytest.mark.parametrize("few", [0, 25, 500])
def test_ordered_weights_are_the_same_however_decisions_wait(spark, tmp_path, monkeypatch, few):
    """In one value, in parts by period, or some of each; over two files whose second has earlier and later periods."""
    monkeypatch.setattr(ordered, "FEW", few)
    rows = [[decision(arm, minute) for arm in (1, 2) for minute in some] for some in ((130, 150, *range(180, 240, 3)), range(121, 480, 11))]
    for part in rows:
        spark.createDataFrame(part[::-1], DECISIONS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        weights = ordered.ordered_weights(live.stream_parquet(spark, str(tmp_path / "in"), DECISIONS), F.col("reward"), "at")
        with ordered.keyed_state(spark):
            live.changes_to(weights, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    now = live.current_rows(spark, str(tmp_path / "out"), ["run", "agent", "arm", "action"])
    taken = [r for r in rows[0] + rows[1] if r[4] < 300]  # the newest, 473, less two hours
    twin = exp3_stable(spark.createDataFrame(taken, DECISIONS), F.col("reward"))
    assert {(r.arm, r.action): r.log_w for r in now.collect()} == {(r.arm, r.action): r.log_w for r in twin.collect()}


class State:
    """A state variable that counts the calls to it."""

    def __init__(self, calls):
        self.calls, self.value = calls, None

    def get(self):
        self.calls.append("get")
        return self.value

    def exists(self):
        self.calls.append("exists")
        return self.value is not None

    def update(self, value):
        self.calls.append("update")
        self.value = value

    def clear(self):
        self.calls.append("clear")
        self.value = None

    def updateValue(self, key, value):
        self.calls.append("updateValue")

    def getValueState(self, *_):
        return State(self.calls)

    getMapState = getValueState

    def registerTimer(self, _):
        self.calls.append("registerTimer")


def test_an_arm_of_many_periods_takes_few_calls_to_its_state():
    processor, calls = ordered.OrderedWeights(["arm"], 1000, 0.1, 0.1, 5), []
    processor.init(State(calls))
    rows = pd.DataFrame({"period__": range(30), "at__": [1_000_000 * i for i in range(30)], "step__": range(30), "action__": [0] * 30, "gain__": [0.5] * 30})
    list(processor.handleInputRows((1,), iter([rows]), None))
    assert len(calls) <= 4


@pytest.mark.parametrize("wrong", [decision(1, 0, 5), (*decision(1, 0)[:-1], None)])
def test_ordered_weights_fail_on_what_they_cannot_place(follow, wrong):
    with pytest.raises(Exception, match="there is no action 5|has no time"):
        follow([wrong])


def _by(rows, name):
    for value in sorted({r[name] for r in rows}):
        yield value, [r for r in rows if r[name] == value]
