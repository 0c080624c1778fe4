"""Clipped bandit weights over a stream of decisions, followed in the order of their times.

The clipped update depends on the order of an arm's decisions, and a stream brings them in any order. Each arm keeps
its decisions by period until the watermark has passed the period's end; a timer then follows them in order.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from curbside.functions.menu import within
from curbside.operators.learning import IDS, N_ACTIONS
from curbside.operators.replay import follow_exp3

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Rows come as named tuples, whose names must not begin with an underscore.
FIELDS = ["at__", "step__", "action__", "gain__"]
WAITING = "`at` array<bigint>, `step` array<bigint>, `action` array<int>, `gain` array<double>"

#: So many decisions of an arm wait in one value, whatever their periods; more of them wait by period.
FEW = 500


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state on disk, as timers need; the session's own setting comes back after."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


class OrderedWeights(StatefulProcessor):
    """State of an arm: its weights, and the decisions of periods that are still open.

    Each call to the state costs more than the decision itself, so up to `FEW` decisions wait in one value, and only the
    earliest open period has a timer. Those beyond that wait in parts by period as they came: a batch appends parts and
    reads none, so an arm with many decisions costs no more for those that wait already. A task holds the few and the
    decisions of one arm and one period at a time.
    """

    def __init__(self, ids: list[str], period_ms: int, eta: float, gamma: float, n_actions: int):
        self.ids, self.period_ms, self.eta, self.gamma, self.n_actions = ids, period_ms, eta, gamma, n_actions
        self.few = FEW

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.learned = handle.getValueState("learned", "weights array<double>, n_updates bigint")
        # how many parts there are or were, when the earliest open period ends (null: nothing waits), and the few
        self.open = handle.getValueState("open", f"parts bigint, ends bigint, {WAITING}")
        self.waiting = handle.getMapState("waiting", "period bigint, part bigint", WAITING)

    def handleInputRows(self, key, rows, timerValues):
        n, ends, *few = self.open.get() or (0, None, [], [], [], [])
        before = ends
        for batch in rows:
            first = (int(batch["period__"].min()) + 1) * self.period_ms
            ends = first if ends is None else min(ends, first)
            if len(few[0]) + len(batch) <= self.few:
                few = [[*old, *batch[c].tolist()] for old, c in zip(few, FIELDS)]
                continue
            for period, some in batch.groupby("period__"):
                self.waiting.updateValue((int(period), n), tuple(some[c].tolist() for c in FIELDS))
                n += 1
        if ends != before:
            self.handle.registerTimer(ends)
        self.open.update((n, ends, *few))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        closed = timerValues.getCurrentWatermarkInMs()
        n, ends, *few = self.open.get() or (0, None, [], [], [], [])
        if ends is None or ends > closed:  # an earlier timer of this batch has followed them
            return
        parts = sorted(tuple(k) for k in self.waiting.keys()) if n else []
        wait = [(r[0] // (1000 * self.period_ms), None, r) for r in zip(*few)]
        wait += [(period, part, None) for period, part in parts]
        wait.sort(key=itemgetter(0))
        before, n_updates = self.learned.get() or (None, 0)
        weights = list(before) if before else [0.0] * self.n_actions
        left = []
        for period, same in groupby(wait, key=itemgetter(0)):
            if (period + 1) * self.period_ms > closed:
                left.extend(same)
                continue
            rows = []
            for _, part, row in same:
                if part is None:
                    rows.append(row)
                else:
                    rows.extend(zip(*self.waiting.getValue((period, part))))
                    self.waiting.removeKey((period, part))
            rows.sort()
            weights = follow_exp3(weights, [r[2] for r in rows], [r[3] for r in rows], self.eta, self.gamma)
            n_updates += len(rows)
        if left:
            ends = (left[0][0] + 1) * self.period_ms
            self.handle.registerTimer(ends)
            few = [[r[c] for _, _, r in left if r is not None] for c in range(len(FIELDS))]
            self.open.update((n if any(r is None for _, _, r in left) else 0, ends, *few))
        else:
            self.open.clear()
        self.learned.update((weights, n_updates))
        changed = [a for a in range(self.n_actions) if before is None or weights[a] != before[a]]
        if changed:
            yield pd.DataFrame(
                {c: [v] * len(changed) for c, v in zip(self.ids, key)}
                | {"action": changed, "log_w": [weights[a] for a in changed], "n_updates": [n_updates] * len(changed)}
            )

    def close(self) -> None:
        pass


def ordered_weights(
    log: DataFrame, reward: Column, at: str, lateness: str = "2 hours", period_seconds: int = 3600, eta: float = 0.1,
    gamma: float = 0.1, n_actions: int = N_ACTIONS, ids=IDS,
) -> DataFrame:
    """Clipped EXP3 log weights (ids, action, log_w, n_updates) as `exp3_stable` has them, from a stream; update mode.

    Decisions count in the order of (`at`, `step`), whatever order they come in, once their period has closed; those
    later than `lateness` behind the newest are dropped, and those of open periods wait. A batch gives the pairs it has
    changed, once each; an arm's first rows give all its pairs. A decision without a time, or with an action outside
    the menu, fails the job. Start the query inside `keyed_state`.
    """
    period_ms = 1000 * period_seconds
    untimed = F.raise_error(F.lit("a decision has no time")).cast("timestamp")
    rows = (
        log.withColumn(at, F.coalesce(F.col(at).cast("timestamp"), untimed))
        .withWatermark(at, lateness)
        .select(
            *ids,
            at,
            F.floor(F.unix_millis(at) / period_ms).cast("bigint").alias("period__"),
            F.unix_micros(at).alias("at__"),
            F.col("step").cast("bigint").alias("step__"),
            within("action", n_actions, "action").cast("int").alias("action__"),
            reward.cast("double").alias("gain__"),
        )
    )
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in log.select(*ids).schema)
    return rows.groupBy(*ids).transformWithStateInPandas(
        OrderedWeights(list(ids), period_ms, eta, gamma, n_actions),
        f"{names}, action int, log_w double, n_updates bigint",
        "Update",
        "eventtime",
    )
