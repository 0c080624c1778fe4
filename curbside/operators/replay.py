"""Order-dependent updates replayed over long decision logs.

An ordered update over one arm's whole log would put that log in one task. The log is cut into
chunks of bounded length instead, packed one row per chunk, and the update runs inside a chunk.

Two ways carry the state from chunk to chunk, both exact:

* `settle`  - all chunks run at once from a guessed start; chunks whose start was wrong run again
  with the values their predecessors left, until every start is right. Action values forget their
  start, so long chunks settle in a few rounds however many there are.
* `advance` - round k runs chunk k of every arm. For updates that never forget.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from curbside.functions.hashing import unit_hash
from curbside.functions.menu import within
from curbside.operators.learning import FLOOR, IDS, N_ACTIONS, WEIGHT_LIMIT
from curbside.sources.staging import stage

CHUNK = 131072
N_STATES = 10
#: Tables of values that a task holds before it sends them on.
SNAPSHOTS = 1024


# --- chunks ---------------------------------------------------------------------------------


def with_chunks(log: DataFrame, size: int = CHUNK, ids=IDS) -> DataFrame:
    """Add `chunk`, numbered along (episode, step) per arm; a chunk has fewer than 2 * size rows.

    (arm, episode, step) is a key, so a range of `size` steps of one episode is at most `size`
    rows. Consecutive ranges are joined up to that length from their counts alone.
    """
    part = F.floor(F.col("step") / F.lit(size)).cast("bigint")
    log = log.withColumn("_part", part)
    before = Window.partitionBy(*ids).orderBy("episode", "_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        log.groupBy(*ids, "episode", "_part")
        .agg(F.count("*").alias("_n"))
        .withColumn("chunk", F.floor(F.coalesce(F.sum("_n").over(before), F.lit(0)) / size).cast("int"))
        .drop("_n")
    )
    return log.join(parts, [*ids, "episode", "_part"]).drop("_part")


def pack_chunks(log: DataFrame, fields: dict[str, Column], size: int = CHUNK, ids=IDS) -> DataFrame:
    """One row per (arm, chunk) with each field as an array in (episode, step) order."""
    rows = with_chunks(log, size, ids).select(
        *ids, "chunk", F.struct("episode", "step", *[c.alias(n) for n, c in fields.items()]).alias("_r")
    )
    packed = rows.groupBy(*ids, "chunk").agg(F.array_sort(F.collect_list("_r")).alias("_r"))
    return packed.select(*ids, "chunk", *[F.col(f"_r.{n}").alias(n) for n in fields])


def with_next(chunks: DataFrame, fields: list[str], ids=IDS) -> DataFrame:
    """For each array field an array `<field>_next` with the values of the rows that follow, over the chunks' bounds.
    The arm's last row has null. Only the first row of each chunk moves. `chunks` must be staged."""
    first = F.struct(*[F.get(f, F.lit(0)).alias(f) for f in fields])
    after = F.lead(first).over(Window.partitionBy(*ids).orderBy("chunk"))
    heads = chunks.select(*ids, "chunk", after.alias("_after"))
    shifted = {f"{f}_next": F.concat(F.slice(f, 2, F.size(f)), F.array(F.col(f"_after.{f}"))) for f in fields}
    return chunks.join(heads, [*ids, "chunk"]).withColumns(shifted).drop("_after")


# --- carrying state -------------------------------------------------------------------------


def _zeros(width: int) -> Column:
    return F.array_repeat(F.lit(0.0), width)


def _last_chunk(chunks: DataFrame) -> int:
    return chunks.agg(F.max("chunk")).first()[0] or 0


def settle(
    chunks: DataFrame, fold: Callable[[], Column], touched: Column, width: int, ids=IDS,
    init: DataFrame | None = None,
) -> DataFrame:
    """Final `values` array per arm, from `settled_chunks`."""
    ends, several = settled_chunks(chunks, fold, touched, width, ids, init)
    if not several:
        return ends.select(*ids, F.col("end").alias("values"))
    # the last chunk's end holds every entry: its start was right, and the rest it updated itself
    return ends.groupBy(*ids).agg(F.max_by("end", "chunk").alias("values"))


def settled_chunks(
    chunks: DataFrame, fold: Callable[[], Column], touched: Column, width: int, ids=IDS,
    init: DataFrame | None = None,
) -> tuple[DataFrame, bool]:
    """`start` and `end` values of every chunk (ids, chunk), and whether any arm has more than one.

    `fold()` maps `start` and the packed fields to the end values.
    `touched` is the array of entries a chunk updates; all others pass through it unchanged, so
    an entry's start is the end value of the last earlier chunk that touched it.
    `chunks` must be staged. `init` gives each arm's first start (default zeros).
    """
    first = (
        chunks.withColumn("start", _zeros(width))
        if init is None
        else chunks.join(init.withColumnRenamed("values", "start"), ids)
    )
    if _last_chunk(chunks) == 0:
        return first.withColumn("end", fold()).select(*ids, "chunk", "start", "end"), False

    origin = first.select(*ids, "chunk", F.col("start").alias("origin"))
    ends = stage(first.withColumn("end", fold()).select(*ids, "chunk", touched.alias("touched"), "start", "end"), "replay")
    along = Window.partitionBy(*ids, "entry").orderBy("chunk")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    while True:
        left_behind = ends.join(origin, [*ids, "chunk"]).select(
            *ids, "chunk", "touched", "start", "end", "origin", F.posexplode("end").alias("entry", "value")
        )
        mine = F.when(F.array_contains("touched", F.col("entry")), F.col("value"))
        starts = (
            left_behind.withColumn("mine", mine)
            .withColumn("v", F.last("mine", ignorenulls=True).over(earlier))
            .withColumn("v", F.coalesce("v", F.get("origin", F.col("entry"))))
            .groupBy(*ids, "chunk")
            .agg(F.array_sort(F.collect_list(F.struct("entry", "v"))).alias("s"))
            .select(*ids, "chunk", F.col("s.v").alias("right_start"))
        )
        wrong = stage(
            ends.join(starts, [*ids, "chunk"]).where(~(F.col("start") == F.col("right_start"))).select(
                *ids, "chunk", F.col("right_start").alias("start")
            ),
            "replay-starts",
        )
        if wrong.isEmpty():
            break
        again = chunks.join(wrong, [*ids, "chunk"]).withColumn("end", fold())
        ends = stage(
            ends.join(wrong.select(*ids, "chunk"), [*ids, "chunk"], "left_anti").unionByName(
                again.select(*ids, "chunk", touched.alias("touched"), "start", "end")
            ),
            "replay",
        )
    return ends.select(*ids, "chunk", "start", "end"), True


def advance(chunks: DataFrame, fold: Callable[[], Column], width: int, ids=IDS) -> DataFrame:
    """Final `values` per arm, carrying the state through the chunks in order.

    `chunks` must be staged by chunk (`partition_by="chunk"`): round k reads chunk k only, so all rounds together read
    the log once. Only arms that have a chunk left are carried on; an arm's chunks are numbered without gaps.
    """
    lasts = stage(chunks.groupBy(*ids).agg(F.max("chunk").alias("last")), "replay-lasts")
    end = lasts.agg(F.max("last")).first()[0] or 0
    state = lasts.withColumn("start", _zeros(width))
    rounds = []
    for k in range(end + 1):
        now = chunks.where(F.col("chunk") == k).join(state, ids)
        done = now.withColumn("values", fold()).select(*ids, "last", "values", F.lit(k).alias("round"))
        if not end:
            return done.select(*ids, "values")
        rounds.append(stage(done, "replay-round"))
        state = rounds[-1].where(F.col("last") > k).select(*ids, "last", F.col("values").alias("start"))
    paths = [f.rsplit("/", 1)[0] for done in rounds for f in done.inputFiles()[:1]]
    every = chunks.sparkSession.read.schema(rounds[0].schema).parquet(*paths)
    return every.where(F.col("last") == F.col("round")).select(*ids, "values")


def value_table(values: DataFrame, n_actions: int = N_ACTIONS, ids=IDS) -> DataFrame:
    """(ids, state, action, q) from the packed values."""
    return values.select(*ids, F.posexplode("values").alias("_k", "q")).select(
        *ids,
        F.floor(F.col("_k") / n_actions).cast("int").alias("state"),
        (F.col("_k") % n_actions).cast("int").alias("action"),
        "q",
    )


# --- updates --------------------------------------------------------------------------------


def _entry(n_states: int, n_actions: int) -> Column:
    """Where the value of a row's state and action stands; a state or action that there is not is an error."""
    return (within("state", n_states, "state") * n_actions + within("action", n_actions, "action")).cast("int")


def _next_state(n_states: int) -> Column:
    after = F.when(F.col("next_state").isNotNull(), within("next_state", n_states, "state"))
    return F.coalesce(after, F.lit(-1)).cast("int")


def _q_udf(alpha: float, discount: float, n_actions: int):
    @F.pandas_udf("array<double>")
    def fold(start: pd.Series, k: pd.Series, nxt: pd.Series, r: pd.Series) -> pd.Series:
        out = []
        for q0, ks, ns, rs in zip(start, k, nxt, r):
            q = q0.tolist()
            for i, n, reward in zip(ks.tolist(), ns.tolist(), rs.tolist()):
                future = max(q[n * n_actions : (n + 1) * n_actions]) if n >= 0 else 0.0
                q[i] += alpha * (reward + discount * future - q[i])
            out.append(q)
        return pd.Series(out)

    return fold


def q_replay(
    log: DataFrame, reward: Column, alpha: float = 0.05, discount: float = 0.95, n_states: int = N_STATES,
    n_actions: int = N_ACTIONS, size: int = CHUNK, ids=IDS,
) -> DataFrame:
    """Q-learning over each arm's log in (episode, step) order; a null next state has no future."""
    fields = {"k": _entry(n_states, n_actions), "nxt": _next_state(n_states), "r": reward.cast("double")}
    chunks = stage(pack_chunks(log, fields, size, ids), "q-chunks")
    fold = _q_udf(alpha, discount, n_actions)
    values = settle(chunks, lambda: fold("start", "k", "nxt", "r"), F.array_distinct("k"), n_states * n_actions, ids)
    return value_table(values, n_actions, ids)


def episode_values(
    log: DataFrame, reward: Column, alpha: float = 0.05, discount: float = 0.95, n_states: int = N_STATES,
    n_actions: int = N_ACTIONS, size: int = CHUNK, ids=IDS,
) -> DataFrame:
    """The action values of `q_replay` as they stand at the end of each episode: (ids, episode, state, action, q).

    First all chunks are settled; then each is followed once more from its right start and leaves its values
    wherever an episode ends. An episode that goes on in the next chunk ends there. A task holds one chunk and at most
    `SNAPSHOTS` tables of values, however many episodes there are.
    """
    fields = {"k": _entry(n_states, n_actions), "nxt": _next_state(n_states), "r": reward.cast("double"), "e": F.col("episode").cast("bigint")}
    chunks = stage(pack_chunks(log, fields, size, ids), "episode-chunks")
    fold = _q_udf(alpha, discount, n_actions)
    ends, _ = settled_chunks(chunks, lambda: fold("start", "k", "nxt", "r"), F.array_distinct("k"), n_states * n_actions, ids)
    closes = F.zip_with("e", "e_next", lambda x, y: ~x.eqNullSafe(y))
    rows = with_next(chunks, ["e"], ids).withColumn("closes", closes).join(ends.select(*ids, "chunk", "start"), [*ids, "chunk"])
    rows = rows.select(*ids, "start", "k", "nxt", "r", "e", "closes")
    kinds = [pa.field(f.name, to_arrow_type(f.dataType)) for f in rows.select(*ids).schema]
    schema = pa.schema([*kinds, ("episode", pa.int64()), ("values", pa.list_(pa.float64()))])
    many = len(ids)

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                q, *lists = (batch.column(c)[at].values.to_numpy(zero_copy_only=False).tolist() for c in ("start", "k", "nxt", "r", "e", "closes"))
                episodes, values = [], []

                def found() -> pa.RecordBatch:
                    own = [batch.column(c).take(pa.array([at] * len(episodes))) for c in range(many)]
                    return pa.RecordBatch.from_arrays([*own, pa.array(episodes, pa.int64()), pa.array(values, pa.list_(pa.float64()))], schema=schema)

                for i, n, gain, episode, closed in zip(*lists):
                    future = max(q[n * n_actions : (n + 1) * n_actions]) if n >= 0 else 0.0
                    q[i] += alpha * (gain + discount * future - q[i])
                    if closed:
                        episodes.append(episode)
                        values.append(q[:])
                        if len(episodes) == SNAPSHOTS:
                            yield found()
                            episodes, values = [], []
                if episodes:
                    yield found()

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*ids).schema)
    snapshots = rows.mapInArrow(follow, f"{names}, episode bigint, `values` array<double>")
    return value_table(snapshots, n_actions, [*ids, "episode"])


def sarsa_replay(
    log: DataFrame, reward: Column, alpha: float = 0.05, discount: float = 0.95, n_states: int = N_STATES,
    n_actions: int = N_ACTIONS, size: int = CHUNK, ids=IDS,
) -> DataFrame:
    """SARSA over each arm's log: the target uses the next logged action.

    A `next_action` column is used if the log has one, else the action of the following row of the same
    episode. A row without such an action, as the last of each episode, has no future.
    """
    fields = {
        "k": _entry(n_states, n_actions),
        "nxt": _next_state(n_states),
        "a": F.col("action").cast("int"),
        "r": reward.cast("double"),
    }
    if "next_action" in log.columns:
        fields["a"] = F.coalesce(F.col("next_action"), F.lit(-1)).cast("int")
    else:
        fields["e"] = F.col("episode")
    chunks = pack_chunks(log, fields, size, ids)
    if "next_action" not in log.columns:
        same = F.zip_with("e", "e_next", lambda x, y: x == y)
        chunks = (
            with_next(stage(chunks, "sarsa-log"), ["a", "e"], ids)
            .withColumn("a", F.zip_with("a_next", same, lambda a, s: F.when(s, a).otherwise(F.lit(-1))))
            .drop("a_next", "e_next", "e")
        )
    chunks = stage(chunks, "sarsa-chunks")

    @F.pandas_udf("array<double>")
    def fold(start: pd.Series, k: pd.Series, nxt: pd.Series, a: pd.Series, r: pd.Series) -> pd.Series:
        out = []
        for q0, ks, ns, acts, rs in zip(start, k, nxt, a, r):
            q = q0.tolist()
            for i, n, act, reward_ in zip(ks.tolist(), ns.tolist(), acts.tolist(), rs.tolist()):
                future = q[n * n_actions + act] if n >= 0 and act >= 0 else 0.0
                q[i] += alpha * (reward_ + discount * future - q[i])
            out.append(q)
        return pd.Series(out)

    values = settle(
        chunks, lambda: fold("start", "k", "nxt", "a", "r"), F.array_distinct("k"), n_states * n_actions, ids
    )
    return value_table(values, n_actions, ids)


def double_q_replay(
    log: DataFrame, reward: Column, alpha: float = 0.05, discount: float = 0.95, n_states: int = N_STATES,
    n_actions: int = N_ACTIONS, seed: int = 42, size: int = CHUNK, ids=IDS,
) -> DataFrame:
    """Double Q-learning; the coin of each step is a hash of its key. Columns q1 and q2."""
    width = n_states * n_actions
    coin = unit_hash(*ids, "episode", "step", seed=seed) < 0.5
    fields = {
        "k": _entry(n_states, n_actions) + F.when(coin, 0).otherwise(width),
        "nxt": _next_state(n_states),
        "r": reward.cast("double"),
    }
    chunks = stage(pack_chunks(log, fields, size, ids), "double-q-chunks")

    @F.pandas_udf("array<double>")
    def fold(start: pd.Series, k: pd.Series, nxt: pd.Series, r: pd.Series) -> pd.Series:
        out = []
        for q0, ks, ns, rs in zip(start, k, nxt, r):
            q = q0.tolist()
            for i, n, reward_ in zip(ks.tolist(), ns.tolist(), rs.tolist()):
                future = 0.0
                if n >= 0:
                    own, other = (0, width) if i < width else (width, 0)
                    row = q[own + n * n_actions : own + (n + 1) * n_actions]
                    future = q[other + n * n_actions + row.index(max(row))]
                q[i] += alpha * (reward_ + discount * future - q[i])
            out.append(q)
        return pd.Series(out)

    values = settle(chunks, lambda: fold("start", "k", "nxt", "r"), F.array_distinct("k"), 2 * width, ids)
    halves = values.select(*ids, F.slice("values", 1, width).alias("a"), F.slice("values", width + 1, width).alias("b"))
    pairs = halves.select(*ids, F.posexplode(F.arrays_zip("a", "b")).alias("_k", "v"))
    return pairs.select(
        *ids,
        F.floor(F.col("_k") / n_actions).cast("int").alias("state"),
        (F.col("_k") % n_actions).cast("int").alias("action"),
        F.col("v.a").alias("q1"),
        F.col("v.b").alias("q2"),
    )


def follow_exp3(w: list[float], actions: list[int], gains: list[float], eta: float, gamma: float) -> list[float]:
    """Log weights after the clipped EXP3 update of each (action, gain) in turn, from the weights `w`."""
    n_actions = len(w)
    for act, gain in zip(actions, gains):
        top = max(w)
        e = [math.exp(min(max(x - top, -WEIGHT_LIMIT), 0.0)) for x in w]
        total = max(sum(e), FLOOR)
        p = [max((1.0 - gamma) * x / total + gamma / n_actions, FLOOR) for x in e]
        p_act = max(p[act] / sum(p), FLOOR)
        w = [*w[:act], w[act] + eta * min(max(gain / p_act, 0.0), WEIGHT_LIMIT), *w[act + 1 :]]
        top = max(w)
        w = [min(max(x - top, -WEIGHT_LIMIT), 0.0) for x in w]
    return w


def exp3_stable(
    log: DataFrame, reward: Column, eta: float = 0.1, gamma: float = 0.1, n_actions: int = N_ACTIONS,
    size: int = CHUNK, ids=IDS,
) -> DataFrame:
    """Clipped EXP3 log weights (ids, action, log_w).

    The probability of each step comes from the running weights and both clips break additivity,
    so the log is followed in order. `reward` is already scaled into [0, 1] (`reward_share`).
    """
    fields = {"a": within("action", n_actions, "action").cast("int"), "r": reward.cast("double")}
    chunks = stage(pack_chunks(log, fields, size, ids), "exp3-chunks", partition_by="chunk")

    @F.pandas_udf("array<double>")
    def fold(start: pd.Series, a: pd.Series, r: pd.Series) -> pd.Series:
        ends = [follow_exp3(w.tolist(), acts.tolist(), rs.tolist(), eta, gamma) for w, acts, rs in zip(start, a, r)]
        return pd.Series(ends)

    values = advance(chunks, lambda: fold("start", "a", "r"), n_actions, ids)
    return values.select(*ids, F.posexplode("values").alias("action", "log_w"))


# --- index learning -------------------------------------------------------------------------


def _index_udf(outer: int, alpha: float, eta: float, discount: float, tolerance: float, n_states: int):
    """All rounds of `whittle_learning` for arms whose log is one chunk: the same steps, for the arms of a batch at once."""

    @F.pandas_udf("index array<double>, gap array<double>, rounds int, converged boolean")
    def learn(k: pd.Series, nxt: pd.Series, r: pd.Series, passive: pd.Series) -> pd.DataFrame:
        many = k.map(len).to_numpy()
        arms = np.argsort(-many, kind="stable")  # longest first: those with a step t stand in front
        starts, many = (np.cumsum(many) - many)[arms], many[arms]
        k, nxt, r, passive = (np.concatenate(c.to_list()) if len(c) else np.zeros(0) for c in (k, nxt, r, passive))
        n = len(arms)
        found = {"index": np.zeros((n, n_states)), "gap": np.full((n, n_states), np.inf), "rounds": np.zeros(n, int), "converged": np.zeros(n, bool)}
        values, index = np.zeros((n, 2 * n_states, n_states)), np.zeros((n, n_states))  # the last axis is the threshold
        for done in range(1, outer + 1):
            if not len(arms):
                break
            longest, live = many[0], len(arms)
            for t in range(longest):
                while many[live - 1] <= t:
                    live -= 1
                row, at = np.arange(live), starts[:live] + t
                entry, after = k[at].astype(int), nxt[at].astype(int)
                future = np.maximum(values[row, 2 * after], values[row, 2 * after + 1])
                future[after < 0] = 0.0
                own = values[row, entry]
                reward = r[at][:, None] + passive[at][:, None] * index[:live]
                values[row, entry] = own + alpha * (reward + discount * future - own)
            state = np.arange(n_states)
            diff = values[:, 2 * state + 1, state] - values[:, 2 * state, state]
            index = index + eta * diff
            settled = np.abs(diff).max(axis=1) < tolerance
            found["index"][arms], found["gap"][arms], found["rounds"][arms], found["converged"][arms] = index, np.abs(diff), done, settled
            arms, starts, many, values, index = (x[~settled] for x in (arms, starts, many, values, index))
        return pd.DataFrame({c: list(x) for c, x in found.items()})

    return learn


def whittle_learning(
    log: DataFrame, reward: Column, outer: int = 500, alpha: float = 0.05, eta: float = 0.01, discount: float = 0.95,
    tolerance: float = 1e-3, n_states: int = N_STATES, size: int = CHUNK, ids=IDS,
) -> DataFrame:
    """Passive-subsidy index of every (arm, state) from a log with actions 0 (passive) and 1.

    Each state of each arm is a problem of its own: replay the log with the state's current index
    added to passive rewards, then move the index by eta times its action-value gap. An arm stops
    once its largest gap is below `tolerance`, and has then converged. Columns: state, index, gap, rounds,
    converged. Arms whose log is one chunk run all rounds in one task, longer ones a job each round.
    """
    fields = {
        "k": _entry(n_states, 2),
        "nxt": _next_state(n_states),
        "r": reward.cast("double"),
        "passive": (F.col("action") == 0).cast("double"),
    }
    log_chunks = stage(pack_chunks(log, fields, size, ids), "whittle-log")
    last = Window.partitionBy(*ids)
    short = log_chunks.withColumn("_last", F.max("chunk").over(last)).where("_last = 0")
    learn = _index_udf(outer, alpha, eta, discount, tolerance, n_states)
    done = short.repartition(4 * log.sparkSession.sparkContext.defaultParallelism, *ids).select(
        *ids, learn("k", "nxt", "r", "passive").alias("_f")
    )
    done = stage(done, "whittle-short").select(
        *ids, F.posexplode(F.arrays_zip("_f.index", "_f.gap")).alias("state", "_v"), "_f.rounds", "_f.converged"
    ).select(*ids, "state", "_v.index", "_v.gap", "rounds", "converged")
    if _last_chunk(log_chunks) == 0:
        return done
    log_chunks = stage(log_chunks.withColumn("_last", F.max("chunk").over(last)).where("_last > 0").drop("_last"), "whittle-long")
    key = [*ids, "threshold"]
    fold = _q_udf(alpha, discount, 2)
    width = 2 * n_states
    state = stage(
        log_chunks.select(*ids).distinct().select(
            *ids,
            F.explode(F.sequence(F.lit(0), F.lit(n_states - 1))).alias("threshold"),
            _zeros(width).alias("values"),
            F.lit(0.0).alias("index"),
            F.lit(float("inf")).alias("gap"),
            F.lit(0).alias("rounds"),
            F.lit(True).alias("open"),
        ),
        "whittle-state",
    )
    for _ in range(outer):
        live = state.where("open")
        if live.isEmpty():
            break
        chunks = log_chunks.join(live.select(*key, "index"), ids).withColumn(
            "r", F.zip_with("r", "passive", lambda r, p: r + p * F.col("index"))
        )
        moved = settle(
            chunks, lambda: fold("start", "k", "nxt", "r"), F.array_distinct("k"), width, key, live.select(*key, "values")
        )
        q = F.col("values")
        at = F.col("threshold") * 2
        diff = F.get(q, at + 1) - F.get(q, at)
        moved = moved.join(live.drop("values", "gap", "open"), key).select(
            *key, "values", (F.col("index") + F.lit(eta) * diff).alias("index"), F.abs(diff).alias("gap"),
            (F.col("rounds") + 1).alias("rounds"),
        )
        worst = F.max("gap").over(Window.partitionBy(*ids))
        moved = moved.withColumn("open", worst >= tolerance)
        state = stage(moved.unionByName(state.where("NOT open")), "whittle-state")
    return done.unionByName(
        state.select(*ids, F.col("threshold").alias("state"), "index", "gap", "rounds", (~F.col("open")).alias("converged"))
    )
