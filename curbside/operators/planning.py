"""Models estimated from logs and the problems solved on them, one independent problem per arm.

A log of any length is first reduced, by one aggregation, to a model of at most
n_states * n_actions * n_states numbers per arm. Iterations then run inside that one row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from curbside.operators.learning import IDS, N_ACTIONS
from curbside.operators.replay import N_STATES, value_table


def estimate_transitions(log: DataFrame, ids=IDS) -> DataFrame:
    """(ids, action, s, s_next, p): observed transition frequencies; rows without a next state are left out."""
    moves = (
        log.where(F.col("next_state").isNotNull())
        .groupBy(*ids, "action", F.col("state").alias("s"), F.col("next_state").alias("s_next"))
        .agg(F.count("*").alias("n"))
    )
    packed = moves.groupBy(*ids, "action", "s").agg(
        F.sum("n").alias("total"), F.collect_list(F.struct("s_next", "n")).alias("m")
    )
    return packed.select(*ids, "action", "s", "total", F.explode("m").alias("m")).select(
        *ids, "action", "s", "m.s_next", (F.col("m.n") / F.col("total")).alias("p")
    )


def mean_rewards(log: DataFrame, reward: Column, ids=IDS) -> DataFrame:
    """(ids, s, action, r): mean reward of every visited state and action."""
    return log.groupBy(*ids, F.col("state").alias("s"), "action").agg(F.avg(reward).alias("r"))


def pack_model(
    transitions: DataFrame, rewards: DataFrame, n_states: int = N_STATES, n_actions: int = N_ACTIONS, ids=IDS
) -> DataFrame:
    """One row per arm: `p_at`/`p` sparse transitions by flat (s, action, s_next), `r_at`/`r` rewards."""
    flat = ((F.col("s") * n_actions + F.col("action")) * n_states + F.col("s_next")).cast("int")
    p = transitions.groupBy(*ids).agg(F.array_sort(F.collect_list(F.struct(flat.alias("i"), "p"))).alias("tp"))
    cell = (F.col("s") * n_actions + F.col("action")).cast("int")
    r = rewards.groupBy(*ids).agg(F.array_sort(F.collect_list(F.struct(cell.alias("i"), "r"))).alias("tr"))
    return r.join(p, ids, "left").select(
        *ids,
        F.coalesce(F.col("tp.i"), F.array().cast("array<int>")).alias("p_at"),
        F.coalesce(F.col("tp.p"), F.array().cast("array<double>")).alias("p"),
        F.col("tr.i").alias("r_at"),
        F.col("tr.r").alias("r"),
    )


def _dense(at: pd.Series, values: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(at), width))
    for row, (i, v) in enumerate(zip(at, values)):
        out[row, np.asarray(i, dtype=int)] = v
    return out


def fitted_q(
    log: DataFrame, reward: Column, discount: float = 0.95, iterations: int = 100, n_states: int = N_STATES,
    n_actions: int = N_ACTIONS, ids=IDS,
) -> DataFrame:
    """Q <- mean of r + discount * max Q(next), repeated; unvisited pairs stay 0.

    The mean over the log equals the mean reward plus the mean future over the observed next
    states, so the log is read once, not once per round.
    """
    moves = (
        log.groupBy(*ids, F.col("state").alias("s"), "action", F.col("next_state").alias("s_next"))
        .agg(F.count("*").alias("n"), F.sum(reward).alias("total"))
    )
    pairs = moves.groupBy(*ids, "s", "action").agg(
        F.sum("n").alias("visits"), F.sum("total").alias("total"),
        F.collect_list(F.struct("s_next", "n")).alias("m"),
    )
    rewards = pairs.select(*ids, "s", "action", (F.col("total") / F.col("visits")).alias("r"))
    shares = pairs.select(*ids, "s", "action", "visits", F.explode("m").alias("m")).where("m.s_next IS NOT NULL").select(
        *ids, "s", "action", "m.s_next", (F.col("m.n") / F.col("visits")).alias("p")
    )
    model = pack_model(shares, rewards, n_states, n_actions, ids)

    @F.pandas_udf("array<double>")
    def solve(p_at: pd.Series, p: pd.Series, r_at: pd.Series, r: pd.Series) -> pd.Series:
        move = _dense(p_at, p, n_states * n_actions * n_states).reshape(len(p_at), n_states * n_actions, n_states)
        gain = _dense(r_at, r, n_states * n_actions)
        q = np.zeros_like(gain)
        for _ in range(iterations):
            best = q.reshape(len(q), n_states, n_actions).max(axis=2)
            q = gain + discount * np.matmul(move, best[:, :, None])[:, :, 0]
        return pd.Series(list(q))

    return value_table(model.select(*ids, solve("p_at", "p", "r_at", "r").alias("values")), n_actions, ids)


def _solve_two_actions(move, gain, subsidy, discount, tol, max_iter):
    """Value iteration for a batch of problems.

    move (m, s, 2, s'), gain (m, s, 2), subsidy (m, k): k subsidies for each of m models.
    A problem stops by its own change, so a batch does not alter its result.
    """
    m, s = gain.shape[:2]
    k = subsidy.shape[1]
    base = np.repeat(gain[:, None], k, axis=1)  # (m, k, s, 2)
    base[..., 0] += subsidy[:, :, None]
    flat = move.reshape(m, s * 2, s).transpose(0, 2, 1)  # (m, s', s*2)
    q = np.zeros_like(base)
    live = np.ones((m, k), dtype=bool)
    for _ in range(max_iter):
        rows = live.any(axis=1)
        if not rows.any():
            break
        value = q[rows].max(axis=3)  # (m', k, s')
        new = base[rows] + discount * np.matmul(value, flat[rows]).reshape(-1, k, s, 2)
        change = np.abs(new - q[rows]).max(axis=(2, 3))
        keep = live[rows]
        q[rows] = np.where(keep[..., None, None], new, q[rows])
        live[rows] = keep & (change >= tol)
    if live.any():
        raise RuntimeError(f"values still change by {tol} or more after {max_iter} rounds")
    return q


def value_iteration(
    model: DataFrame, discount: float = 0.95, subsidy: float = 0.0, tol: float = 1e-10, max_iter: int = 10000,
    n_states: int = N_STATES, ids=IDS,
) -> DataFrame:
    """Action values of every two-action arm of `pack_model`; action 0 earns the passive subsidy."""

    @F.pandas_udf("array<double>")
    def solve(p_at: pd.Series, p: pd.Series, r_at: pd.Series, r: pd.Series) -> pd.Series:
        move = _dense(p_at, p, n_states * 2 * n_states).reshape(-1, n_states, 2, n_states)
        gain = _dense(r_at, r, n_states * 2).reshape(-1, n_states, 2)
        q = _solve_two_actions(move, gain, np.full((len(gain), 1), float(subsidy)), discount, tol, max_iter)
        return pd.Series(list(q[:, 0].reshape(len(gain), -1)))

    return value_table(model.select(*ids, solve("p_at", "p", "r_at", "r").alias("values")), 2, ids)


#: So many models are solved at once, and so many rounds count every difference of action values over 1e-12.
MODELS, FINE_ROUNDS = 64, 20


def _policy_values(move, gain, subsidy, discount, max_iter=200):
    """Exact action values of a batch of two-action problems by policy iteration.

    Shapes as in `_solve_two_actions`. Ties keep the passive action, so each policy is improved until it repeats. Where
    actions are equally good but for rounding, as at an index, a policy may go back and forth; a problem that still
    changes after `FINE_ROUNDS` rounds therefore takes differences within its rounding error for ties.
    """
    out = np.empty((*subsidy.shape, gain.shape[1], 2))
    for at in range(0, len(gain), MODELS):
        some = slice(at, at + MODELS)
        out[some] = _policy_values_of_some(move[some], gain[some], subsidy[some], discount, max_iter)
    return out


def _policy_values_of_some(move, gain, subsidy, discount, max_iter):
    m, s = gain.shape[:2]
    k = subsidy.shape[1]
    base = np.repeat(gain[:, None], k, axis=1)
    base[..., 0] += subsidy[:, :, None]
    base = base.reshape(m * k, s, 2)
    act = base.argmax(axis=2)
    q = np.empty_like(base)
    live, states = np.arange(m * k), np.arange(s)
    rounding = 4 * s * np.finfo(float).eps / (1 - discount)
    for done in range(max_iter + 1):
        own, of = act[live], live // k
        rows = move[of[:, None], states, own]
        pay = np.take_along_axis(base[live], own[..., None], axis=2)
        value = np.linalg.solve(np.eye(s) - discount * rows, pay)
        new = base[live] + discount * np.matmul(move[of], value[:, None])[..., 0]
        tie = 1e-12
        if done >= FINE_ROUNDS:
            tie = np.maximum(tie, rounding * np.abs(new).max(axis=(1, 2)))[:, None]
        better = (new[..., 1] - new[..., 0] > np.where(own == 1, -tie, tie)).astype(int)
        q[live] = new
        act[live] = better
        live = live[(better != own).any(axis=1)]
        if not len(live):
            return q.reshape(m, k, s, 2)
    raise RuntimeError(f"a policy is still changing after {max_iter} rounds")


def whittle_indices(
    model: DataFrame, discount: float = 0.95, low: float = -100.0, high: float = 100.0, rounds: int = 80,
    n_states: int = N_STATES, ids=IDS,
) -> DataFrame:
    """The subsidy that makes both actions equally good, by bisection, for every (arm, state).

    Each trial subsidy is solved exactly instead of to a tolerance. The work per model is large
    next to its bytes, so the models are spread over all tasks first.
    """

    @F.pandas_udf("array<double>")
    def solve(p_at: pd.Series, p: pd.Series, r_at: pd.Series, r: pd.Series) -> pd.Series:
        move = _dense(p_at, p, n_states * 2 * n_states).reshape(-1, n_states, 2, n_states)
        gain = _dense(r_at, r, n_states * 2).reshape(-1, n_states, 2)
        lo, hi = np.full((len(gain), n_states), low), np.full((len(gain), n_states), high)
        own = np.arange(n_states)
        for _ in range(rounds):
            mid = 0.5 * (lo + hi)
            if np.all((mid == lo) | (mid == hi)):
                break
            q = _policy_values(move, gain, mid, discount)
            gap = q[:, own, own, 1] - q[:, own, own, 0]
            lo, hi = np.where(gap > 0, mid, lo), np.where(gap > 0, hi, mid)
        return pd.Series(list(0.5 * (lo + hi)))

    tasks = int(model.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = model.repartition(tasks, *ids)
    out = spread.select(*ids, solve("p_at", "p", "r_at", "r").alias("v"))
    return out.select(*ids, F.posexplode("v").alias("state", "index"))


def index_gaps(model: DataFrame, indices: DataFrame, discount: float = 0.95, n_states: int = N_STATES, ids=IDS) -> DataFrame:
    """For each (arm, state, index): the active less the passive action's value in that state when `index` is the passive
    subsidy. At a right index both are equally good."""

    @F.pandas_udf("array<double>")
    def gaps(p_at: pd.Series, p: pd.Series, r_at: pd.Series, r: pd.Series, index: pd.Series) -> pd.Series:
        move = _dense(p_at, p, n_states * 2 * n_states).reshape(-1, n_states, 2, n_states)
        gain = _dense(r_at, r, n_states * 2).reshape(-1, n_states, 2)
        subsidy = np.stack(index.to_list()) if len(index) else np.zeros((0, n_states))
        own = np.arange(n_states)
        q = _policy_values(move, gain, subsidy, discount)
        return pd.Series(list(q[:, own, own, 1] - q[:, own, own, 0]))

    packed = indices.groupBy(*ids).agg(F.array_sort(F.collect_list(F.struct("state", "index"))).alias("_i"))
    rows = model.join(packed, ids).select(*ids, gaps("p_at", "p", "r_at", "r", F.col("_i.index")).alias("_g"))
    return indices.join(rows.select(*ids, F.posexplode("_g").alias("state", "gap")), [*ids, "state"])


def current_states(log: DataFrame, ids=IDS) -> DataFrame:
    """Last logged state of every arm."""
    return log.groupBy(*ids).agg(F.max_by("state", F.struct("episode", "step")).alias("state"))


def priority_scores(q: DataFrame, states: DataFrame, ids=IDS) -> DataFrame:
    """Active minus passive action value at each arm's current state."""
    gap = F.sum(F.when(F.col("action") == 1, F.col("q")).when(F.col("action") == 0, -F.col("q")).otherwise(0.0))
    return q.join(states, [*ids, "state"]).groupBy(*ids, "state").agg(gap.alias("score"))
