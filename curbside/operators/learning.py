"""Action probabilities, bandit weights and expected prices from logged decisions.

Logs are keyed by (run, agent, arm): arms never share state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from curbside.functions.menu import MULTIPLIERS, multiplier_of, within
from curbside.functions.numeric import clip, ieee_div

IDS = ["run", "agent", "arm"]
N_ACTIONS = len(MULTIPLIERS)
WEIGHT_LIMIT = 50.0
FLOOR = 1e-12


def policy_probs(
    q: DataFrame, kind: str = "epsilon_greedy", eps: float = 0.1, temperature: float = 1.0, ids=IDS
) -> DataFrame:
    """Add `prob` to a long action-value table (ids, state, action, q); ties go to the lower action."""
    if "q" not in q.columns or "action" not in q.columns:
        raise ValueError("a table of action values has the columns action and q")
    if kind not in ("random", "greedy", "epsilon_greedy", "softmax"):
        raise ValueError(f"there is no policy {kind}")
    if kind == "softmax" and temperature <= 0:
        raise ValueError("softmax takes a temperature above 0")
    w = Window.partitionBy(*ids, "state")
    n = F.count("*").over(w)
    if kind == "random":
        return q.withColumn("prob", 1.0 / n)
    best = F.max("q").over(w)
    if kind == "softmax":
        return (
            q.withColumn("_e", F.exp((F.col("q") - best) / F.lit(float(temperature))))
            .withColumn("prob", F.col("_e") / F.sum("_e").over(w))
            .drop("_e")
        )
    explore = 0.0 if kind == "greedy" else float(eps)
    return (
        q.withColumn("_best", best)
        .withColumn("_pick", F.min(F.when(F.col("q") == F.col("_best"), F.col("action"))).over(w))
        .withColumn(
            "prob", F.lit(explore) / n + F.when(F.col("action") == F.col("_pick"), 1.0 - explore).otherwise(0.0)
        )
        .drop("_best", "_pick")
    )


def exp3_weights(
    log: DataFrame, reward, eta: float = 0.1, n_actions: int = N_ACTIONS, ids=IDS
) -> DataFrame:
    """Log weight of every (arm, action): eta times the sum of reward over logged probability.

    The update is additive and unclipped, so any order of partial sums gives it; unplayed actions
    keep weight 0. An action outside the menu is an error.
    """
    reward = reward if isinstance(reward, Column) else F.col(reward)
    gain = ieee_div(reward, F.col("prob"))
    action = within("action", n_actions, "action")
    totals = F.array(
        *[F.coalesce(F.sum(F.when(action == a, gain)), F.lit(0.0)) * F.lit(eta) for a in range(n_actions)]
    )
    return log.groupBy(*ids).agg(totals.alias("w")).select(*ids, F.posexplode("w").alias("action", "log_w"))


def exp3_probs(weights: DataFrame, gamma: float = 0.1, ids=IDS) -> DataFrame:
    """(1 - gamma) softmax(log_w) + gamma / n, per arm; uniform if the weights sum to 0."""
    w = Window.partitionBy(*ids)
    n = F.count("*").over(w)
    e = weights.withColumn("_e", F.exp(F.col("log_w") - F.max("log_w").over(w))).withColumn("_s", F.sum("_e").over(w))
    base = F.when(F.col("_s") > 0, F.col("_e") / F.when(F.col("_s") > 0, F.col("_s"))).otherwise(1.0 / n)
    return e.withColumn("prob", F.lit(1.0 - gamma) * base + F.lit(gamma) / n).drop("_e", "_s")


def exp3_stable_probs(weights: DataFrame, gamma: float = 0.1, ids=IDS) -> DataFrame:
    """`exp3_probs` with the log weights held in [-50, 0], NaN repaired, a floor, and renormalised."""
    w = Window.partitionBy(*ids)
    n = F.count("*").over(w)
    z = clip(F.col("log_w") - F.max("log_w").over(w), -WEIGHT_LIMIT, 0.0)
    e = weights.withColumn("_e", F.exp(z)).withColumn("_s", F.sum("_e").over(w))
    raw = F.lit(1.0 - gamma) * (F.col("_e") / F.greatest(F.col("_s"), F.lit(FLOOR))) + F.lit(gamma) / n
    floored = F.greatest(F.nanvl(raw, 1.0 / n), F.lit(FLOOR))
    return (
        e.withColumn("_p", floored)
        .withColumn("prob", F.col("_p") / F.sum("_p").over(w))
        .drop("_e", "_s", "_p")
    )


def expected_multipliers(probs: DataFrame, menu=MULTIPLIERS, ids=IDS) -> DataFrame:
    """Probability-weighted price of every arm."""
    return probs.groupBy(*ids).agg(F.sum(F.col("prob") * multiplier_of("action", menu)).alias("multiplier"))


def frozen_policy(policy: DataFrame, expected: DataFrame, deviator: int) -> DataFrame:
    """Hold every platform but the deviator at its expected price; the deviator keeps its own.

    `expected` has (platform, zone, multiplier); a zone without one keeps the posted price.
    """
    held = expected.select("platform", "zone", F.col("multiplier").alias("_held"))
    free = F.col("platform") == F.lit(deviator)
    return (
        policy.join(held, ["platform", "zone"], "left")
        .withColumn("multiplier", F.when(free, F.col("multiplier")).otherwise(F.coalesce("_held", "multiplier")))
        .drop("_held")
        .select(*policy.columns)
    )


def forget_frozen(log: DataFrame, deviator: int, unfreeze: int, agent: str = "agent", iteration: str = "episode") -> DataFrame:
    """Log rows that still count after a reset: the deviator's all, the others' from the unfreeze on."""
    return log.where((F.col(agent) == deviator) | (F.col(iteration) >= unfreeze))
