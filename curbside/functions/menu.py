"""The price menu and the reward scales."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from curbside.functions.numeric import clip

# Surge multipliers by action index.
MULTIPLIERS = (1.0, 1.2, 1.5, 1.8, 2.0)

# Fare per taxi that counts as full reward, and the revenue normaliser.
SINGLE_PLATFORM_FARE_CAP = 100.0
MULTI_PLATFORM_FARE_CAP = 270.0
REVENUE_NORMALIZER = 50000.0


def within(value, n: int, what: str) -> Column:
    """`value` if it is a whole number from 0 to n - 1; anything else, null too, fails the job."""
    value = value if isinstance(value, Column) else F.col(value)
    wrong = F.raise_error(F.concat(F.lit(f"there is no {what} "), F.coalesce(value.cast("string"), F.lit("null"))))
    return F.when(value.between(0, n - 1), value).otherwise(wrong.cast("int"))


def menu_array(menu=MULTIPLIERS) -> Column:
    return F.array(*[F.lit(float(m)) for m in menu])


def multiplier_of(action, menu=MULTIPLIERS) -> Column:
    action = action if isinstance(action, Column) else F.col(action)
    return F.element_at(menu_array(menu), (action + 1).cast("int"))


def inventory_bin(taxis, bin_size: int = 10, n_states: int = 10) -> Column:
    taxis = taxis if isinstance(taxis, Column) else F.col(taxis)
    return F.least(F.floor(taxis / bin_size).cast("int"), F.lit(n_states - 1))


def reward_per_taxi(reward="reward", n_taxis="n_taxis", cap: float = SINGLE_PLATFORM_FARE_CAP) -> Column:
    """Revenue per taxi present after the step, scaled into [0, 1]; 0 where no taxi is left."""
    reward = reward if isinstance(reward, Column) else F.col(reward)
    n = n_taxis if isinstance(n_taxis, Column) else F.col(n_taxis)
    return F.when(n > 0, clip(reward / F.when(n > 0, n) / F.lit(cap), 0.0, 1.0)).otherwise(F.lit(0.0))


def reward_share(reward="reward", normalizer: float = REVENUE_NORMALIZER) -> Column:
    """Revenue over a fixed normaliser, scaled into [0, 1]; null and NaN count as 0."""
    reward = reward if isinstance(reward, Column) else F.col(reward)
    clean = F.coalesce(F.nanvl(reward.cast("double"), F.lit(0.0)), F.lit(0.0))
    return clip(clean / F.lit(max(float(normalizer), 1e-9)), 0.0, 1.0)
