"""Summaries of experiment logs."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType

from curbside.functions.menu import MULTIPLIERS, within
from curbside.functions.numeric import r2
from curbside.operators.blocks import dense_index, moving_mean, running_total
from curbside.operators.market import N_PLATFORMS, platform_fleets

FIRMS = range(N_PLATFORMS)
# Column names tried in this order, and index columns never taken as a value.
PREFERRED_VALUES = (
    "Revenue",
    "revenue",
    "total_revenue",
    "episode_revenue",
    "Reward",
    "reward",
    "Profit",
    "profit",
)
INDEX_NAMES = ("episode", "iteration", "round", "step")


# --- phases ---------------------------------------------------------------------------------


class Phases(NamedTuple):
    """The first frozen iteration and the first one after the frozen phase."""

    freeze: int
    unfreeze: int

    @classmethod
    def between(cls, freeze: int, unfreeze: int) -> Phases:
        if freeze >= unfreeze:
            raise ValueError(f"no iteration is frozen: the phase would begin at {freeze} and end at {unfreeze}")
        return cls(freeze, unfreeze)


def phase_bounds(baseline_episodes: int, freeze_episodes: int, unfreeze_at: int | None = None) -> Phases:
    """The frozen phase begins after the baseline; it ends at `unfreeze_at`, or else after `freeze_episodes`."""
    begin = int(baseline_episodes)
    return Phases.between(begin, int(begin + freeze_episodes if unfreeze_at is None else unfreeze_at))


def phase_of(iteration="iteration", freeze="freeze_iteration", unfreeze="unfreeze_iteration") -> Column:
    """'before', 'freeze' or 'after'."""
    it = F.col(iteration)
    return F.when(it < F.col(freeze), "before").when(it < F.col(unfreeze), "freeze").otherwise("after")


def role_of(deviator: int, reset: bool = False, firm: str = "firm_id") -> Column:
    # fixed values: the role names
    other = "frozen_reset_learning" if reset else "frozen_then_unfrozen"
    return F.when(F.col(firm) == deviator, "deviator").otherwise(other)


def label_phases(timeline: DataFrame, deviator: int, freeze: int, unfreeze: int) -> DataFrame:
    """Phase name, deviator and frozen flags, and the two boundaries on every timeline row."""
    freeze, unfreeze = Phases.between(freeze, unfreeze)
    it, is_dev = F.col("iteration"), F.col("firm_id") == deviator
    frozen_now = (it >= freeze) & (it < unfreeze)
    # fixed values: the phase names
    phase = (
        F.when(it < freeze, "before_freeze_expected_policy_eval")
        .when(frozen_now & is_dev, "after_freeze_deviator_learning")
        .when(frozen_now, "after_freeze_expected_policy_frozen")
        .otherwise("after_unfreeze_all_learning")
    )
    return timeline.withColumns(
        {
            "phase": phase,
            "is_deviator": is_dev.cast("int"),
            "is_frozen": (frozen_now & ~is_dev).cast("int"),
            "freeze_iteration": F.lit(freeze),
            "unfreeze_iteration": F.lit(unfreeze),
        }
    )


# --- firms ----------------------------------------------------------------------------------


def _fleet_of(fleet, firm: str = "firm_id") -> Column:
    return F.element_at(F.array(*[F.lit(int(n)) for n in platform_fleets(fleet)]), (F.col(firm) + 1).cast("int"))


def per_taxi(timeline: DataFrame, fleet, value: str = "profit", out: str = "revenue_per_taxi") -> DataFrame:
    return timeline.withColumn(out, F.col(value) / _fleet_of(fleet))


def firm_columns(timeline: DataFrame, value: str) -> DataFrame:
    """One row per iteration, one column per firm: mean value, 0 where the firm has no row."""
    return timeline.groupBy("iteration").agg(
        *[F.coalesce(F.avg(F.when(F.col("firm_id") == k, F.col(value))), F.lit(0.0)).alias(f"firm_{k}") for k in FIRMS]
    )


def firm_rows(wide: DataFrame) -> DataFrame:
    """`firm_columns` back to (iteration, firm_id, value)."""
    cells = F.array(*[F.struct(F.lit(k).alias("firm_id"), F.col(f"firm_{k}").alias("value")) for k in FIRMS])
    return wide.select("iteration", F.explode(cells).alias("c")).select("iteration", "c.firm_id", "c.value")


def phase_summary(
    timeline: DataFrame, deviator: int, fleet, freeze: int, unfreeze: int, reset: bool = False
) -> DataFrame:
    """Mean revenue per firm and phase, total, and the same per taxi; null for an empty phase.

    Means run over the zero-filled grid of `firm_columns`.
    """
    it, v, size = F.col("iteration"), F.col("value"), _fleet_of(fleet)
    means = firm_rows(firm_columns(timeline, "profit")).groupBy("firm_id").agg(
        F.avg(F.when(it < freeze, v)).alias("before_freeze_mean_revenue"),
        F.avg(F.when((it >= freeze) & (it < unfreeze), v)).alias("freeze_phase_mean_revenue"),
        F.avg(F.when(it >= unfreeze, v)).alias("post_unfreeze_mean_revenue"),
        F.sum(v).alias("final_cumulative_revenue"),
    )
    return means.select(
        F.lit(deviator).alias("deviator_firm_id"),
        "firm_id",
        role_of(deviator, reset).alias("role"),
        size.cast("bigint").alias("fleet_size"),
        "before_freeze_mean_revenue",
        "freeze_phase_mean_revenue",
        "post_unfreeze_mean_revenue",
        "final_cumulative_revenue",
        (F.col("before_freeze_mean_revenue") / size).alias("before_freeze_mean_rev_per_taxi"),
        (F.col("freeze_phase_mean_revenue") / size).alias("freeze_phase_mean_rev_per_taxi"),
        (F.col("post_unfreeze_mean_revenue") / size).alias("post_unfreeze_mean_rev_per_taxi"),
        (F.col("final_cumulative_revenue") / size).alias("final_cumulative_rev_per_taxi"),
    )


def cumulative_revenue(timeline: DataFrame, value: str = "profit") -> DataFrame:
    """Running total per firm along the iterations of the zero-filled grid."""
    return running_total(firm_rows(firm_columns(timeline, value)), ["firm_id"], "iteration", "value", "cumulative")


# --- episodes -------------------------------------------------------------------------------


def origin_totals(trips: DataFrame, origin: str = "zone", dest: str = "dest", amount: str = "fare") -> DataFrame:
    """Per zone: revenue of the trips that start there and the number that end there."""
    out = trips.groupBy(F.col(origin).alias("zone")).agg(F.sum(amount).alias("revenue"), F.lit(0).cast("bigint").alias("arrivals"))
    into = trips.groupBy(F.col(dest).alias("zone")).agg(F.lit(0.0).alias("revenue"), F.count("*").alias("arrivals"))
    return out.unionByName(into).groupBy("zone").agg(F.sum("revenue").alias("revenue"), F.sum("arrivals").alias("arrivals"))


def episode_revenue(log: DataFrame, keys=("run", "agent")) -> DataFrame:
    return log.groupBy(*keys, "episode").agg(F.sum("reward").alias("revenue"))


def firm_episodes(log: DataFrame, n_zones: int, steps: int) -> DataFrame:
    """Profit and mean multiplier per (iteration, firm); the mean divides by the configured steps."""
    return log.groupBy("iteration", "firm_id").agg(
        F.sum("reward").alias("profit"),
        (F.sum("multiplier") / F.lit(float(n_zones * steps))).alias("avg_multiplier"),
    )


def interval_labels(n_episodes: int, width: int = 10) -> list[str]:
    return [f"{i * width}-{(i + 1) * width}" for i in range(n_episodes // width)]


def interval_multipliers(
    log: DataFrame, n_episodes: int, width: int = 10, menu=MULTIPLIERS, keys=("run", "agent", "arm")
) -> DataFrame:
    """Mean multiplier per arm and interval of episodes, one column per whole interval, rounded.

    Built from action counts, so the mean does not depend on the order of the rows. An action outside
    the menu is an error.
    """
    labels = interval_labels(n_episodes, width)
    bucket = F.floor(F.col("episode") / width)
    action = within("action", len(menu), "action")

    def mean_in(i: int) -> Column:
        here = bucket == i
        plays = F.sum(here.cast("int"))
        total = sum(
            (F.sum((here & (action == a)).cast("int")) * F.lit(float(m)) for a, m in enumerate(menu)),
            F.lit(0.0),
        )
        return r2(total / F.when(plays > 0, plays))

    if not labels:
        return log.select(*keys).distinct()
    return log.groupBy(*keys).agg(*[mean_in(i).alias(label) for i, label in enumerate(labels)])


def sweep_grid(seeds: DataFrame, deviators=FIRMS) -> DataFrame:
    """(seed, deviator): every deviator for every seed."""
    return seeds.select("seed", F.explode(F.array(*[F.lit(int(d)) for d in deviators])).alias("deviator"))


def sweep_summary(run_log: DataFrame) -> DataFrame:
    return run_log.agg(
        F.count("*").alias("runs"),
        F.count_if(F.col("success")).alias("successes"),
        F.count_if(~F.col("success")).alias("failures"),
        F.sum("duration").alias("total_duration"),
    )


def failed_runs(run_log: DataFrame) -> DataFrame:
    return run_log.where(~F.col("success")).select("deviator", "seed", "duration")


# --- series ---------------------------------------------------------------------------------


def trailing_mean(series: DataFrame, keys: list[str], value: str, n_episodes: int, window: int = 10,
                  order: str = "episode") -> DataFrame:
    """Mean of each row and the `window - 1` before it, only where all of them exist."""
    w = max(min(window, n_episodes), 1)
    return moving_mean(dense_index(series, keys, order), keys, "idx", value, "moving_avg", w - 1, 0)


def centered_mean(series: DataFrame, keys: list[str], value: str, window: int = 10, order: str = "iteration") -> DataFrame:
    """Moving mean of the same length; the ends repeat the first and last value. Window 1 is the identity."""
    if window <= 1:
        return series.withColumn("moving_avg", F.col(value).cast("double"))
    before = window // 2
    return moving_mean(
        dense_index(series, keys, order), keys, "idx", value, "moving_avg", before, window - 1 - before, pad=True
    ).drop("idx")


def value_column(df: DataFrame, name: str | None = None) -> str:
    """`name` if it is given, else the first of `PREFERRED_VALUES` there is, else the last numeric column that is
    no index; an error if there is no such column."""
    wanted = (name,) if name else PREFERRED_VALUES
    ranks = {}
    for at, f in enumerate(df.schema.fields):
        if f.name in wanted:
            ranks[f.name] = (0, wanted.index(f.name))
        elif not name and isinstance(f.dataType, NumericType) and f.name.lower() not in INDEX_NAMES:
            ranks[f.name] = (1, -at)
    if not ranks:
        raise ValueError(f"{name or 'a column of values'} is not among the columns {', '.join(df.columns)}")
    return min(ranks, key=ranks.get)


def numbers_only(df: DataFrame, column: str, out: str = "value") -> DataFrame:
    """Text that reads as a number, as a double; other rows are left out, and NaN counts as missing."""
    number = F.col(column).try_cast("double")
    return df.withColumn(out, number).where(F.col(out).isNotNull() & ~F.isnan(out))


def align_series(series: DataFrame, order: str, value: str, length: int, scale: float = 1.0) -> DataFrame:
    """(i, value) for i < length: the series cut off there, or continued with its last value."""
    known = dense_index(numbers_only(series, value, "_v"), [], order, "i").select("i", (F.col("_v") * F.lit(scale)).alias("value"))
    last = known.agg(F.max_by("value", "i")).scalar()
    spine = series.sparkSession.range(length).select(F.col("id").alias("i"))
    return spine.join(known, "i", "left").select("i", F.coalesce("value", last).alias("value"))


def against_single_platform(
    platform: DataFrame, single: DataFrame, share: float = 0.25, fleet=None
) -> DataFrame:
    """Each platform's episode revenue next to a share of the single platform's, and per taxi."""
    out = platform.join(
        single.select("episode", (F.col("revenue") * F.lit(share)).alias("single_share")), "episode", "left"
    )
    if fleet is not None:
        per_platform = sum(platform_fleets(fleet)) / float(N_PLATFORMS)
        out = out.withColumn("single_share_per_taxi", F.col("single_share") / F.lit(per_platform))
    return out
