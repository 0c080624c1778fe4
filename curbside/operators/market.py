"""Expected-value market arithmetic over a policy table.

Every table is keyed by (scenario, platform, zone, day, hour), so any number of pricing
scenarios is evaluated in one job.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from curbside.functions.calendar import next_slot
from curbside.functions.hashing import unit_hash
from curbside.operators.demand import THETA
from curbside.operators.destination import GUIDE

SLOT = ["zone", "day", "hour"]
CELL = ["scenario", "platform", "zone", "day", "hour"]
N_PLATFORMS = 4
OUTSIDE = 4
# fixed value: the text of this error
FLEET_ERROR = "the number of inputs is not equal to the number of agents."


# --- fleets ---------------------------------------------------------------------------------


def _sizes(fleet) -> tuple[int, ...]:
    """`fleet` as one size of all platforms together, or one for each."""
    number = isinstance(fleet, (int, float, np.integer)) and not isinstance(fleet, bool)
    sizes = (fleet,) if number else tuple(fleet) if isinstance(fleet, (list, tuple, np.ndarray)) else ()
    if len(sizes) not in (1, N_PLATFORMS):
        raise ValueError(FLEET_ERROR)
    return tuple(int(x) for x in sizes)


def platform_fleets(fleet) -> list[int]:
    """One size per platform from a single size (shared equally, rounded down) or four sizes."""
    sizes = _sizes(fleet)
    return list(sizes) if len(sizes) == N_PLATFORMS else [sizes[0] // N_PLATFORMS] * N_PLATFORMS


def total_fleet(fleet) -> int:
    """The single platform's size: the number itself, or the sum of four."""
    return sum(_sizes(fleet))


def fleet_table(spark: SparkSession, fleet) -> DataFrame:
    return spark.createDataFrame(list(enumerate(platform_fleets(fleet))), "platform INT, fleet_size BIGINT")


def initial_inventory(zones: DataFrame, fleet) -> DataFrame:
    """Each platform's fleet spread evenly over the zones: (platform, zone, n_taxis)."""
    sizes = platform_fleets(fleet)
    entries = F.array(
        *[F.struct(F.lit(k).alias("platform"), F.lit(float(n)).alias("size")) for k, n in enumerate(sizes)]
    )
    n_zones = zones.agg(F.count("*")).scalar()
    return zones.select("zone", F.explode(entries).alias("f")).select(
        "f.platform", "zone", (F.col("f.size") / n_zones).alias("n_taxis")
    )


# --- demand and choice ----------------------------------------------------------------------


def acceptance(multiplier, theta: float = THETA) -> Column:
    m = multiplier if isinstance(multiplier, Column) else F.col(multiplier)
    return F.exp(F.lit(-theta) * (m - F.lit(1.0)))


def thin_demand(demand: DataFrame, policy: DataFrame, theta: float = THETA) -> DataFrame:
    """Demand that accepts the posted price when there is no rival: rate * exp(-theta (m - 1))."""
    return policy.join(demand, SLOT, "left").select(
        *CELL, (F.coalesce("demand", F.lit(0.0)) * acceptance("multiplier", theta)).alias("demand")
    )


def choice_shares(policy: DataFrame, theta: float = THETA) -> DataFrame:
    """Share of requests each platform wins in a slot, and its price; platform 4 is "take no ride" and has none.

    A slot's four prices are folded by one aggregation and unpacked again, so the policy table is
    shuffled once.
    """
    v = acceptance("multiplier", theta)
    slots = policy.groupBy("scenario", *SLOT).agg(
        F.collect_list(F.struct("platform", v.alias("v"), F.col("multiplier").cast("double").alias("m"))).alias("offers"),
        F.sum(v).alias("total"),
        F.avg("multiplier").alias("mean_m"),
    )
    slots = slots.withColumn("accept", acceptance("mean_m", theta))
    inside = F.transform(
        F.col("offers"),
        lambda o: F.struct(
            o["platform"].alias("platform"),
            F.when(F.col("total") > 0, F.col("accept") * (o["v"] / F.when(F.col("total") > 0, F.col("total"))))
            .otherwise(F.col("accept") / N_PLATFORMS)
            .alias("share"),
            o["m"].alias("multiplier"),
        ),
    )
    nothing = F.array(
        F.struct(
            F.lit(OUTSIDE).alias("platform"), (F.lit(1.0) - F.col("accept")).alias("share"), F.lit(None).cast("double").alias("multiplier")
        )
    )
    return slots.select("scenario", *SLOT, F.explode(F.concat(inside, nothing)).alias("c")).select(
        "scenario", "c.platform", *SLOT, "c.share", "c.multiplier"
    )


def split_demand(demand: DataFrame, shares: DataFrame) -> DataFrame:
    """Expected requests per platform, the outside option included; prices go along where `shares` has them."""
    price = [c for c in shares.columns if c == "multiplier"]
    return shares.join(demand, SLOT, "left").select(
        *CELL, (F.coalesce("demand", F.lit(0.0)) * F.col("share")).alias("demand"), *price
    )


def match(demand: DataFrame, inventory: DataFrame) -> DataFrame:
    """matched = min(requests, taxis); the rest of the taxis are idle. Prices go along where `demand` has them."""
    price = [c for c in demand.columns if c == "multiplier"]
    return (
        inventory.join(demand, CELL, "left")
        .withColumn("demand", F.coalesce("demand", F.lit(0.0)))
        .withColumn("matched", F.least("demand", "n_taxis"))
        .withColumn("idle", F.col("n_taxis") - F.col("matched"))
        .select(*CELL, "demand", "n_taxis", "matched", "idle", *price)
    )


def idle_totals(matched: DataFrame) -> DataFrame:
    """Idle taxis per platform and slot hour."""
    return matched.groupBy("scenario", "platform", "day", "hour").agg(F.sum("idle").alias("idle"))


# --- trips and revenue ----------------------------------------------------------------------


UNKNOWN_SLOT = "trips start in a slot that has no destination distribution"


def known(column: str, kind: str) -> Column:
    """`column`; a null, which a slot without a distribution leaves, is an error."""
    return F.coalesce(F.col(column), F.raise_error(F.lit(UNKNOWN_SLOT)).cast(kind))


def route_trips(matched: DataFrame, dest_prob: DataFrame) -> DataFrame:
    """Expected trips from each zone to each destination. Only rows with matched trips fan out.

    Matched trips in a slot without a distribution are an error.
    """
    return (
        matched.where(F.col("matched") > 0)
        .join(dest_prob, SLOT, "left")
        .select(*CELL, "dest", (F.col("matched") * known("p", "double")).alias("flow"))
    )


def arrivals(matched: DataFrame, dest_prob: DataFrame, scenarios_per_task: int = 256) -> DataFrame:
    """Expected arrivals per platform and destination: `route_trips` summed over the origins.

    Written out, the flows are as many rows as cells times destinations. Here each hour of the
    week is a matrix product of matched trips and destination probabilities, split by scenario
    into groups by hash, and only its result is emitted. `matched` should be staged. Matched trips in a
    slot without a distribution are an error.
    """
    n_scenarios = matched.select("scenario").distinct().count()
    groups = max(1, -(-n_scenarios // scenarios_per_task))
    moving = matched.where(F.col("matched") > 0).select(
        "scenario", "platform", "zone", "day", "hour", "matched", F.pmod(F.hash("scenario"), F.lit(groups)).alias("part")
    )
    probs = dest_prob.select(
        *SLOT, "dest", "p", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part")
    )

    def product(trips: pd.DataFrame, chances: pd.DataFrame) -> pd.DataFrame:
        if trips.empty:
            kinds = {"scenario": "str", "platform": "int32", "zone": "int32", "day": "int32", "hour": "int32"}
            return pd.DataFrame({c: pd.Series(dtype=t) for c, t in {**kinds, "arrivals": "float64"}.items()})
        origins = pd.Index(chances["zone"].unique())
        dests = pd.Index(chances["dest"].unique())
        chance = np.zeros((len(origins), len(dests)))
        np.add.at(chance, (origins.get_indexer(chances["zone"]), dests.get_indexer(chances["dest"])), chances["p"])
        sides = pd.MultiIndex.from_frame(trips[["scenario", "platform"]])
        rows, sides = sides.factorize()
        cols = origins.get_indexer(trips["zone"])
        if (cols < 0).any():
            raise ValueError(UNKNOWN_SLOT)
        amount = np.zeros((len(sides), len(origins)))
        np.add.at(amount, (rows, cols), trips["matched"].to_numpy())
        flow = amount @ chance
        out = pd.DataFrame(
            {
                "scenario": np.repeat(sides.get_level_values(0).to_numpy(), len(dests)),
                "platform": np.repeat(sides.get_level_values(1).to_numpy(), len(dests)),
                "zone": np.tile(dests.to_numpy(), len(sides)),
                "arrivals": flow.ravel(),
            }
        )
        out["day"], out["hour"] = trips["day"].iloc[0], trips["hour"].iloc[0]
        return out[out["arrivals"] > 0]

    key = ["day", "hour", "part"]
    return (
        moving.groupBy(*key)
        .cogroup(probs.groupBy(*key))
        .applyInPandas(product, "scenario string, platform int, zone int, day int, hour int, arrivals double")
    )


def mean_fare(dest_prob: DataFrame, fares: DataFrame) -> DataFrame:
    """Expected fare of a trip from each slot: sum over destinations of p * fare.

    The multiplier depends on the origin alone, so this table is made once for all scenarios.
    """
    return (
        dest_prob.join(fares, ["zone", "dest"])
        .groupBy(*SLOT)
        .agg(F.sum(F.col("p") * F.col("fare")).alias("mean_fare"))
    )


def revenue(matched: DataFrame, fare_means: DataFrame, policy: DataFrame | None = None) -> DataFrame:
    """Expected revenue per cell, without ever building the origin-destination flows.

    The price is the one that `matched` carries from `choice_shares`; `policy` is joined only where it carries none. Matched
    trips in a slot without a mean fare are an error.
    """
    if policy is not None:
        matched = matched.drop("multiplier").join(policy, CELL)
    paid = F.col("matched") * known("mean_fare", "double") * F.col("multiplier")
    return (
        matched.join(fare_means, SLOT, "left")
        .select(
            *CELL,
            F.when(F.col("matched") == 0, 0.0).otherwise(paid).alias("revenue"),
        )
    )


# --- inventory ------------------------------------------------------------------------------


def normalised_demand(demand: DataFrame) -> DataFrame:
    """Share of each hour's demand per zone; uniform where the hour has none. One row per zone and hour."""
    w = Window.partitionBy("day", "hour")
    total, n = F.sum("demand").over(w), F.count("*").over(w)
    share = F.when(total > 0, F.col("demand") / F.when(total > 0, total)).otherwise(1.0 / n)
    return demand.select(*SLOT, share.alias("p"))


def relocation_probs(demand: DataFrame) -> DataFrame:
    """Where idle taxis go after a slot: the next hour's normalised demand, keyed by the slot they leave."""
    before_day = F.when(F.col("hour") == 0, (F.col("day") + 6) % 7).otherwise(F.col("day")).cast("int")
    before_hour = F.when(F.col("hour") == 0, 23).otherwise(F.col("hour") - 1).cast("int")
    return normalised_demand(demand).select("zone", before_day.alias("day"), before_hour.alias("hour"), "p")


def relocated(idle: DataFrame, relo: DataFrame) -> DataFrame:
    """Idle taxis of a platform spread by the relocation probabilities."""
    return (
        idle.where(F.col("idle") > 0)
        .join(relo, ["day", "hour"])
        .select("scenario", "platform", "zone", "day", "hour", (F.col("idle") * F.col("p")).alias("arrivals"))
    )


def next_inventory(matched: DataFrame, dest_prob: DataFrame, relo: DataFrame) -> DataFrame:
    """Taxis per platform and zone one hour later: arrivals of trips plus relocated idle taxis.

    Every cell of `matched` has its row one hour later, 0 where no taxi comes.
    """
    cells = matched.select(*CELL, F.lit(0.0).alias("arrivals"))
    both = cells.unionByName(arrivals(matched, dest_prob)).unionByName(relocated(idle_totals(matched), relo))
    later_day, later_hour = next_slot()
    return (
        both.groupBy(*CELL)
        .agg(F.sum("arrivals").alias("n_taxis"))
        .select("scenario", "platform", "zone", later_day.alias("day"), later_hour.alias("hour"), "n_taxis")
    )


# --- row-level draws ------------------------------------------------------------------------


def assign_destinations(trips: DataFrame, guide: DataFrame, keys: list[str], seed: int = 42) -> DataFrame:
    """Give each trip a destination by inverse CDF with a hashed uniform number.

    `guide` is `cdf_guide`: a trip meets the few destinations that its slot and its number's part may mean, whatever their
    number, and a slot with many trips is spread over `GUIDE` keys. A trip in a slot without a row there is an error.
    """
    columns = [c for c in trips.columns if c != "dest"]
    numbered = trips.select(*columns).withColumn("_u", unit_hash(*keys, seed=seed)).withColumn("_part", F.floor(F.col("_u") * GUIDE).cast("int"))
    steps = guide.select(*[F.col(c).alias(f"_{c}") for c in guide.columns])
    same = [F.col(c) == F.col(f"_{c}") for c in SLOT] + [F.col("_part") == F.col("_guide")]
    inside = (F.col("_u") > F.col("_low")) & (F.col("_u") <= F.col("_high"))
    met = numbered.join(steps, [*same, inside], "left")
    return met.select(*columns, known("_dest", dict(guide.dtypes)["dest"]).alias("dest"))


#: Standard deviations on each side of the mean outside of which a Poisson count has less than 1e-18 of its mass.
TAIL = 9.0


def _poisson_quantile(u: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """Smallest k whose Poisson CDF reaches u, for all rows of a batch at once.

    Of each row only the counts within `TAIL` standard deviations of the mean are summed, from below: large rates neither
    underflow nor step up from 0, and a row costs what its own rate costs. Rows of about equal width are summed together, a bounded number of values at a time.
    """
    k = np.zeros(len(u), dtype=np.int64)
    spread = TAIL * np.sqrt(np.maximum(rate, 0.0))
    low = np.maximum(np.floor(rate - spread - 30), 0.0)
    width = (np.ceil(rate + spread + 60) - low).astype(np.int64)
    rows = np.flatnonzero((rate > 0) & (u > 0))
    rows = rows[np.argsort(width[rows], kind="stable")]
    at = 0
    while at < len(rows):
        widest = 2 * width[rows[at]]
        many = min(int(np.searchsorted(width[rows[at:]], widest, "right")), max(1, (1 << 20) // int(widest)))
        some = rows[at : at + many]
        counts = low[some, None] + np.arange(width[some].max())
        mean = rate[some, None]
        # from the ratios of neighbours, and all together are 1: no factorial of a large number, nothing to underflow
        growth = np.log(mean) - np.log(np.maximum(counts[:, 1:], 1))
        chance = np.concatenate((np.zeros((len(some), 1)), np.cumsum(growth, axis=1)), axis=1)
        chance = np.exp(chance - chance.max(axis=1, keepdims=True))
        chance /= chance.sum(axis=1, keepdims=True)
        below = np.cumsum(chance, axis=1) < u[some, None]
        k[some] = low[some] + np.minimum(below.sum(axis=1), width[some] - 1)
        at += many
    return k


def sample_counts(rates: DataFrame, replications: int, seed: int = 42) -> DataFrame:
    """Independent Poisson counts per (replication, zone, day, hour) at the given rates."""

    @F.pandas_udf("bigint")
    def quantile(u: pd.Series, rate: pd.Series) -> pd.Series:
        return pd.Series(_poisson_quantile(u.to_numpy(float), rate.fillna(0.0).to_numpy(float)))

    drawn = rates.withColumn("replication", F.explode(F.sequence(F.lit(0), F.lit(replications - 1))))
    u = unit_hash("replication", *SLOT, seed=seed)
    return drawn.select("replication", *SLOT, quantile(u, F.col("demand")).alias("requests"))
