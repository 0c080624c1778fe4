import math

import numpy as np

import pytest
from pyspark.sql import functions as F

from curbside.functions.menu import MULTIPLIERS
from curbside.functions.hashing import unit_hash
from curbside.operators import destination, graph, market
from curbside.operators.reports import origin_totals
from curbside.plans.market_plan import evaluate_policies

ZONES = (1, 2, 5)


@pytest.fixture(scope="module")
def world(spark):
    zones = spark.createDataFrame([(z,) for z in ZONES], "zone int")
    demand = spark.createDataFrame(
        [(z, d, h, float((z * 7 + d * 3 + h) % 11) if h != 4 else 0.0) for z in ZONES for d in range(7) for h in range(24)],
        "zone int, day int, hour int, demand double",
    )
    policy = spark.createDataFrame(
        [(s, k, z, d, h, MULTIPLIERS[(len(s) + k + z + d + h) % 5]) for s in ("a", "bb") for k in range(4) for z in ZONES for d in range(7) for h in range(24)],
        "scenario string, platform int, zone int, day int, hour int, multiplier double",
    )
    weights = {1: (1, 2, 1), 2: (0, 1, 3), 5: (2, 2, 4)}
    dest_prob = spark.createDataFrame(
        [(z, d, h, y, w / sum(weights[z])) for z in ZONES for d in range(7) for h in range(24) for y, w in zip(ZONES, weights[z])],
        "zone int, day int, hour int, dest int, p double",
    )
    inventory = policy.drop("multiplier").join(market.initial_inventory(zones, [12, 9, 6, 3]), ["platform", "zone"]).select(*market.CELL, "n_taxis")
    return zones, demand, policy, dest_prob, inventory


def test_shares_sum_to_one_with_the_outside_option(world):
    _, _, policy, _, _ = world
    total = market.choice_shares(policy).groupBy("scenario", "zone", "day", "hour").agg(F.sum("share").alias("s"), F.count("*").alias("n"))
    assert total.where((F.abs(F.col("s") - 1) > 1e-12) | (F.col("n") != 5)).isEmpty()


def test_shares_of_one_slot(spark):
    prices = [1.0, 1.2, 1.5, 2.0]
    policy = spark.createDataFrame([("a", k, 1, 0, 0, m) for k, m in enumerate(prices)], "scenario string, platform int, zone int, day int, hour int, multiplier double")
    got = {r.platform: r.share for r in market.choice_shares(policy).collect()}
    v = [math.exp(-0.4 * (m - 1)) for m in prices]
    accept = math.exp(-0.4 * (sum(prices) / 4 - 1))
    for k in range(4):
        assert math.isclose(got[k], accept * v[k] / sum(v))
    assert math.isclose(got[market.OUTSIDE], 1 - accept)


def test_matching_and_inventory_are_conserved(world):
    _, demand, policy, dest_prob, inventory = world
    matched = market.match(market.split_demand(demand, market.choice_shares(policy)), inventory)
    assert matched.count() == policy.count()
    assert matched.where((F.col("matched") > F.least("demand", "n_taxis") + 1e-12) | (F.col("idle") < 0)).isEmpty()
    later = market.next_inventory(matched, dest_prob, market.relocation_probs(demand))
    before = matched.groupBy("scenario", "platform").agg(F.sum("n_taxis").alias("a"))
    after = later.groupBy("scenario", "platform").agg(F.sum("n_taxis").alias("b"))
    pairs = before.join(after, ["scenario", "platform"]).collect()
    assert len(pairs) == 8 and all(math.isclose(r.a, r.b, rel_tol=1e-9) for r in pairs)


def test_relocation_is_uniform_where_the_next_hour_is_empty(world):
    zones, demand, *_ = world
    probs = market.relocation_probs(demand)
    assert probs.where("hour = 3").select("p").distinct().collect()[0].p == 1 / 3
    assert probs.where("day = 6 AND hour = 23").count() == 3


def test_revenue_without_flows_equals_revenue_over_flows(spark, world):
    _, demand, policy, dest_prob, inventory = world
    fares = spark.createDataFrame([(a, b, 5.0 + a + 2 * b) for a in ZONES for b in ZONES], "zone int, dest int, fare double")
    matched = market.match(market.split_demand(demand, market.choice_shares(policy)), inventory)
    short = market.revenue(matched, market.mean_fare(dest_prob, fares), policy).agg(F.sum("revenue")).first()[0]
    flows = market.route_trips(matched, dest_prob).join(fares, ["zone", "dest"]).join(policy, market.CELL)
    long = flows.agg(F.sum(F.col("flow") * F.col("fare") * F.col("multiplier"))).first()[0]
    assert math.isclose(short, long, rel_tol=1e-9)


@pytest.mark.parametrize("per_task", [1, 256])
def test_arrivals_equal_summed_flows(world, per_task):
    _, demand, policy, dest_prob, inventory = world
    matched = market.match(market.split_demand(demand, market.choice_shares(policy)), inventory)
    got = {tuple(r[:5]): r[5] for r in market.arrivals(matched, dest_prob, per_task).select("scenario", "platform", "zone", "day", "hour", "arrivals").collect()}
    flows = market.route_trips(matched, dest_prob).groupBy("scenario", "platform", "dest", "day", "hour").agg(F.sum("flow"))
    want = {tuple(r[:5]): r[5] for r in flows.collect() if r[5] > 0}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)


def test_thinned_demand(spark):
    demand = spark.createDataFrame([(1, 0, 0, 10.0)], "zone int, day int, hour int, demand double")
    policy = spark.createDataFrame([("a", 0, 1, 0, 0, 1.5), ("a", 0, 2, 0, 0, 1.5)], "scenario string, platform int, zone int, day int, hour int, multiplier double")
    got = {r.zone: r.demand for r in market.thin_demand(demand, policy).collect()}
    assert math.isclose(got[1], 10 * math.exp(-0.2)) and got[2] == 0.0


def test_draws_follow_the_cdf(spark, world):
    _, _, _, dest_prob, _ = world
    cdf = destination.cdf_guide(destination.running_cdf(dest_prob))
    trips = spark.range(30000).select("id", F.lit(1).alias("zone"), F.lit(0).alias("day"), F.lit(0).alias("hour"))
    got = dict(market.assign_destinations(trips, cdf, ["id"]).groupBy("dest").count().collect())
    assert abs(got[1] / 30000 - 0.25) < 0.02 and abs(got[2] / 30000 - 0.5) < 0.02
    paid = market.assign_destinations(trips, cdf, ["id"]).withColumn("fare", F.lit(2.0))
    rows = {r.zone: r for r in origin_totals(paid).collect()}
    assert rows[1].revenue == 60000.0 and sum(r.arrivals for r in rows.values()) == 30000


def test_guided_draws_are_those_of_the_whole_cdf(spark):
    """Every number meets exactly one destination: how many cumulative values lie below it, at most the last."""
    rng = np.random.default_rng(2)
    slots = {(z, 0, 0): np.cumsum(rng.dirichlet(np.full(n, 0.1))) for z, n in ((1, 1), (2, 3), (3, 500))}
    slots[4, 0, 0] = np.array([0.25, 0.5, 0.5, 0.75])  # equal steps, and a last one below 1
    rows = [(*slot, dest, float(c)) for slot, cdf in slots.items() for dest, c in enumerate(cdf)]
    cdf = spark.createDataFrame(rows, "zone int, day int, hour int, dest int, cdf double")
    trips = spark.range(4000).select("id", (F.col("id") % 4 + 1).cast("int").alias("zone"), F.lit(0).alias("day"), F.lit(0).alias("hour"))
    got = {r.id: r.dest for r in market.assign_destinations(trips, destination.cdf_guide(cdf), ["id"]).collect()}
    number = {r.id: (r.zone, r.u) for r in trips.select("id", "zone", unit_hash("id").alias("u")).collect()}
    assert got == {i: min(int((slots[z, 0, 0] < u).sum()), len(slots[z, 0, 0]) - 1) for i, (z, u) in number.items()}
    plan = market.assign_destinations(trips, destination.cdf_guide(cdf), ["id"])
    assert not any(kind.startswith("array") for _, kind in plan.dtypes)


@pytest.mark.parametrize("rate", [0.3, 7.0, 80.0, 900.0, 12345.6, 1e6])
def test_poisson_quantiles_are_exact(rate):
    """The smallest count whose probability of being reached is enough, from probabilities of a wider range."""
    u = np.array([0.0, 1e-12, 0.001, 0.3, 0.5, 0.9, 0.999, 1 - 1e-9])
    mixed = np.concatenate((u, u, u)), np.concatenate((np.full(8, rate), np.full(8, 2.0), np.full(8, 1e6)))
    got = market._poisson_quantile(*mixed)[:8]
    low, high = max(0, int(rate - 12 * rate**0.5 - 40)), int(rate + 12 * rate**0.5 + 60)
    log = [k * math.log(rate) - rate - math.lgamma(k + 1) for k in range(low, high)]
    chance = np.exp(np.array(log))
    reached = np.cumsum(chance / math.fsum(chance))
    for x, k in zip(u[1:], got[1:]):
        want = low + int((reached < x).sum())
        assert abs(int(k) - want) <= (1 if rate > 1e5 else 0)  # a million logarithms end in rounding of their own
    assert got[0] == 0


def test_poisson_counts_have_the_right_mean_and_spread(spark):
    rates = spark.createDataFrame([(z, 0, h, r) for z, r in ((1, 0.0), (2, 3.5), (3, 900.0)) for h in range(24)], "zone int, day int, hour int, demand double")
    out = market.sample_counts(rates, 100)
    assert out.count() == 7200
    stats = {r.zone: r for r in out.groupBy("zone").agg(F.avg("requests").alias("m"), F.var_samp("requests").alias("v")).collect()}
    assert stats[1].m == 0
    for zone, rate in ((2, 3.5), (3, 900.0)):
        assert abs(stats[zone].m - rate) < 5 * math.sqrt(rate / 2400) and abs(stats[zone].v / rate - 1) < 0.2


def test_step_plan(spark, world):
    _, demand, policy, dest_prob, inventory = world
    latent = demand.select(
        F.col("zone").alias("PULocationID"), F.col("day").alias("day_of_week"), F.col("hour").alias("request_hour"),
        F.col("demand").alias("historical_poisson"), F.lit(1.0).alias("avg_historical_acceptance"), F.col("demand").alias("latent_poisson"),
    )
    edges = spark.createDataFrame(
        [(1, 2, 2.0, 1.0, 9.0), (2, 5, 4.0, 1.0, 13.0)],
        "PULocationID int, DOLocationID int, baseline_distance double, baseline_time double, baseline_fare double",
    )
    step = evaluate_policies(policy, inventory, latent, dest_prob, edges)
    assert step.revenue.count() == policy.count() and step.revenue.where("revenue < 0").isEmpty()
    assert step.inventory.count() == policy.count()
    assert graph.fit_line(edges).first().price_per_mile == 2.0


def test_next_inventory_has_every_zone_and_loses_no_taxi(spark):
    cells = [("a", 0, 1, 0, 5, 4.0, 4.0, 4.0, 0.0), ("a", 0, 2, 0, 5, 1.0, 1.0, 1.0, 0.0)]
    names = "scenario string, platform int, zone int, day int, hour int, demand double, n_taxis double, matched double, idle double"
    matched = spark.createDataFrame(cells, names)
    dest_prob = spark.createDataFrame([(z, 0, 5, 1, 1.0) for z in (1, 2)], "zone int, day int, hour int, dest int, p double")
    relo = spark.createDataFrame([(z, 0, 5, 0.5) for z in (1, 2)], "zone int, day int, hour int, p double")
    got = {(r.zone, r.day, r.hour): r.n_taxis for r in market.next_inventory(matched, dest_prob, relo).collect()}
    assert got == {(1, 0, 6): 5.0, (2, 0, 6): 0.0}


@pytest.mark.parametrize("step", ["arrivals", "flows", "revenue", "draws"])
def test_a_slot_without_a_distribution_is_an_error(spark, step):
    cells = [("a", 0, z, 0, 5, 4.0, 4.0, 4.0, 0.0) for z in (1, 2)]
    names = "scenario string, platform int, zone int, day int, hour int, demand double, n_taxis double, matched double, idle double"
    matched = spark.createDataFrame(cells, names)
    dest_prob = spark.createDataFrame([(1, 0, 5, 1, 1.0)], "zone int, day int, hour int, dest int, p double")
    made = {
        "arrivals": lambda: market.arrivals(matched, dest_prob),
        "flows": lambda: market.route_trips(matched, dest_prob),
        "revenue": lambda: market.revenue(
            matched, market.mean_fare(dest_prob, spark.createDataFrame([(1, 1, 5.0)], "zone int, dest int, fare double")),
            matched.select(*market.CELL, F.lit(1.0).alias("multiplier")),
        ),
        "draws": lambda: market.assign_destinations(
            matched.select("zone", "day", "hour"), destination.cdf_guide(destination.running_cdf(dest_prob)), ["zone"]
        ),
    }[step]()
    with pytest.raises(Exception, match="no destination distribution"):
        made.collect()


def test_slots_without_trips_take_the_distribution_of_their_zone(spark):
    counts = spark.createDataFrame(
        [(1, 0, 0, 1, 30), (1, 0, 0, 2, 10), (2, 0, 0, 2, 20)],
        "PULocationID int, day_of_week int, request_hour int, DOLocationID int, n long",
    )
    slots = spark.createDataFrame([(1, 0, 0), (1, 3, 4), (9, 0, 0)], "PULocationID int, day_of_week int, request_hour int")
    rows = destination.destination_distribution(counts, slots=slots).collect()
    got = {(r.PULocationID, r.day_of_week, r.DOLocationID): r.p for r in rows}
    assert len(got) == 6
    assert math.isclose(got[9, 0, 1], 0.5) and math.isclose(got[9, 0, 2], 0.5)
    assert math.isclose(got[1, 3, 1], 35 / 50) and math.isclose(got[1, 3, 2], 15 / 50)
    assert math.isclose(got[1, 0, 1], (30 + 10 * 35 / 50) / 50)
