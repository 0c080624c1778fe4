"""Market arithmetic over a policy table."""

from pyspark.sql import functions as F

from curbside.catalog.inputs import FLEET
from curbside.catalog.registry import query
from curbside.catalog.sql import MENU, r4, r6, unit
from curbside.functions.calendar import slot_clock
from curbside.functions.menu import inventory_bin, multiplier_of
from curbside.functions.numeric import r4 as round4, r6 as round6
from curbside.operators import destination, graph, market
from curbside.operators.reports import origin_totals
from curbside.plans.demand_plan import TRIP_COLUMNS
from curbside.sources.staging import stage

CELL = "scenario, platform, zone, day, hour"


@query(
    "d6_fare_lookup",
    f"""SELECT e.DOLocationID AS zone, e.PULocationID AS dest,
          {r4('CASE WHEN g.PULocationID IS NOT NULL THEN g.baseline_fare ELSE 5.0::DOUBLE * f.price_per_mile + f.intercept END')} AS fare
        FROM edges e CROSS JOIN graph_fit f
        LEFT JOIN graph g ON g.PULocationID = e.DOLocationID AND g.DOLocationID = e.PULocationID""",
    one_pass=True,
)
def fare_lookup(t):
    """Fare of the way back on every edge; where no trip went that way, the default fare."""
    back = t.graph.select(F.col("DOLocationID").alias("zone"), F.col("PULocationID").alias("dest"))
    out = graph.fare_lookup(back, t.graph, graph.fit_line(t.graph))
    return out.withColumn("fare", round4("fare"))


@query("k3_dense_fares", f"SELECT zone, dest, {r4('fare')} AS fare FROM fares", one_pass=True)
def dense_fares(t):
    return t.fares.select("zone", "dest", round4("fare").alias("fare"))


@query("k4_thinned_demand", f"""SELECT scenario, platform, p.zone, p.day, p.hour,
    {r4('demand * exp(-0.4 * (multiplier - 1.0))')} AS demand FROM policy p JOIN demand USING (zone, day, hour)""")
def thinned_demand(t):
    return market.thin_demand(t.demand, t.policy).withColumn("demand", round4("demand"))


@query("k5_choice_shares", f"SELECT {CELL}, {r6('share')} AS share FROM shares")
def choice_shares(t):
    return t.shares.drop("multiplier").withColumn("share", round6("share"))


@query("k6_split_demand", f"SELECT {CELL}, {r4('demand')} AS demand FROM split")
def split_demand(t):
    return t.split.drop("multiplier").withColumn("demand", round4("demand"))


@query("k7_matched", f"SELECT {CELL}, {r4('demand')} AS demand, {r4('n_taxis')} AS n_taxis, {r4('matched')} AS matched, {r4('idle')} AS idle FROM matched")
def matched(t):
    return t.matched.drop("multiplier").withColumns({c: round4(c) for c in ("demand", "n_taxis", "matched", "idle")})


@query("k7_idle_totals", f"SELECT scenario, platform, day, hour, {r4('sum(idle)')} AS idle FROM matched GROUP BY 1, 2, 3, 4")
def idle_totals(t):
    return market.idle_totals(t.matched).withColumn("idle", round4("idle"))


@query(
    "c4_active_rows",
    f"""SELECT scenario, platform, count(*) AS active, {r4('sum(matched)')} AS matched FROM matched WHERE matched > 0 GROUP BY 1, 2""",
)
def active_rows(t):
    live = t.matched.drop("multiplier").where(F.col("matched") > 0)
    return live.groupBy("scenario", "platform").agg(
        F.count("*").alias("active"), round4(F.sum("matched")).alias("matched")
    )


@query(
    "k8_routed_trips",
    f"""SELECT m.scenario, m.platform, m.zone, p.dest, {r4('sum(m.matched * p.p)')} AS flow
        FROM matched m JOIN dest_prob p USING (zone, day, hour) GROUP BY 1, 2, 3, 4""",
)
def routed_trips(t):
    flows = market.route_trips(t.matched, t.dest_prob)
    return flows.groupBy("scenario", "platform", "zone", "dest").agg(round4(F.sum("flow")).alias("flow"))


REVENUE = f"""SELECT m.scenario, m.platform, m.zone, m.day, m.hour,
    {r4('m.matched * coalesce(f.mean_fare, 0) * p.multiplier')} AS revenue
    FROM matched m JOIN policy p USING (scenario, platform, zone, day, hour)
    LEFT JOIN fare_means f ON f.zone = m.zone AND f.day = m.day AND f.hour = m.hour"""


@query("k9_revenue", REVENUE)
def revenue(t):
    return market.revenue(t.matched, t.fare_means).withColumn("revenue", round4("revenue"))


@query(
    "d9_gathered_fares",
    f"""SELECT m.scenario, m.platform, m.zone, {r4('sum(m.matched * p.p * f.fare * y.multiplier)')} AS revenue
        FROM matched m JOIN dest_prob p USING (zone, day, hour) JOIN fares f ON f.zone = m.zone AND f.dest = p.dest
        JOIN policy y ON y.scenario = m.scenario AND y.platform = m.platform AND y.zone = m.zone AND y.day = m.day AND y.hour = m.hour
        GROUP BY 1, 2, 3""",
)
def gathered_fares(t):
    flows = market.route_trips(t.matched, t.dest_prob)
    paid = flows.join(t.fares, ["zone", "dest"]).join(t.policy, market.CELL)
    return paid.groupBy("scenario", "platform", "zone").agg(
        round4(F.sum(F.col("flow") * F.col("fare") * F.col("multiplier"))).alias("revenue")
    )


@query(
    "f2_normalised_demand",
    f"""SELECT zone, day, hour, {r6('CASE WHEN total > 0 THEN demand / total ELSE 1.0 / n END')} AS p
        FROM (SELECT *, sum(demand) OVER (PARTITION BY day, hour) AS total, count(*) OVER (PARTITION BY day, hour) AS n FROM demand)""",
)
def normalised_demand(t):
    return market.normalised_demand(t.demand).withColumn("p", round6("p"))


@query("k10_relocation_probs", f"SELECT zone, day, hour, {r6('p')} AS p FROM relo")
def relocation_probs(t):
    return t.relocation.withColumn("p", round6("p"))


NEXT = f"""SELECT scenario, platform, zone,
      CASE WHEN hour = 23 THEN (day + 1) % 7 ELSE day END AS day, CASE WHEN hour = 23 THEN 0 ELSE hour + 1 END AS hour,
      {r4('sum(arrivals)')} AS n_taxis
    FROM (SELECT scenario, platform, zone, day, hour, 0.0::DOUBLE AS arrivals FROM matched UNION ALL
          SELECT * FROM arrivals UNION ALL
          SELECT i.scenario, i.platform, r.zone, i.day, i.hour, i.idle * r.p
          FROM (SELECT scenario, platform, day, hour, sum(idle) AS idle FROM matched GROUP BY 1, 2, 3, 4) i
          JOIN relo r USING (day, hour) WHERE i.idle > 0)
    GROUP BY 1, 2, 3, 4, 5"""


@query("h2_arrivals_and_relocations", f"SELECT scenario, platform, zone, CAST(sum(n_rows) AS BIGINT) AS n_rows, {r4('sum(taxis)')} AS taxis FROM "
       "(SELECT scenario, platform, zone, count(*) AS n_rows, sum(arrivals) AS taxis FROM arrivals GROUP BY 1, 2, 3 UNION ALL "
       "SELECT i.scenario, i.platform, r.zone, count(*), sum(i.idle * r.p) FROM "
       "(SELECT scenario, platform, day, hour, sum(idle) AS idle FROM matched GROUP BY 1, 2, 3, 4) i "
       "JOIN relo r USING (day, hour) WHERE i.idle > 0 GROUP BY 1, 2, 3) GROUP BY 1, 2, 3")
def arrivals_and_relocations(t):
    both = market.arrivals(t.matched, t.dest_prob).unionByName(
        market.relocated(market.idle_totals(t.matched), t.relocation)
    )
    return both.groupBy("scenario", "platform", "zone").agg(
        F.count("*").alias("n_rows"), round4(F.sum("arrivals")).alias("taxis")
    )


@query("k11_next_inventory", NEXT)
def next_inventory(t):
    return market.next_inventory(t.matched, t.dest_prob, t.relocation).withColumn("n_taxis", round4("n_taxis"))


@query(
    "k12_initial_inventory",
    f"""SELECT platform, PULocationID AS zone, {r4('CAST(fleet_size AS DOUBLE) / (SELECT count(*) FROM zones)')} AS n_taxis
        FROM fleet CROSS JOIN zones""",
    one_pass=True,
)
def initial_inventory(t):
    return market.initial_inventory(t.zone_ids, FLEET).withColumn("n_taxis", round4("n_taxis"))


DRAWN_COLUMNS = ("trip_key", "PULocationID", "day_of_week", "request_hour", "DOLocationID")
DRAWN = f"""SELECT t.trip_key, t.zone, c.dests[1 + least(len(list_filter(c.cdf, lambda x: x < t.u)), len(c.cdf) - 1)] AS dest
    FROM (SELECT trip_key, PULocationID AS zone, day_of_week AS day, request_hour AS hour, {unit('trip_key')} AS u FROM trips) t
    JOIN (SELECT zone, day, hour, list(dest ORDER BY dest) AS dests, list(cdf ORDER BY dest) AS cdf
          FROM cdf GROUP BY 1, 2, 3) c USING (zone, day, hour)"""


@query("d8_inverse_cdf", DRAWN.replace("t.zone, c.dests", "t.zone, t.day, t.hour, c.dests"), keep=DRAWN_COLUMNS)
def inverse_cdf(t):
    return _drawn(t).select("trip_key", "zone", "day", "hour", "dest")


@query("k13_assigned_destinations", DRAWN, keep=DRAWN_COLUMNS)
def assigned_destinations(t):
    return _drawn(t).select("trip_key", "zone", "dest")


def _drawn(t):
    rows = t.kept_trips.select(
        "trip_key",
        F.col("PULocationID").alias("zone"),
        F.col("day_of_week").alias("day"),
        F.col("request_hour").alias("hour"),
    )
    guide = stage(destination.cdf_guide(destination.running_cdf(t.dest_prob)), "destination-guide")
    return market.assign_destinations(rows, guide, ["trip_key"])


@query(
    "e17_origin_destination_totals",
    f"""SELECT zone, {r4('sum(revenue)')} AS revenue, CAST(sum(arrivals) AS BIGINT) AS arrivals FROM (
          SELECT d.zone, f.fare AS revenue, 0 AS arrivals FROM ({DRAWN}) d JOIN fares f ON f.zone = d.zone AND f.dest = d.dest
          UNION ALL SELECT d.dest, 0, 1 FROM ({DRAWN}) d) GROUP BY 1""",
    keep=("trip_key", *TRIP_COLUMNS),
)
def origin_destination_totals(t):
    paid = graph.fare_lookup(_drawn(t), t.graph, graph.fit_line(t.graph))
    return origin_totals(paid).withColumn("revenue", round4("revenue"))


@query(
    "k14_sampled_counts",
    f"""SELECT CAST(replication AS INT) AS replication, zone, day, hour, CAST(count(*) FILTER (WHERE cdf < u) AS BIGINT) AS requests FROM (
          SELECT r.range AS replication, d.zone, d.day, d.hour, k.range AS k,
            {unit("concat_ws(':', r.range, d.zone, d.day, d.hour)")} AS u,
            sum(CASE WHEN d.demand > 0 THEN exp(k.range * ln(d.demand) - d.demand - lgamma(k.range + 1))
                ELSE CASE WHEN k.range = 0 THEN 1.0 ELSE 0.0 END END)
              OVER (PARTITION BY r.range, d.zone, d.day, d.hour ORDER BY k.range ROWS UNBOUNDED PRECEDING) AS cdf
          FROM demand d CROSS JOIN range(3) r CROSS JOIN range(200) k) GROUP BY 1, 2, 3, 4""",
)
def sampled_counts(t):
    return market.sample_counts(t.demand, 3)


@query(
    "i6_slot_clock",
    """SELECT event_id, CAST((2 + (5 + event_id) // 24) % 7 AS INT) AS day, CAST((5 + event_id) % 24 AS INT) AS hour,
       CAST((2 + (6 + event_id) // 24) % 7 AS INT) AS next_day, CAST((6 + event_id) % 24 AS INT) AS next_hour FROM events""",
)
def slot_clock_of_steps(t):
    day, hour = slot_clock("event_id", start_day=2, start_hour=5)
    next_day, next_hour = slot_clock("event_id", start_day=2, start_hour=5, ahead=1)
    return t.table("events").select(
        "event_id", day.alias("day"), hour.alias("hour"), next_day.alias("next_day"), next_hour.alias("next_hour")
    )


@query("i7_inventory_bins", "SELECT step, least(n_taxis // 2, 9) AS bin FROM decisions")
def inventory_bins(t):
    return t.decisions.select("step", inventory_bin("n_taxis", bin_size=2).alias("bin"))


@query("i8_menu_lookup", f"SELECT step, action, list_extract({MENU}, action + 1) AS multiplier FROM decisions")
def menu_lookup(t):
    return t.decisions.select("step", "action", multiplier_of("action").alias("multiplier"))


@query(
    "i10_fleet_split",
    "SELECT platform, CAST(fleet_size AS BIGINT) AS fleet_size, (SELECT CAST(sum(fleet_size) AS BIGINT) FROM fleet) AS total, "
    "(SELECT count(*) FROM zones) AS zones FROM fleet",
    one_pass=True,
)
def fleet_split(t):
    n_zones = t.zone_ids.agg(F.count("*")).scalar()
    return market.fleet_table(t.spark, FLEET).select(
        "platform", "fleet_size", F.lit(market.total_fleet(FLEET)).cast("bigint").alias("total"), n_zones.alias("zones")
    )
