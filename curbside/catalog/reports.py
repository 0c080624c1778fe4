"""Reports over experiment logs."""

from pyspark.sql import functions as F

from curbside.catalog.inputs import FLEET
from curbside.catalog.registry import query
from curbside.catalog.sql import r2, r4
from curbside.functions.menu import multiplier_of
from curbside.functions.numeric import r2 as round2, r4 as round4
from curbside.operators import reports
from curbside.sources import adapters

FREEZE, UNFREEZE, DEVIATOR = 70, 140, 1
ROLE = f"CASE WHEN firm_id = {DEVIATOR} THEN 'deviator' ELSE 'frozen_then_unfrozen' END"


@query("b12_revenue_per_taxi", f"SELECT iteration, firm_id, {r4('profit / fleet_size')} AS revenue_per_taxi FROM timeline JOIN fleet ON platform = firm_id")
def revenue_per_taxi(t):
    return reports.per_taxi(t.timeline, FLEET).select(
        "iteration", "firm_id", round4("revenue_per_taxi").alias("revenue_per_taxi")
    )


PHASE = f"CASE WHEN iteration < {FREEZE} THEN 'before' WHEN iteration < {UNFREEZE} THEN 'freeze' ELSE 'after' END"


@query(
    "c3_phase_masks",
    f"SELECT {PHASE} AS phase, firm_id, count(*) AS iterations, {r2('sum(profit)')} AS profit FROM timeline GROUP BY 1, 2",
)
def phase_masks(t):
    marked = t.timeline.withColumns({"freeze_iteration": F.lit(FREEZE), "unfreeze_iteration": F.lit(UNFREEZE)})
    return marked.groupBy(reports.phase_of().alias("phase"), "firm_id").agg(
        F.count("*").alias("iterations"), round2(F.sum("profit")).alias("profit")
    )


@query(
    "f11_labelled_timeline",
    f"""SELECT iteration, firm_id, {r2('profit')} AS profit,
        CASE WHEN iteration < {FREEZE} THEN 'before_freeze_expected_policy_eval'
             WHEN iteration < {UNFREEZE} AND firm_id = {DEVIATOR} THEN 'after_freeze_deviator_learning'
             WHEN iteration < {UNFREEZE} THEN 'after_freeze_expected_policy_frozen'
             ELSE 'after_unfreeze_all_learning' END AS phase,
        CAST(firm_id = {DEVIATOR} AS INT) AS is_deviator,
        CAST(iteration >= {FREEZE} AND iteration < {UNFREEZE} AND firm_id <> {DEVIATOR} AS INT) AS is_frozen,
        {FREEZE} AS freeze_iteration, {UNFREEZE} AS unfreeze_iteration FROM timeline""",
)
def labelled_timeline(t):
    freeze, unfreeze = reports.phase_bounds(70, 70)
    return reports.label_phases(t.timeline, DEVIATOR, freeze, unfreeze).withColumn("profit", round2("profit"))


@query(
    "e18_firm_columns",
    "SELECT iteration, "
    + ", ".join(f"{r2(f'max(value) FILTER (WHERE firm_id = {k})')} AS firm_{k}" for k in range(4))
    + " FROM firm_grid GROUP BY 1",
)
def firm_columns(t):
    wide = reports.firm_columns(t.timeline, "profit")
    return wide.select("iteration", *[round2(f"firm_{k}").alias(f"firm_{k}") for k in range(4)])


def _mean(where: str) -> str:
    return f"(avg(value) FILTER (WHERE {where}))"


PHASES = {
    "before_freeze": f"iteration < {FREEZE}",
    "freeze_phase": f"iteration >= {FREEZE} AND iteration < {UNFREEZE}",
    "post_unfreeze": f"iteration >= {UNFREEZE}",
}


@query(
    "e19_phase_summary",
    f"SELECT {DEVIATOR} AS deviator_firm_id, firm_id, {ROLE} AS role, CAST(fleet_size AS BIGINT) AS fleet_size, "
    + ", ".join(f"{r4(_mean(w))} AS {n}_mean_revenue" for n, w in PHASES.items())
    + f", {r4('sum(value)')} AS final_cumulative_revenue, "
    + ", ".join(f"{r4(_mean(w) + ' / fleet_size')} AS {n}_mean_rev_per_taxi" for n, w in PHASES.items())
    + f", {r4('sum(value) / fleet_size')} AS final_cumulative_rev_per_taxi "
    "FROM firm_grid JOIN fleet ON platform = firm_id GROUP BY firm_id, fleet_size",
)
def phase_summary(t):
    out = reports.phase_summary(t.timeline, DEVIATOR, FLEET, FREEZE, UNFREEZE)
    return out.withColumns({c: round4(c) for c in out.columns[4:]})


@query(
    "e20_interval_multipliers",
    "SELECT run, agent, arm, "
    + ", ".join(
        r2(
            "("
            + " + ".join(f"(count(*) FILTER (WHERE episode // 10 = {i} AND action = {a})) * {m}::DOUBLE" for a, m in enumerate((1.0, 1.2, 1.5, 1.8, 2.0)))
            + f") / nullif(count(*) FILTER (WHERE episode // 10 = {i}), 0)"
        )
        + f' AS "{i * 10}-{i * 10 + 10}"'
        for i in range(3)
    )
    + " FROM decisions GROUP BY 1, 2, 3",
)
def interval_multipliers(t):
    return reports.interval_multipliers(t.decisions, 31)


@query("e21_episode_revenue", f"SELECT run, agent, episode, {r2('sum(reward)')} AS revenue FROM decisions GROUP BY 1, 2, 3")
def episode_revenue(t):
    return reports.episode_revenue(t.decisions).withColumn("revenue", round2("revenue"))


@query(
    "e22_firm_episodes",
    f"SELECT iteration, firm_id, {r2('sum(reward)')} AS profit, {r4('sum(multiplier) / (SELECT count(DISTINCT zone) * max(n) FROM (SELECT zone, count(*) OVER (PARTITION BY iteration, firm_id, zone) AS n FROM firm_log))')} AS avg_multiplier FROM firm_log GROUP BY 1, 2",
)
def firm_episodes(t):
    log = t.firm_log.withColumn("multiplier", multiplier_of("action"))
    steps = log.groupBy("iteration", "firm_id", "zone").count()
    size = steps.agg(F.countDistinct("zone").alias("zones"), F.max("count").alias("steps")).first()
    return reports.firm_episodes(log, size.zones or 1, size.steps or 1).withColumns(
        {"profit": round2("profit"), "avg_multiplier": round4("avg_multiplier")}
    )


@query(
    "e23_sweep_summary",
    f"""SELECT count(*) AS runs, count(*) FILTER (WHERE o_orderstatus <> 'F') AS successes,
        count(*) FILTER (WHERE o_orderstatus = 'F') AS failures, {r2('sum(o_totalprice)')} AS total_duration FROM orders""",
)
def sweep_summary(t):
    out = reports.sweep_summary(adapters.run_log(t.spark, t.sf_dir))
    return out.withColumn("total_duration", round2("total_duration"))


@query(
    "e23_failed_runs",
    "SELECT CAST(o_custkey % 4 AS INT) AS deviator, o_orderkey AS seed, o_totalprice AS duration FROM orders WHERE o_orderstatus = 'F'",
)
def failed_runs(t):
    return reports.failed_runs(adapters.run_log(t.spark, t.sf_dir))


@query("d10_sweep_grid", "SELECT o_orderkey AS seed, CAST(range AS INT) AS deviator FROM orders CROSS JOIN range(4)")
def sweep_grid(t):
    return reports.sweep_grid(t.table("orders").select(F.col("o_orderkey").alias("seed")))


@query(
    "f5_cumulative_revenue",
    f"SELECT iteration, firm_id, {r2('value')} AS value, {r2('sum(value) OVER (PARTITION BY firm_id ORDER BY iteration)')} AS cumulative FROM firm_grid",
)
def cumulative_revenue(t):
    out = reports.cumulative_revenue(t.timeline)
    return out.withColumns({"value": round2("value"), "cumulative": round2("cumulative")})


EPISODES = "(SELECT run, agent, episode, sum(reward) AS revenue FROM decisions GROUP BY 1, 2, 3)"


@query(
    "f6_trailing_mean",
    f"""SELECT run, agent, episode, {r4('total / 10')} AS moving_avg FROM (
          SELECT *, sum(revenue) OVER w AS total, count(*) OVER w AS n FROM {EPISODES}
          WINDOW w AS (PARTITION BY run, agent ORDER BY episode ROWS 9 PRECEDING)) WHERE n = 10""",
)
def trailing_mean(t):
    series = reports.episode_revenue(t.decisions)
    out = reports.trailing_mean(series, ["run", "agent"], "revenue", n_episodes=30)
    return out.select("run", "agent", "episode", round4("moving_avg").alias("moving_avg"))


@query(
    "f7_centered_mean",
    f"""SELECT firm_id, iteration, {r4('(total + greatest(5 - i, 0) * head + greatest(i + 4 - (n - 1), 0) * tail) / 10')} AS moving_avg
        FROM (SELECT firm_id, iteration, row_number() OVER o - 1 AS i, count(*) OVER (PARTITION BY firm_id) AS n,
                sum(value) OVER (PARTITION BY firm_id ORDER BY iteration ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) AS total,
                first_value(value) OVER (PARTITION BY firm_id ORDER BY iteration ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS head,
                last_value(value) OVER (PARTITION BY firm_id ORDER BY iteration ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS tail
              FROM firm_grid WINDOW o AS (PARTITION BY firm_id ORDER BY iteration))""",
)
def centered_mean(t):
    series = reports.firm_rows(reports.firm_columns(t.timeline, "profit"))
    out = reports.centered_mean(series, ["firm_id"], "value", window=10)
    return out.select("firm_id", "iteration", round4("moving_avg").alias("moving_avg"))


@query("c5_numeric_text", f"SELECT Episode, {r2('CAST(Revenue AS DOUBLE)')} AS value FROM history WHERE TRY_CAST(Revenue AS DOUBLE) IS NOT NULL")
def numeric_text(t):
    history = adapters.single_platform_history(t.spark, t.sf_dir)
    return reports.numbers_only(history, "Revenue").select("Episode", round2("value").alias("value"))


ALIGNED = """(WITH v AS (SELECT row_number() OVER (ORDER BY Episode) - 1 AS i, CAST(Revenue AS DOUBLE) * 0.25 AS value
              FROM history WHERE TRY_CAST(Revenue AS DOUBLE) IS NOT NULL)
            SELECT s.range AS i, coalesce(v.value, (SELECT max_by(value, i) FROM v)) AS value
            FROM range((SELECT max(iteration) + 1 FROM timeline)) s LEFT JOIN v ON v.i = s.range)"""


def _iterations(t) -> int:
    """How many iterations the timeline spans."""
    return (t.timeline.agg(F.max("iteration")).first()[0] or 0) + 1


@query("f8_aligned_series", f"SELECT i, {r2('value')} AS value FROM {ALIGNED}")
def aligned_series(t):
    history = adapters.single_platform_history(t.spark, t.sf_dir)
    return reports.align_series(history, "Episode", "Revenue", _iterations(t), 0.25).withColumn("value", round2("value"))


@query("f9_chosen_column", "SELECT Episode, Revenue AS chosen FROM history")
def chosen_column(t):
    history = adapters.single_platform_history(t.spark, t.sf_dir)
    return history.select("Episode", F.col(reports.value_column(history)).alias("chosen"))


@query(
    "f10_single_platform_share",
    f"""SELECT firm_id, iteration, {r2('value')} AS revenue, {r4('a.share')} AS single_share,
        {r4('a.share / (5000 / 4.0)')} AS single_share_per_taxi
        FROM firm_grid LEFT JOIN (SELECT i, value * 0.25 AS share FROM {ALIGNED}) a ON a.i = iteration""",
)
def single_platform_share(t):
    history = adapters.single_platform_history(t.spark, t.sf_dir)
    single = reports.align_series(history, "Episode", "Revenue", _iterations(t), 0.25).select(
        F.col("i").alias("episode"), F.col("value").alias("revenue")
    )
    platform = reports.firm_rows(reports.firm_columns(t.timeline, "profit")).select(
        "firm_id", F.col("iteration").alias("episode"), F.col("value").alias("revenue")
    )
    out = reports.against_single_platform(platform, single, fleet=5000)
    return out.select(
        "firm_id",
        F.col("episode").alias("iteration"),
        round2("revenue").alias("revenue"),
        round4("single_share").alias("single_share"),
        round4("single_share_per_taxi").alias("single_share_per_taxi"),
    )


@query(
    "h1_appended_phases",
    f"SELECT iteration, firm_id, {r2('profit')} AS profit, {PHASE} AS part FROM timeline",
)
def appended_phases(t):
    it = F.col("iteration")
    before = t.timeline.where(it < FREEZE).withColumn("part", F.lit("before"))
    freeze = t.timeline.where((it >= FREEZE) & (it < UNFREEZE)).withColumn("part", F.lit("freeze"))
    after = t.timeline.where(it >= UNFREEZE).withColumn("part", F.lit("after"))
    return before.unionByName(freeze).unionByName(after).withColumn("profit", round2("profit"))


@query("g1_sorted_graph", "SELECT * FROM graph ORDER BY PULocationID, DOLocationID", one_pass=True)
def sorted_graph(t):
    return t.graph.orderBy("PULocationID", "DOLocationID")
