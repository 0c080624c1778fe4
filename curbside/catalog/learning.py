"""Learning from logged decisions."""

from pyspark.sql import functions as F

from curbside.catalog.registry import query
from curbside.catalog.sql import MENU, r4, r6, unit
from curbside.functions.menu import MULTI_PLATFORM_FARE_CAP, reward_per_taxi, reward_share
from curbside.functions.numeric import r4 as round4, r6 as round6
from curbside.operators import learning, planning, replay, sampling
from curbside.sources.staging import stage

ALPHA, DISCOUNT, ETA, GAMMA = 0.2, 0.95, 0.1, 0.1
SHARE_NORMALIZER = 50.0


@query(
    "i9_scaled_rewards",
    f"""SELECT step, {r6('r')} AS per_taxi,
        {r6('CASE WHEN n_taxis > 0 THEN greatest(0.0, least(1.0, reward / n_taxis / 270.0)) ELSE 0.0 END')} AS per_taxi_rivals,
        {r6('greatest(0.0, least(1.0, reward / 50000.0))')} AS share FROM scaled""",
)
def scaled_rewards(t):
    return t.decisions.select(
        "step",
        round6(reward_per_taxi()).alias("per_taxi"),
        round6(reward_per_taxi(cap=MULTI_PLATFORM_FARE_CAP)).alias("per_taxi_rivals"),
        round6(reward_share()).alias("share"),
    )


@query("l2_exp3_weights", f"SELECT arm, action, {r4('log_w')} AS log_w FROM weights")
def exp3_weights(t):
    return _weights(t).select("arm", "action", round4("log_w").alias("log_w"))


def _weights(t):
    return learning.exp3_weights(t.decisions, reward_per_taxi(), ETA)


PROBS = """(SELECT arm, action, 0.9 * e / sum(e) OVER (PARTITION BY arm) + 0.1 / 5 AS prob FROM (
              SELECT *, exp(log_w - max(log_w) OVER (PARTITION BY arm)) AS e FROM weights))"""


@query("l3_exp3_probs", f"SELECT arm, action, {r6('prob')} AS prob FROM {PROBS}")
def exp3_probs(t):
    return learning.exp3_probs(_weights(t), GAMMA).select("arm", "action", round6("prob").alias("prob"))


STABLE = """(SELECT arm, action, p / sum(p) OVER (PARTITION BY arm) AS prob FROM (
               SELECT arm, action, greatest(0.9 * e / greatest(sum(e) OVER (PARTITION BY arm), 1e-12) + 0.1 / 5, 1e-12) AS p FROM (
                 SELECT *, exp(greatest(log_w - max(log_w) OVER (PARTITION BY arm), -50.0)) AS e FROM weights)))"""


@query("l5_exp3_stable_probs", f"SELECT arm, action, {r6('prob')} AS prob FROM {STABLE}")
def exp3_stable_probs(t):
    return learning.exp3_stable_probs(_weights(t), GAMMA).select("arm", "action", round6("prob").alias("prob"))


@query(
    "l6_expected_multipliers",
    f"SELECT arm, {r6(f'sum(prob * list_extract({MENU}, CAST(action + 1 AS INT)))')} AS multiplier FROM {STABLE} GROUP BY 1",
)
def expected_multipliers(t):
    out = learning.expected_multipliers(learning.exp3_stable_probs(_weights(t), GAMMA))
    return out.select("arm", round6("multiplier").alias("multiplier"))


FIRM_WEIGHTS = """(SELECT a.firm_id, a.zone, CAST(b.range AS INT) AS action, 0.1 * coalesce(sum(
        CASE WHEN s.n_taxis > 0 THEN greatest(0.0, least(1.0, s.reward / s.n_taxis / 270.0)) ELSE 0.0 END / s.prob), 0) AS log_w
      FROM (SELECT DISTINCT firm_id, zone FROM firm_log) a CROSS JOIN range(5) b
      LEFT JOIN (SELECT * FROM firm_log WHERE {where}) s ON s.firm_id = a.firm_id AND s.zone = a.zone AND s.action = b.range
      GROUP BY 1, 2, 3)"""


def _firm_decisions(t):
    log = t.firm_log.withColumnsRenamed({"firm_id": "agent", "zone": "arm", "iteration": "episode"})
    return log.withColumn("run", F.lit("log"))


@query(
    "l16_frozen_policy",
    f"""SELECT p.scenario, p.platform, p.zone, p.day, p.hour,
          CASE WHEN p.platform = 1 THEN p.multiplier ELSE {r6('coalesce(e.multiplier, p.multiplier)')} END AS multiplier
        FROM policy p LEFT JOIN (
          SELECT firm_id, zone, sum(prob * list_extract({MENU}, CAST(action + 1 AS INT))) AS multiplier FROM (
            SELECT *, p / sum(p) OVER (PARTITION BY firm_id, zone) AS prob FROM (
              SELECT *, greatest(0.9 * e / sum(e) OVER (PARTITION BY firm_id, zone) + 0.1 / 5, 1e-12) AS p FROM (
                SELECT *, exp(greatest(log_w - max(log_w) OVER (PARTITION BY firm_id, zone), -50.0)) AS e
                FROM {FIRM_WEIGHTS.format(where='TRUE')}))) GROUP BY 1, 2) e
          ON e.firm_id = p.platform AND e.zone = p.zone""",
)
def frozen_policy(t):
    weights = learning.exp3_weights(_firm_decisions(t), reward_per_taxi(cap=MULTI_PLATFORM_FARE_CAP), ETA)
    expected = learning.expected_multipliers(learning.exp3_stable_probs(weights, GAMMA)).select(
        F.col("agent").alias("platform"), F.col("arm").alias("zone"), round6("multiplier").alias("multiplier")
    )
    return learning.frozen_policy(t.policy, expected, deviator=1)


@query(
    "l16_weights_after_reset",
    f"SELECT firm_id, zone, action, {r4('log_w')} AS log_w FROM {FIRM_WEIGHTS.format(where='firm_id = 1 OR iteration >= 20')} "
    "WHERE (firm_id, zone) IN (SELECT (firm_id, zone) FROM firm_log WHERE firm_id = 1 OR iteration >= 20)",
)
def weights_after_reset(t):
    log = learning.forget_frozen(_firm_decisions(t), deviator=1, unfreeze=20)
    weights = learning.exp3_weights(log, reward_per_taxi(cap=MULTI_PLATFORM_FARE_CAP), ETA)
    return weights.select(
        F.col("agent").alias("firm_id"), F.col("arm").alias("zone"), "action", round4("log_w").alias("log_w")
    )


# --- ordered replays: the SQL follows each arm's log with a recursive query -------------------

STEPS = """steps AS (SELECT arm, row_number() OVER (PARTITION BY arm ORDER BY episode, step) AS i,
             episode, state AS s, action AS a, next_state AS ns, r, reward,
             lead(action) OVER (PARTITION BY arm, episode ORDER BY step) AS na,
             {coin} AS coin FROM scaled)"""
START = "SELECT arm, 0 AS i, list_transform(range({width}), lambda k: 0.0::DOUBLE) AS q FROM decisions GROUP BY arm"
LAST = "(SELECT arm, max_by(q, i) AS q FROM walk GROUP BY arm)"


def _walk(update: str, width: int, index: str = "s * 5 + a", coin: str = "FALSE") -> str:
    return f"""WITH RECURSIVE {STEPS.format(coin=coin)},
      walk AS ({START.format(width=width)}
        UNION ALL
        SELECT w.arm, w.i + 1, list_transform(range({width}), lambda k: CASE WHEN k = {index}
            THEN w.q[k + 1] + {ALPHA} * (r + {DISCOUNT} * ({update}) - w.q[k + 1]) ELSE w.q[k + 1] END)
        FROM walk w JOIN steps d ON d.arm = w.arm AND d.i = w.i + 1)"""


TABLE = f"SELECT arm, CAST(k.range // 5 AS INT) AS state, CAST(k.range % 5 AS INT) AS action, {r6('q[k.range + 1]')} AS q FROM {LAST} CROSS JOIN range(50) k"


@query(
    "l7_q_replay",
    _walk("CASE WHEN ns IS NULL THEN 0.0 ELSE list_max(w.q[ns * 5 + 1 : ns * 5 + 5]) END", 50) + " " + TABLE,
)
def q_replay(t):
    return _q(t).select("arm", "state", "action", round6("q").alias("q"))


EPISODE_ENDS = "(SELECT arm, episode, max(i) AS i FROM steps GROUP BY 1, 2)"


@query(
    "n2_episode_values",
    _walk("CASE WHEN ns IS NULL THEN 0.0 ELSE list_max(w.q[ns * 5 + 1 : ns * 5 + 5]) END", 50)
    + f""" SELECT 'log' AS run, 0 AS agent, arm, CAST(episode AS BIGINT) AS episode, CAST(k.range // 5 AS INT) AS state,
        CAST(k.range % 5 AS INT) AS action, {r6('q[k.range + 1]')} AS q
      FROM walk JOIN {EPISODE_ENDS} USING (arm, i) CROSS JOIN range(50) k""",
)
def episode_values(t):
    """The table of values that each agent has learned by the end of each of its episodes."""
    return replay.episode_values(t.decisions, reward_per_taxi(), ALPHA, DISCOUNT).withColumn("q", round6("q"))


def _q(t):
    return replay.q_replay(t.decisions, reward_per_taxi(), ALPHA, DISCOUNT)


@query(
    "l8_sarsa_replay",
    _walk("CASE WHEN ns IS NULL OR na IS NULL THEN 0.0 ELSE w.q[ns * 5 + na + 1] END", 50) + " " + TABLE,
)
def sarsa_replay(t):
    out = replay.sarsa_replay(t.decisions, reward_per_taxi(), ALPHA, DISCOUNT)
    return out.select("arm", "state", "action", round6("q").alias("q"))


HEADS = unit("concat_ws(':', run, agent, arm, episode, step)") + " < 0.5"


@query(
    "l9_double_q_replay",
    _walk(
        "CASE WHEN ns IS NULL THEN 0.0 WHEN coin THEN w.q[50 + ns * 5 + list_position(w.q[ns * 5 + 1 : ns * 5 + 5], "
        "list_max(w.q[ns * 5 + 1 : ns * 5 + 5]))] ELSE w.q[ns * 5 + list_position(w.q[50 + ns * 5 + 1 : 50 + ns * 5 + 5], "
        "list_max(w.q[50 + ns * 5 + 1 : 50 + ns * 5 + 5]))] END",
        100,
        index="s * 5 + a + CASE WHEN coin THEN 0 ELSE 50 END",
        coin=HEADS,
    )
    + f" SELECT arm, CAST(k.range // 5 AS INT) AS state, CAST(k.range % 5 AS INT) AS action, {r6('q[k.range + 1]')} AS q1, "
    f"{r6('q[k.range + 51]')} AS q2 FROM {LAST} CROSS JOIN range(50) k",
)
def double_q_replay(t):
    out = replay.double_q_replay(t.decisions, reward_per_taxi(), ALPHA, DISCOUNT)
    return out.select("arm", "state", "action", round6("q1").alias("q1"), round6("q2").alias("q2"))


#: The clipped weights of each arm after its last row of `steps`.
CLIPPED_WALK = f"""walk AS ({START.format(width=5)}
        UNION ALL
        SELECT arm, i, list_transform(q, lambda x: greatest(least(x - list_max(q), 0.0), -50.0)) FROM (
          SELECT arm, i, list_transform(range(5), lambda k: w[k + 1] + CASE WHEN k = a THEN
              {ETA} * least(greatest(least(reward / {SHARE_NORMALIZER}, 1.0), 0.0) / greatest(p[a + 1] / list_sum(p), 1e-12), 50.0) ELSE 0.0 END) AS q
          FROM (SELECT arm, i, w, a, reward, list_transform(e, lambda x: greatest(0.9 * x / greatest(list_sum(e), 1e-12) + 0.1 / 5, 1e-12)) AS p
            FROM (SELECT w.arm, w.i + 1 AS i, w.q AS w, d.a, d.reward,
                    list_transform(w.q, lambda x: exp(greatest(x - list_max(w.q), -50.0))) AS e
                  FROM walk w JOIN steps d ON d.arm = w.arm AND d.i = w.i + 1))))
      SELECT arm, CAST(k.range AS INT) AS action, {r6('q[k.range + 1]')} AS log_w FROM {LAST} CROSS JOIN range(5) k"""


@query("l4_exp3_stable", f"WITH RECURSIVE {STEPS.format(coin='FALSE')}, {CLIPPED_WALK}")
def exp3_stable(t):
    out = replay.exp3_stable(t.decisions, reward_share(normalizer=SHARE_NORMALIZER), ETA, GAMMA)
    return out.select("arm", "action", round6("log_w").alias("log_w"))


@query(
    "l1_policy_probs",
    _walk("CASE WHEN ns IS NULL THEN 0.0 ELSE list_max(w.q[ns * 5 + 1 : ns * 5 + 5]) END", 50)
    + f""", cells AS (SELECT arm, k.range // 5 AS state, k.range % 5 AS action, q[k.range + 1] AS q FROM {LAST} CROSS JOIN range(50) k)
      SELECT arm, CAST(state AS INT) AS state, CAST(action AS INT) AS action,
        {r6("0.1 / 5 + CASE WHEN row_number() OVER (PARTITION BY arm, state ORDER BY q DESC, action) = 1 THEN 0.9 ELSE 0.0 END")} AS epsilon_greedy,
        {r6("exp((q - max(q) OVER (PARTITION BY arm, state)) / 0.5) / sum(exp(q / 0.5)) OVER (PARTITION BY arm, state) * exp(max(q) OVER (PARTITION BY arm, state) / 0.5)")} AS softmax,
        CAST(row_number() OVER (PARTITION BY arm, state ORDER BY q DESC, action) = 1 AS DOUBLE) AS greedy,
        CAST(0.2 AS DOUBLE) AS random FROM cells""",
)
def policy_probs(t):
    q = _q(t)
    out = learning.policy_probs(q, "epsilon_greedy", eps=0.1).withColumnRenamed("prob", "epsilon_greedy")
    out = learning.policy_probs(out, "softmax", temperature=0.5).withColumnRenamed("prob", "softmax")
    out = learning.policy_probs(out, "greedy").withColumnRenamed("prob", "greedy")
    out = learning.policy_probs(out, "random").withColumnRenamed("prob", "random")
    return out.select(
        "arm", "state", "action", *[round6(c).alias(c) for c in ("epsilon_greedy", "softmax", "greedy", "random")]
    )


# --- models -----------------------------------------------------------------------------------


@query(
    "l11_transitions",
    f"""SELECT arm, action, state AS s, next_state AS s_next,
        {r6('CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY arm, action, state)')} AS p
        FROM decisions WHERE next_state IS NOT NULL GROUP BY 1, 2, 3, 4""",
)
def transitions(t):
    return planning.estimate_transitions(t.decisions).select("arm", "action", "s", "s_next", round6("p").alias("p"))


@query("l11_mean_rewards", f"SELECT arm, state AS s, action, {r6('avg(r)')} AS r FROM scaled GROUP BY 1, 2, 3")
def mean_rewards(t):
    return planning.mean_rewards(t.decisions, reward_per_taxi()).select("arm", "s", "action", round6("r").alias("r"))


@query(
    "l10_fitted_q",
    f"""WITH RECURSIVE walk AS (
        SELECT arm, 0 AS i, list_transform(range(50), lambda k: 0.0::DOUBLE) AS q FROM decisions GROUP BY arm
        UNION ALL
        SELECT arm, i, list_transform(range(50), lambda k: coalesce(m[CAST(k AS INT)], 0.0)) FROM (
          SELECT arm, i, map(list(c), list(v)) AS m FROM (
            SELECT w.arm, w.i + 1 AS i, CAST(s.state * 5 + s.action AS INT) AS c,
              avg(s.r + {DISCOUNT} * CASE WHEN s.next_state IS NULL THEN 0.0 ELSE list_max(w.q[s.next_state * 5 + 1 : s.next_state * 5 + 5]) END) AS v
            FROM walk w JOIN scaled s ON s.arm = w.arm WHERE w.i < 100 GROUP BY 1, 2, 3) GROUP BY 1, 2))
      {TABLE}""",
)
def fitted_q(t):
    out = planning.fitted_q(t.decisions, reward_per_taxi(), DISCOUNT, iterations=100)
    return out.select("arm", "state", "action", round6("q").alias("q"))


def _model(t):
    log = t.two_action_log
    return planning.pack_model(
        planning.estimate_transitions(log), planning.mean_rewards(log, F.col("reward")), n_actions=2
    )


MODEL = """moves AS (SELECT arm, state AS s, action AS a, next_state AS ns,
               CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY arm, action, state) AS p
             FROM two_action WHERE next_state IS NOT NULL GROUP BY 1, 2, 3, 4),
      gains AS (SELECT arm, state AS s, action AS a, avg(reward) AS r FROM two_action GROUP BY 1, 2, 3),
      cells AS (SELECT a.arm, CAST(k.range // 2 AS INT) AS s, CAST(k.range % 2 AS INT) AS a, k.range AS k, coalesce(g.r, 0.0) AS r,
                  coalesce(m.p, list_transform(range(10), lambda x: 0.0::DOUBLE)) AS p
                FROM (SELECT DISTINCT arm FROM decisions) a CROSS JOIN range(20) k
                LEFT JOIN gains g ON g.arm = a.arm AND g.s = k.range // 2 AND g.a = k.range % 2
                LEFT JOIN (SELECT f.arm, f.s, f.a, list(coalesce(v.p, 0.0) ORDER BY f.ns) AS p
                           FROM (SELECT DISTINCT arm, s, a, n.range AS ns FROM moves CROSS JOIN range(10) n) f
                           LEFT JOIN moves v ON v.arm = f.arm AND v.s = f.s AND v.a = f.a AND v.ns = f.ns GROUP BY 1, 2, 3) m
                  ON m.arm = a.arm AND m.s = k.range // 2 AND m.a = k.range % 2),
      packed AS (SELECT arm, list(r ORDER BY k) AS r, list(p ORDER BY k) AS p FROM cells GROUP BY 1)"""
SUBSIDY = 0.5


@query(
    "l12_value_iteration",
    f"""WITH RECURSIVE {MODEL},
      walk AS (SELECT arm, 0 AS i, list_transform(range(20), lambda k: 0.0::DOUBLE) AS q, 1.0::DOUBLE AS change FROM packed
        UNION ALL
        SELECT arm, i, new_q, list_max(list_transform(range(20), lambda k: abs(new_q[k + 1] - q[k + 1]))) FROM (
          SELECT arm, i, q, list_transform(range(20), lambda k: r[k + 1] + CASE WHEN k % 2 = 0 THEN {SUBSIDY} ELSE 0.0 END
              + {DISCOUNT} * list_sum(list_transform(range(10), lambda n: p[k + 1][n + 1] * v[n + 1]))) AS new_q
          FROM (SELECT w.arm, w.i + 1 AS i, w.q, m.r, m.p,
                  list_transform(range(10), lambda n: greatest(w.q[2 * n + 1], w.q[2 * n + 2])) AS v
                FROM walk w JOIN packed m USING (arm) WHERE w.change >= 1e-10 AND w.i < 10000)))
      SELECT arm, CAST(k.range // 2 AS INT) AS state, CAST(k.range % 2 AS INT) AS action, {r6('q[k.range + 1]')} AS q
      FROM {LAST} CROSS JOIN range(20) k""",
)
def value_iteration(t):
    out = planning.value_iteration(_model(t), DISCOUNT, SUBSIDY)
    return out.select("arm", "state", "action", round6("q").alias("q"))


@query("l13_whittle_indices")
def whittle_indices(t):
    return planning.whittle_indices(_model(t), DISCOUNT).select("arm", "state", round4("index").alias("index"))


@query(
    "l13_index_invariants",
    "SELECT arm, CAST(s.range AS INT) AS state, TRUE AS in_balance FROM (SELECT DISTINCT arm FROM decisions) CROSS JOIN range(10) s",
)
def index_invariants(t):
    """Whether at each index both actions are equally good, or the index stands at an end of the range it is looked for in."""
    model = stage(_model(t), "index-model")
    found = stage(planning.whittle_indices(model, DISCOUNT), "indices")
    gaps = planning.index_gaps(model, found, DISCOUNT)
    edge = F.abs(F.abs("index") - 100.0) < 1e-6
    return gaps.select("arm", F.col("state").cast("int").alias("state"), ((F.abs("gap") < 1e-6) | edge).alias("in_balance"))


@query(
    "l14_priority_scores",
    _walk("CASE WHEN ns IS NULL THEN 0.0 ELSE list_max(w.q[ns * 5 + 1 : ns * 5 + 5]) END", 50)
    + f""", scored AS (SELECT v.arm, v.state, v.q[v.state * 5 + 2] - v.q[v.state * 5 + 1] AS score
        FROM (SELECT arm, q, (SELECT max_by(s, i) FROM steps d WHERE d.arm = l.arm) AS state FROM {LAST} l) v)
      SELECT arm, state, {r6('score')} AS score,
        CAST(row_number() OVER (ORDER BY {r6('score')} DESC, arm) <= 20 AS INT) AS active FROM scored""",
)
def priority_scores(t):
    scores = planning.priority_scores(_q(t), planning.current_states(t.decisions))
    scores = scores.withColumn("score", round6("score"))
    return sampling.activate_top(scores, 20, ["run", "agent"]).select("arm", "state", "score", "active")


# the recursion walks the log once per outer round; the step after the last moves the index
WHITTLE = f"""WITH RECURSIVE wsteps AS (SELECT arm, row_number() OVER (PARTITION BY arm ORDER BY episode, step) AS i,
        count(*) OVER (PARTITION BY arm) AS n, state AS s, action AS a, next_state AS ns, reward FROM two_action),
      walk AS (SELECT arm, CAST(th.range AS INT) AS th, 0 AS round, 0 AS i, n,
          list_transform(range(20), lambda k: 0.0::DOUBLE) AS q, 0.0::DOUBLE AS idx, 0.0::DOUBLE AS gap
        FROM (SELECT DISTINCT arm, n FROM wsteps) CROSS JOIN range(10) th
        UNION ALL
        SELECT w.arm, w.th, CASE WHEN w.i = w.n THEN w.round + 1 ELSE w.round END,
          CASE WHEN w.i = w.n THEN 0 ELSE w.i + 1 END, w.n,
          CASE WHEN w.i = w.n THEN w.q ELSE list_transform(range(20), lambda k: CASE WHEN k = d.s * 2 + d.a
              THEN w.q[k + 1] + 0.05 * (d.reward + CASE WHEN d.a = 0 THEN w.idx ELSE 0.0 END
                + 0.95 * CASE WHEN d.ns IS NULL THEN 0.0 ELSE list_max(w.q[d.ns * 2 + 1 : d.ns * 2 + 2]) END - w.q[k + 1])
              ELSE w.q[k + 1] END) END,
          CASE WHEN w.i = w.n THEN w.idx + 0.01 * (w.q[w.th * 2 + 2] - w.q[w.th * 2 + 1]) ELSE w.idx END,
          CASE WHEN w.i = w.n THEN abs(w.q[w.th * 2 + 2] - w.q[w.th * 2 + 1]) ELSE w.gap END
        FROM walk w LEFT JOIN wsteps d ON d.arm = w.arm AND d.i = w.i + 1 WHERE w.round < 3)
      SELECT arm, th AS state, {r4('idx')} AS "index", {r4('gap')} AS gap, 3 AS rounds FROM walk WHERE round = 3"""


@query("l15_whittle_learning", WHITTLE)
def whittle_learning(t):
    out = replay.whittle_learning(t.two_action_log, F.col("reward"), outer=3)
    return out.select("arm", "state", round4("index").alias("index"), round4("gap").alias("gap"), "rounds")


@query("l15_whittle_learned")
def whittle_learned(t):
    """All 500 rounds; the SQL of `l15_whittle_learning` has the first 3."""
    out = replay.whittle_learning(t.two_action_log, F.col("reward"))
    return out.select("arm", "state", round4("index").alias("index"), round4("gap").alias("gap"), "rounds", "converged")
