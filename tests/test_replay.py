import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from curbside.operators import learning, planning, replay, reports
from curbside.sources.staging import stage

S, A = 4, 3
SCHEMA = "run string, agent int, arm int, episode int, step bigint, state int, action int, prob double, reward double, next_state int"


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(5)
    rows = []
    for arm, episodes in ((0, 12), (1, 2), (2, 1)):  # arm 0 holds most of the log
        for ep in range(episodes):
            state = rng.randrange(S)
            for step in range(20):
                nxt = None if step == 19 and ep == episodes - 1 else rng.randrange(S)
                rows.append(("r", 0, arm, ep, step, state, rng.randrange(A), 0.2 + 0.1 * rng.random(), rng.random(), nxt))
                state = nxt if nxt is not None else 0
    shuffled = rows[:]
    rng.shuffle(shuffled)
    return spark.createDataFrame(shuffled, SCHEMA), rows


def arms(rows):
    return {a: [r for r in rows if r[2] == a] for a in {r[2] for r in rows}}


def table(df, *cols):
    return {(r.arm, r.state, r.action): tuple(r[c] for c in cols) for r in df.collect()}


def in_order_q(rows, alpha, discount, on_policy=False):
    q = np.zeros((S, A))
    for i, r in enumerate(rows):
        s, a, reward, ns = r[5], r[6], r[8], r[9]
        if ns is None:
            future = 0.0
        elif on_policy:
            future = q[ns, rows[i + 1][6]] if i + 1 < len(rows) and rows[i + 1][3] == r[3] else 0.0  # same episode
        else:
            future = q[ns].max()
        q[s, a] += alpha * (reward + discount * future - q[s, a])
    return q


@pytest.mark.parametrize("size", [7, 32, 100000])
def test_chunks_are_bounded_and_ordered(log, size):
    df, rows = log
    got = replay.with_chunks(df, size)
    assert got.groupBy("arm", "chunk").count().agg(F.max("count")).first()[0] < 2 * size
    order = {}
    for r in got.collect():
        order.setdefault(r.arm, []).append((r.episode, r.step, r.chunk))
    for items in order.values():
        chunks = [c for _, _, c in sorted(items)]
        assert chunks == sorted(chunks) and set(chunks) == set(range(max(chunks) + 1))


@pytest.mark.parametrize("size", [40, 100000])
def test_q_replay_is_exact_for_any_chunk_size(log, size):
    df, rows = log
    got = table(replay.q_replay(df, F.col("reward"), 0.3, 0.9, S, A, size), "q")
    for arm, mine in arms(rows).items():
        want = in_order_q(mine, 0.3, 0.9)
        assert all(got[arm, s, a][0] == want[s, a] for s in range(S) for a in range(A))


@pytest.mark.parametrize("size", [40, 100000])
def test_sarsa_replay_is_exact_for_any_chunk_size(log, size):
    df, rows = log
    got = table(replay.sarsa_replay(df, F.col("reward"), 0.3, 0.9, S, A, size), "q")
    for arm, mine in arms(rows).items():
        want = in_order_q(mine, 0.3, 0.9, on_policy=True)
        assert all(got[arm, s, a][0] == want[s, a] for s in range(S) for a in range(A))


def test_double_q_does_not_depend_on_chunk_size(log):
    df, _ = log
    one = table(replay.double_q_replay(df, F.col("reward"), 0.3, 0.9, S, A), "q1", "q2")
    many = table(replay.double_q_replay(df, F.col("reward"), 0.3, 0.9, S, A, size=40), "q1", "q2")
    assert one == many and any(q1 != q2 for q1, q2 in one.values())


def test_clipped_exp3_is_exact_for_any_chunk_size(log):
    df, rows = log

    def in_order(mine, eta=0.5, gamma=0.1):
        w = np.zeros(A)
        for r in mine:
            e = np.exp(np.clip(w - w.max(), -50, 0))
            p = np.maximum((1 - gamma) * e / max(e.sum(), 1e-12) + gamma / A, 1e-12)
            p = p / p.sum()
            w[r[6]] += eta * min(max(r[8] / max(p[r[6]], 1e-12), 0), 50)
            w = np.clip(w - w.max(), -50, 0)
        return w

    for size in (40, 100000):
        got = {(r.arm, r.action): r.log_w for r in replay.exp3_stable(df, F.col("reward"), 0.5, 0.1, A, size).collect()}
        for arm, mine in arms(rows).items():
            assert np.allclose([got[arm, a] for a in range(A)], in_order(mine), atol=1e-12)


def test_grouped_exp3_equals_the_ordered_update(log):
    df, rows = log
    got = {(r.arm, r.action): r.log_w for r in learning.exp3_weights(df, "reward", 0.1, A).collect()}
    for arm, mine in arms(rows).items():
        want = np.zeros(A)
        for r in mine:
            want[r[6]] += 0.1 * r[8] / r[7]
        assert np.allclose([got[arm, a] for a in range(A)], want)
    probs = learning.exp3_probs(learning.exp3_weights(df, "reward", 0.1, A))
    assert all(math.isclose(r[0], 1.0) for r in probs.groupBy("arm").agg(F.sum("prob")).select("sum(prob)").collect())


def test_policy_probs_ties_and_errors(spark):
    q = spark.createDataFrame([("r", 0, 0, 0, a, v) for a, v in enumerate((1.0, 3.0, 3.0))], "run string, agent int, arm int, state int, action int, q double")

    def probs(*args, **kw):
        return [r.prob for r in learning.policy_probs(q, *args, **kw).orderBy("action").collect()]

    assert probs("greedy") == [0.0, 1.0, 0.0]
    assert np.allclose(probs("epsilon_greedy", eps=0.3), [0.1, 0.8, 0.1])
    e = np.exp((np.array([1.0, 3.0, 3.0]) - 3.0) / 2.0)
    assert np.allclose(probs("softmax", temperature=2.0), e / e.sum())
    assert np.allclose(probs("random"), [1 / 3] * 3)
    with pytest.raises(ValueError, match="temperature above 0"):
        learning.policy_probs(q, "softmax", temperature=0)
    with pytest.raises(ValueError, match="no policy ucb"):
        learning.policy_probs(q, "ucb")


def test_frozen_policy_and_reset(spark):
    policy = spark.createDataFrame([("a", k, 1, 0, 0, 1.0) for k in range(4)], "scenario string, platform int, zone int, day int, hour int, multiplier double")
    held = spark.createDataFrame([(k, 1, 1.7) for k in range(3)], "platform int, zone int, multiplier double")
    got = {r.platform: r.multiplier for r in learning.frozen_policy(policy, held, deviator=0).collect()}
    assert got == {0: 1.0, 1: 1.7, 2: 1.7, 3: 1.0}
    log = spark.createDataFrame([(k, e) for k in range(2) for e in range(4)], "agent int, episode int")
    assert learning.forget_frozen(log, deviator=0, unfreeze=3).count() == 5


# --- models ---------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model(spark):
    rng = np.random.default_rng(11)
    moves, gains, raw = [], [], {}
    for arm in range(6):
        p = rng.dirichlet(np.ones(S), size=(2, S))
        r = rng.normal(size=(S, 2))
        raw[arm] = (p, r)
        moves += [("r", 0, arm, a, s, n, float(p[a, s, n])) for a in range(2) for s in range(S) for n in range(S)]
        gains += [("r", 0, arm, s, a, float(r[s, a])) for s in range(S) for a in range(2)]
    transitions = spark.createDataFrame(moves, "run string, agent int, arm int, action int, s int, s_next int, p double")
    rewards = spark.createDataFrame(gains, "run string, agent int, arm int, s int, action int, r double")
    return planning.pack_model(transitions, rewards, S, 2), raw


def solve(p, r, discount, subsidy, tol):
    q = np.zeros((S, 2))
    for _ in range(10000):
        v = q.max(axis=1)
        new = np.stack([r[:, 0] + subsidy + discount * p[0] @ v, r[:, 1] + discount * p[1] @ v], axis=1)
        change = np.abs(new - q).max()
        q = new
        if change < tol:
            break
    return q


def test_value_iteration_matches_brute_force(model):
    packed, raw = model
    got = table(planning.value_iteration(packed, 0.9, 0.3, n_states=S), "q")
    for arm, (p, r) in raw.items():
        want = solve(p, r, 0.9, 0.3, 1e-10)
        assert np.allclose([[got[arm, s, a][0] for a in range(2)] for s in range(S)], want, atol=1e-9)


def test_whittle_indices_match_bisection_on_value_iteration(model):
    packed, raw = model
    got = {(r.arm, r.state): r["index"] for r in planning.whittle_indices(packed, 0.9, n_states=S).collect()}
    for arm, (p, r) in raw.items():
        for s in range(S):
            lo, hi = -100.0, 100.0
            for _ in range(60):
                mid = 0.5 * (lo + hi)
                q = solve(p, r, 0.9, mid, 1e-9)
                lo, hi = (mid, hi) if q[s, 1] - q[s, 0] > 0 else (lo, mid)
            assert abs(got[arm, s] - 0.5 * (lo + hi)) < 1e-5


def test_fitted_q_matches_the_mean_over_the_log(log):
    df, rows = log
    got = table(planning.fitted_q(df, F.col("reward"), 0.9, 15, S, A), "q")
    for arm, mine in arms(rows).items():
        q = np.zeros((S, A))
        for _ in range(15):
            new = np.zeros((S, A))
            for s in range(S):
                for a in range(A):
                    hits = [r for r in mine if r[5] == s and r[6] == a]
                    if hits:
                        new[s, a] = np.mean([r[8] + (0.9 * q[r[9]].max() if r[9] is not None else 0.0) for r in hits])
            q = new
        assert np.allclose([[got[arm, s, a][0] for a in range(A)] for s in range(S)], q)


def test_indices_of_an_arm_whose_actions_tie_but_for_rounding(spark):
    """On the way to its indices a policy of this arm goes back and forth between actions that differ by rounding alone."""
    moves = [(0, 0, 0, 8), (0, 0, 1, 4), (0, 1, 0, 12), (1, 0, 1, 12), (1, 1, 1, 12)]
    transitions = spark.createDataFrame([("r", 0, 7, a, s, n, p / 12) for s, a, n, p in moves], "run string, agent int, arm int, action int, s int, s_next int, p double")
    gains = [(0, 0, 362.2), (0, 1, 492.49), (1, 0, 528.39), (1, 1, 100.9)]
    rewards = spark.createDataFrame([("r", 0, 7, s, a, r) for s, a, r in gains], "run string, agent int, arm int, s int, action int, r double")
    packed = stage(planning.pack_model(transitions, rewards, 2, 2))
    found = stage(planning.whittle_indices(packed, n_states=2))
    gaps = planning.index_gaps(packed, found, n_states=2).collect()
    assert len(gaps) == 2 and all(abs(r.gap) < 1e-6 or abs(abs(r["index"]) - 100.0) < 1e-6 for r in gaps)


def test_many_models_at_once_and_one_by_one_have_the_same_values():
    rng = np.random.default_rng(3)
    n = planning.MODELS + 5
    move = rng.dirichlet(np.ones(S), (n, S, 2))
    gain, subsidy = rng.uniform(0, 100, (n, S, 2)), rng.uniform(-100, 100, (n, 3))
    one = [planning._policy_values(move[k : k + 1], gain[k : k + 1], subsidy[k : k + 1], 0.95)[0] for k in range(n)]
    together = planning._policy_values(move, gain, subsidy, 0.95)
    assert np.array_equal(together, np.stack(one))
    settled = planning._solve_two_actions(move, gain, subsidy, 0.95, 1e-11, 10000)
    assert np.allclose(together, settled, atol=1e-8)


@pytest.mark.parametrize("size", [120, 100000])
def test_whittle_learning_matches_a_plain_loop(log, size):
    df, rows = log
    two = df.withColumn("action", (F.col("action") >= 1).cast("int"))
    got = {(r.arm, r.state): (r["index"], r.gap, r.rounds) for r in replay.whittle_learning(
        two, F.col("reward"), outer=2, alpha=0.2, eta=0.5, discount=0.8, n_states=S, size=size).collect()}
    for arm, mine in arms(rows).items():
        for th in range(S):
            q, index = np.zeros((S, 2)), 0.0
            for _ in range(2):
                for r in mine:
                    s, a, reward, ns = r[5], int(r[6] >= 1), r[8], r[9]
                    future = q[ns].max() if ns is not None else 0.0
                    q[s, a] += 0.2 * (reward + (index if a == 0 else 0.0) + 0.8 * future - q[s, a])
                gap = q[th, 1] - q[th, 0]
                index += 0.5 * gap
            assert np.allclose(got[arm, th][:2], (index, abs(gap))) and got[arm, th][2] == 2


@pytest.mark.parametrize("size", [120, 100000])
def test_whittle_learning_says_which_arms_converged(log, size):
    df, rows = log
    two = df.withColumn("action", (F.col("action") >= 1).cast("int"))
    rounds, tolerance = 6, 0.1
    got = {(r.arm, r.state): r for r in replay.whittle_learning(
        two, F.col("reward"), outer=rounds, alpha=0.2, eta=0.5, discount=0.8, tolerance=tolerance, n_states=S, size=size).collect()}
    assert len(got) == S * len(arms(rows))
    for arm, mine in arms(rows).items():
        q, index = np.zeros((S, S, 2)), np.zeros(S)  # by threshold
        for done in range(1, rounds + 1):
            for th in range(S):
                for r in mine:
                    s, a, reward, ns = r[5], int(r[6] >= 1), r[8], r[9]
                    future = q[th, ns].max() if ns is not None else 0.0
                    q[th, s, a] += 0.2 * (reward + (index[th] if a == 0 else 0.0) + 0.8 * future - q[th, s, a])
            gap = np.array([q[th, th, 1] - q[th, th, 0] for th in range(S)])
            index = index + 0.5 * gap
            if np.abs(gap).max() < tolerance:
                break
        for th in range(S):
            r = got[arm, th]
            assert np.allclose((r["index"], r.gap), (index[th], abs(gap[th])))
            assert r.rounds == done and r.converged == (np.abs(gap).max() < tolerance)


def test_the_learned_indices_are_not_cut_to_the_rounds_of_the_sql(spark):
    import __spark_entry__ as entry

    rows = entry.queries()["l15_whittle_learned"](spark, "/root/testdata/sf0.001").collect()
    assert rows and all(r.converged or r.rounds == 500 for r in rows) and max(r.rounds for r in rows) > 3


def test_priority_scores(spark):
    q = spark.createDataFrame([("r", 0, 1, s, a, float(10 * s + a * 3)) for s in range(2) for a in range(2)], "run string, agent int, arm int, state int, action int, q double")
    states = spark.createDataFrame([("r", 0, 1, 1)], "run string, agent int, arm int, state int")
    assert [r.score for r in planning.priority_scores(q, states).collect()] == [3.0]


def test_values_at_the_end_of_each_episode(spark):
    """Episodes that end inside chunks, on their bounds, and go on over several of them."""
    rng = random.Random(4)
    rows, step = [], 0
    for arm, lengths in {1: [1, 1, 7, 40, 3], 2: [64], 3: [2] * 30, 4: [1]}.items():
        for episode, n in enumerate(lengths):
            for _ in range(n):
                step += 1
                after = rng.choice([None, *range(4)])
                rows.append(("log", 0, arm, episode * 3, step, rng.randrange(4), rng.randrange(3), after, rng.random()))
    log = spark.createDataFrame(
        rows, "run string, agent int, arm bigint, episode int, step bigint, state int, action int, next_state int, reward double"
    )
    want, values, last = {}, {}, {}
    for r in sorted(rows, key=lambda r: (r[2], r[3], r[4])):
        q = values.setdefault(r[2], [0.0] * 12)
        at = r[5] * 3 + r[6]
        future = max(q[r[7] * 3 : r[7] * 3 + 3]) if r[7] is not None else 0.0
        q[at] += 0.2 * (r[8] + 0.9 * future - q[at])
        want[r[2], r[3]] = q[:]
    for size in (8, 1000):
        got = replay.episode_values(log, F.col("reward"), 0.2, 0.9, 4, 3, size).collect()
        assert {(r.arm, r.episode, r.state * 3 + r.action): r.q for r in got} == {
            (*key, k): v for key, q in want.items() for k, v in enumerate(q)
        }


@pytest.mark.parametrize("column, value", [("action", 5), ("action", -1), ("state", 10), ("next_state", 10), ("action", None)])
def test_what_is_not_in_the_menu_is_an_error(spark, column, value):
    row = {"run": "log", "agent": 0, "arm": 1, "episode": 0, "step": 1, "state": 0, "action": 1, "next_state": 3, "reward": 1.0, "prob": 0.2}
    schema = "run string, agent int, arm int, episode int, step int, state int, action int, next_state int, reward double, prob double"
    log = spark.createDataFrame([tuple((row | {column: value}).values())], schema)
    gain = F.col("reward")
    jobs = [lambda: replay.q_replay(log, gain), lambda: replay.sarsa_replay(log, gain), lambda: replay.double_q_replay(log, gain)]
    if column == "action":
        jobs += [lambda: learning.exp3_weights(log, gain), lambda: replay.exp3_stable(log, gain), lambda: reports.interval_multipliers(log, 10)]
    for job in jobs:
        with pytest.raises(Exception, match="there is no"):
            job().collect()


def test_clipped_weights_read_each_chunk_once(spark):
    """One arm of 40 chunks among short ones: each round's scan is pruned to its chunk, and the result is that of one pass."""
    rng = random.Random(8)
    rows = [("log", 0, arm, 0, s, rng.randrange(5), rng.random()) for arm, n in ((1, 640), (2, 16), (3, 40)) for s in range(n)]
    log = spark.createDataFrame(rows, "run string, agent int, arm int, episode int, step bigint, action int, reward double")
    whole = sorted(map(tuple, replay.exp3_stable(log, F.col("reward"), size=10**6).collect()))
    assert sorted(map(tuple, replay.exp3_stable(log, F.col("reward"), size=16).collect())) == whole
    packed = replay.pack_chunks(log, {"a": F.col("action"), "r": F.col("reward")}, 16)
    chunks = stage(packed, "test-chunks", partition_by="chunk")
    plan = chunks.where("chunk = 7")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(chunk" in plan and "(chunk" in plan
    assert {r.chunk for r in chunks.where("chunk = 39").collect()} == {39}
