import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from curbside.operators import destination as dest, sampling
from curbside.plans import destination_plan as plan


@pytest.fixture(scope="module")
def trips(spark):
    rng = random.Random(2)
    rows = []
    for i in range(1500):
        pu = 10 if rng.random() < 0.4 else rng.choice((3, 7))
        rows.append((i, pu, rng.randrange(7), rng.randrange(24), rng.choice({10: (3, 3, 7, 99), 3: (10, 10, 7), 7: (7, 99)}[pu])))
    return spark.createDataFrame(rows, "id long, PULocationID int, day_of_week int, request_hour int, DOLocationID int")


def test_distribution_sums_to_one_and_covers_every_dropoff(trips):
    counts = dest.destination_counts(trips)
    dist = dest.destination_distribution(counts)
    slots = dist.groupBy(*dest.SLOT).agg(F.sum("p").alias("s"), F.count("*").alias("n"))
    assert slots.where((F.abs(F.col("s") - 1) > 1e-9) | (F.col("n") != 4)).isEmpty()
    assert slots.count() == counts.select(*dest.SLOT).distinct().count()


def test_unmapped_dropoffs_join_the_first_pickup(spark, trips):
    domains = dest.id_domains(trips)
    mapping = dest.dropoff_to_pickup(domains["DOLocationID"], domains["PULocationID"])
    assert dict(mapping.collect()) == {3: 3, 7: 7, 10: 10, 99: 3}
    dropped = dest.dropoff_to_pickup(domains["DOLocationID"], domains["PULocationID"], unmapped="drop")
    assert dict(dropped.collect()) == {3: 3, 7: 7, 10: 10}
    probs = dest.merge_onto_pickups(dest.destination_distribution(dest.destination_counts(trips)), mapping)
    assert probs.groupBy("zone", "day", "hour").agg(F.sum("p").alias("s")).where("abs(s - 1) > 1e-9").isEmpty()
    assert {r.dest for r in probs.select("dest").distinct().collect()} == {3, 7, 10}


def test_ranks_and_argmax_break_ties_low(spark):
    rows = spark.createDataFrame([([0.2, 0.4, 0.4], t) for t in range(3)], "p array<double>, t int")
    assert [r[0] for r in rows.orderBy("t").select(dest.class_rank("p", "t")).collect()] == [3, 1, 2]
    assert rows.select(dest.first_argmax("p")).first()[0] == 1


def test_evaluation_by_counts_equals_evaluation_by_row(spark):
    dist = spark.createDataFrame([(1, 0, 0, d, p) for d, p in ((5, 0.7), (6, 0.2), (7, 0.1))], "PULocationID int, day_of_week int, request_hour int, DOLocationID int, p double")
    counts = spark.createDataFrame([(1, 0, 0, 5, 3), (1, 0, 0, 7, 1), (2, 0, 0, 5, 1)], "PULocationID int, day_of_week int, request_hour int, DOLocationID int, n long")
    row = dest.evaluate_distribution(dist, counts).first()
    assert math.isclose(row.log_loss, -(3 * math.log(0.7) + math.log(0.1) + math.log(1e-15)) / 5)
    assert (row.top1_accuracy, row.top5_accuracy) == (0.6, 0.8)


def test_unknown_dropoff_fails_and_unknown_pickup_is_all_zeros(spark, trips):
    domains = dest.id_domains(trips)
    sizes = {c: d.count() for c, d in domains.items()}
    odd = spark.createDataFrame([(55, 0, 0, 3)], "PULocationID int, day_of_week int, request_hour int, DOLocationID int")
    features, _ = dest.one_hot(dest.encode(odd, domains), sizes)
    vector = features.first().features
    assert vector.size == 3 + 7 + 24 and sum(vector.toArray()) == 2.0 and sum(vector.toArray()[:3]) == 0.0
    bad = odd.withColumn("DOLocationID", F.lit(1234))
    with pytest.raises(Exception, match="unknown drop-off id"):
        dest.require_known_targets(dest.encode(bad, domains)).collect()


@pytest.fixture(scope="module")
def trained(trips):
    rows = plan.prepare(trips, ["id"])
    return plan.train(trips, rows, hidden=(6, 5), max_iter=15), rows


def test_weight_table_reproduces_the_model(trained):
    model, _ = trained
    w = {}
    for r in model.weights().collect():
        w.setdefault((r.layer, r.kind), {})[r.i, r.j] = r.value
    slot = model.score(model.features(trained[1]).select(*dest.SLOT).limit(1)).orderBy("DOLocationID").collect()
    index = {c: {r.id: r.idx for r in d.collect()} for c, d in model.domains.items()}
    x, offset = np.zeros(model.layers[0]), 0
    for c in dest.SLOT:
        x[offset + index[c][slot[0][c]]] = 1.0
        offset += model.sizes[c]
    for layer, (n_in, n_out) in enumerate(zip(model.layers, model.layers[1:])):
        weight = np.array([[w[layer, "W"][i, j] for j in range(n_out)] for i in range(n_in)])
        x = x @ weight + np.array([w[layer, "b"][0, j] for j in range(n_out)])
        x = 1 / (1 + np.exp(-x)) if layer < len(model.layers) - 2 else np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    assert np.allclose([r.p for r in slot], x)


def test_saved_model_scores_the_same(spark, trained, tmp_path):
    model, rows = trained
    model.save(str(tmp_path))
    again = plan.DestinationModel.load(spark, str(tmp_path))
    grid = dest.slot_grid(model.domains["PULocationID"])
    assert model.score(grid).count() == 3 * 168 * 4
    assert model.score(grid).exceptAll(again.score(grid)).isEmpty()
    measures = plan.evaluate(model, rows).first()
    assert 0 < measures.log_loss < 5 and measures.top1_accuracy <= measures.top5_accuracy == 1.0


def test_scoring_needs_a_model(trips):
    with pytest.raises(ValueError, match="fitted model"):
        dest.score_slots(trips, {}, {}, None, None)


@pytest.mark.parametrize("n", [1, 137, 1499, 1500, 9999])
def test_sample_has_exactly_n_rows(trips, n):
    out = sampling.sample_rows(trips, n, ["id"])
    assert out.count() == min(n, 1500) == out.select("id").distinct().count()


def test_samples_are_nested_and_repeatable(trips):
    small, large = (sampling.sample_rows(trips, n, ["id"]) for n in (100, 300))
    assert small.exceptAll(large).isEmpty() and small.exceptAll(sampling.sample_rows(trips, 100, ["id"])).isEmpty()


def test_split_shares(trips):
    got = dict(sampling.split_rows(trips, ["id"]).groupBy("split").count().collect())
    assert abs(got["test"] / 1500 - 0.15) < 0.04 and abs(got["train"] / 1500 - 0.7225) < 0.05


def test_a_small_sample_has_the_shares_of_the_split(spark):
    trips = spark.range(20_000).selectExpr(
        "id", "CAST(1 + id % 3 AS INT) AS PULocationID", "CAST(id % 7 AS INT) AS day_of_week",
        "CAST(id % 24 AS INT) AS request_hour", "CAST(1 + id % 4 AS INT) AS DOLocationID",
    )
    rows = plan.prepare(trips, ["id"], sample_size=1600)
    got = dict(rows.groupBy("split").count().collect())
    assert sum(got.values()) == 1600
    assert abs(got.get("test", 0) / 1600 - 0.15) < 0.04 and abs(got.get("train", 0) / 1600 - 0.7225) < 0.05
    assert plan.train(trips, rows, hidden=(3, 2), max_iter=2).layers == [3 + 7 + 24, 3, 2, 4]


def test_activation_budget_and_ties(spark):
    scores = spark.createDataFrame([("g", a, s) for a, s in ((1, 5.0), (2, 7.0), (3, 5.0), (4, 1.0))] + [("h", 9, 0.0)], "slot string, arm int, score double")

    def active(budget):
        return {(r.slot, r.arm) for r in sampling.activate_top(scores, budget, ["slot"]).collect() if r.active}

    assert active(2) == {("g", 2), ("g", 1), ("h", 9)} and active(0) == set() and len(active(99)) == 5
