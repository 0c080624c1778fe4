"""Domains, encoding, the counted distribution, evaluation, and the trained classifier."""

from pyspark.sql import functions as F

from curbside.catalog.registry import query
from curbside.catalog.sql import r4, r6
from curbside.functions.numeric import r4 as round4, r6 as round6
from curbside.operators import destination
from curbside.plans import destination_plan
from curbside.sources.staging import stage, staged_path

IDS = ["PULocationID", "day_of_week", "request_hour", "DOLocationID"]


def _domain_sql(column: str) -> str:
    return (
        f"SELECT '{column}' AS domain, {column} AS id, CAST(row_number() OVER (ORDER BY {column}) - 1 AS INT) AS idx "
        f"FROM (SELECT DISTINCT {column} FROM trips)"
    )


@query("f1_dense_ids", f"SELECT id, idx FROM ({_domain_sql('PULocationID')})", one_pass=True)
def dense_ids(t):
    return destination.id_domain(t.dest_counts, "PULocationID")


@query("j1_id_domains", " UNION ALL ".join(_domain_sql(c) for c in IDS), one_pass=True)
def id_domains(t):
    out = None
    for column, domain in destination.id_domains(t.dest_counts).items():
        part = domain.select(F.lit(column).alias("domain"), "id", "idx")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "j2_encoded_trips",
    "SELECT trip_key, a.idx AS pu_idx, b.idx AS dow_idx, c.idx AS hour_idx, d.idx AS do_idx FROM trips "
    + " ".join(f"JOIN ({_domain_sql(c)}) {n} ON {n}.id = {c}" for n, c in zip("abcd", IDS)),
    keep=("trip_key", *IDS),
)
def encoded_trips(t):
    rows = t.kept_trips.select("trip_key", *IDS)
    encoded = destination.require_known_targets(destination.encode(rows, destination.id_domains(t.dest_counts)))
    return encoded.select("trip_key", "pu_idx", "dow_idx", "hour_idx", "do_idx")


@query("d7_dropoff_to_pickup", "SELECT dropoff, target FROM mapping", one_pass=True)
def dropoff_to_pickup(t):
    return destination.dropoff_to_pickup(t.dropoff_ids, t.pickup_ids)


@query(
    "j8_destination_distribution",
    f"SELECT PULocationID, day_of_week, request_hour, DOLocationID, {r6('p')} AS p FROM dist",
    one_pass=True,
)
def destination_distribution(t):
    return t.distribution.withColumn("p", round6("p"))


@query("f3_destination_probs", f"SELECT zone, day, hour, dest, {r6('p')} AS p FROM dest_prob", one_pass=True)
def destination_probs(t):
    return t.dest_prob.withColumn("p", round6("p"))


@query("f4_running_cdf", f"SELECT zone, day, hour, dest, {r6('cdf')} AS cdf FROM cdf", one_pass=True)
def running_cdf(t):
    return destination.running_cdf(t.dest_prob).withColumn("cdf", round6("cdf"))


RANKED = (
    "SELECT *, CAST(row_number() OVER (PARTITION BY PULocationID, day_of_week, request_hour ORDER BY p DESC, DOLocationID) AS INT) AS rank FROM dist"
)


def _packed(t):
    slots = t.distribution.groupBy(*destination.SLOT).agg(
        F.array_sort(F.collect_list(F.struct("DOLocationID", "p"))).alias("s")
    )
    return slots.select(*destination.SLOT, F.col("s.DOLocationID").alias("ids"), F.col("s.p").alias("p"))


@query(
    "g2_class_rank",
    f"""SELECT c.PULocationID, c.day_of_week, c.request_hour, c.DOLocationID, n, rank
        FROM dcounts c JOIN ({RANKED}) r USING (PULocationID, day_of_week, request_hour, DOLocationID)""",
    one_pass=True,
)
def class_rank(t):
    rows = t.dest_counts.join(_packed(t), destination.SLOT)
    true_idx = F.array_position("ids", F.col("DOLocationID")) - 1
    return rows.withColumn("t", true_idx.cast("int")).select(*IDS, "n", destination.class_rank("p", "t").alias("rank"))


@query(
    "g3_likeliest_destination",
    f"SELECT PULocationID, day_of_week, request_hour, DOLocationID AS likeliest FROM ({RANKED}) WHERE rank = 1",
    one_pass=True,
)
def likeliest_destination(t):
    best = F.element_at("ids", destination.first_argmax("p") + 1)
    return _packed(t).select(*destination.SLOT, best.alias("likeliest"))


@query(
    "j5_evaluated_distribution",
    f"""SELECT {r6('sum(-ln(greatest(p, 1e-15)) * n) / sum(n)')} AS log_loss,
        {r6('CAST(sum(n) FILTER (WHERE rank <= 1) AS DOUBLE) / sum(n)')} AS top1_accuracy,
        {r6('CAST(sum(n) FILTER (WHERE rank <= 5) AS DOUBLE) / sum(n)')} AS top5_accuracy,
        {r6('CAST(sum(n) FILTER (WHERE rank <= 10) AS DOUBLE) / sum(n)')} AS top10_accuracy
        FROM dcounts JOIN ({RANKED}) USING (PULocationID, day_of_week, request_hour, DOLocationID)""",
    one_pass=True,
)
def evaluated_distribution(t):
    scores = destination.evaluate_distribution(t.distribution, t.dest_counts)
    return scores.select(*[round6(c).alias(c) for c in scores.columns])


# --- the classifier: trained here, so rows only -----------------------------------------------

KEYS = ["trip_key"]
ITERATIONS = 20


def _trained(t):
    rows = destination_plan.prepare(t.trips, KEYS)
    return destination_plan.train(t.trips, rows, max_iter=ITERATIONS), rows


@query("j3_trained_classifier")
def trained_classifier(t):
    """Test measures of the trained classifier next to those of the counted distribution."""
    model, rows = _trained(t)
    seen = destination.destination_counts(rows.where("split = 'train'"))
    test = destination.destination_counts(rows.where("split = 'test'"))
    counted = destination.evaluate_distribution(destination.destination_distribution(seen), test)
    return (
        destination_plan.evaluate(model, rows)
        .withColumn("model", F.lit("classifier"))
        .unionByName(counted.withColumn("model", F.lit("counted")))
    )


@query("j4_fit_metrics")
def fit_metrics(t):
    model, rows = _trained(t)
    out = None
    for part in ("train", "validation"):
        one = destination_plan.evaluate(model, rows, part).select(F.lit(part).alias("part"), "log_loss", "top1_accuracy")
        out = one if out is None else out.unionByName(one)
    return out


@query("j6_predicted_slots")
def predicted_slots(t):
    """Likeliest drop-off of every slot that has trips."""
    model, _ = _trained(t)
    slots = t.dest_counts.select(*destination.SLOT).distinct()
    return destination.ranked_distribution(model.score(slots)).where("rank = 1").drop("rank")


@query("j7_scored_grid")
def scored_grid(t):
    model, _ = _trained(t)
    return model.score(destination.slot_grid(model.domains["PULocationID"]))


@query("j9_workflow")
def workflow(t):
    """Everything from sample to exported tables; the measures after loading the model again."""
    folder = staged_path(t.spark, "destination-model")
    destination_plan.workflow(t.trips, KEYS, folder, max_iter=ITERATIONS)
    model = destination_plan.DestinationModel.load(t.spark, folder)
    return destination_plan.evaluate(model, destination_plan.prepare(t.trips, KEYS))


@query("a6_saved_model")
def saved_model(t):
    model, _ = _trained(t)
    folder = staged_path(t.spark, "destination-model")
    model.save(folder)
    again = destination_plan.DestinationModel.load(t.spark, folder)
    slots = t.dest_counts.select(*destination.SLOT).distinct()
    return again.score(slots)


@query("a7_weight_table")
def weight_table(t):
    model, _ = _trained(t)
    return model.weights()


# --- what must hold for any trained model ---------------------------------------------------------

SLOTS = "(SELECT DISTINCT PULocationID, day_of_week, request_hour FROM trips)"
N_DROPOFFS = "(SELECT count(DISTINCT DOLocationID) FROM trips)"


def _totals(scored):
    """How many drop-offs each slot has scores for, whether all are probabilities and whether they add up to 1."""
    return scored.groupBy(*destination.SLOT).agg(
        F.count("*").alias("dropoffs"), F.bool_and(F.col("p").between(0, 1)).alias("in_range"), round4(F.sum("p")).alias("total")
    )


@query(
    "j7_grid_invariants",
    f"""SELECT z.PULocationID, CAST(d.range AS INT) AS day_of_week, CAST(h.range AS INT) AS request_hour, {N_DROPOFFS} AS dropoffs,
        TRUE AS in_range, 1.0::DOUBLE AS total FROM zones z CROSS JOIN range(7) d CROSS JOIN range(24) h""",
)
def grid_invariants(t):
    """Every pickup zone and hour of the week has a distribution over all drop-offs."""
    model, _ = _trained(t)
    return _totals(model.score(destination.slot_grid(model.domains["PULocationID"])))


@query(
    "j6_slot_invariants",
    f"SELECT s.*, {N_DROPOFFS} AS dropoffs, TRUE AS in_range, 1.0::DOUBLE AS total, TRUE AS known FROM {SLOTS} s",
)
def slot_invariants(t):
    """The slots with trips, their distributions, and whether the likeliest drop-off is one of those that trips have."""
    model, _ = _trained(t)
    scored = stage(model.score(t.dest_counts.select(*destination.SLOT).distinct()), "slot-scores")
    best = destination.ranked_distribution(scored).where("rank = 1").select(*destination.SLOT, F.col("DOLocationID").alias("best"))
    seen = destination.distinct_ids(t.dest_counts, "DOLocationID").select(F.col("id").alias("best"), F.lit(True).alias("known"))
    best = best.join(seen, "best", "left").drop("best").withColumn("known", F.coalesce("known", F.lit(False)))
    return _totals(scored).join(best, destination.SLOT)


@query(
    "a6_reload_invariants",
    f"SELECT s.*, {N_DROPOFFS} AS dropoffs, 0.0::DOUBLE AS difference FROM {SLOTS} s",
)
def reload_invariants(t):
    """A model that was saved and loaded again scores every slot as before."""
    model, _ = _trained(t)
    folder = staged_path(t.spark, "destination-model")
    model.save(folder)
    slots = stage(t.dest_counts.select(*destination.SLOT).distinct(), "slots")
    again = destination_plan.DestinationModel.load(t.spark, folder).score(slots).withColumnRenamed("p", "again")
    both = model.score(slots).join(again, IDS, "full_outer")
    gap = F.coalesce(F.abs(F.col("p") - F.col("again")), F.lit(1.0))
    return both.groupBy(*destination.SLOT).agg(F.count("*").alias("dropoffs"), F.max(gap).alias("difference"))


@query(
    "a7_weight_shapes",
    f"""WITH n AS (SELECT [(SELECT count(DISTINCT PULocationID) + count(DISTINCT day_of_week) + count(DISTINCT request_hour) FROM trips),
          128, 64, {N_DROPOFFS}] AS w)
        SELECT CAST(l.range AS INT) AS layer, k.kind, CASE WHEN k.kind = 'W' THEN w[l.range + 1] ELSE 1 END AS n_rows,
          w[l.range + 2] AS n_columns, CASE WHEN k.kind = 'W' THEN w[l.range + 1] ELSE 1 END * w[l.range + 2] AS n_values
        FROM n CROSS JOIN range(3) l CROSS JOIN (VALUES ('W'), ('b')) k(kind)""",
)
def weight_shapes(t):
    """The exported weights fill the matrix and the bias of every layer, each place once."""
    model, _ = _trained(t)
    distinct = F.count_distinct("i", "j")
    return model.weights().groupBy("layer", "kind").agg(
        F.count_distinct("i").alias("n_rows"), F.count_distinct("j").alias("n_columns"), distinct.alias("n_values")
    )


def _measured(measures):
    """Whether measures are those of a classifier: a positive loss, hits that grow with what is let in."""
    hits = [c for c in ("top1_accuracy", "top5_accuracy", "top10_accuracy") if c in measures.columns]
    ordered = F.lit(True)
    for low, high in zip([None, *hits], [*hits, None]):
        ordered = ordered & ((F.col(low) if low else F.lit(0.0)) <= (F.col(high) if high else F.lit(1.0)))
    return measures.select(*[c for c in ("model", "part") if c in measures.columns], (F.col("log_loss") > 0).alias("loss"), ordered.alias("ordered"))


@query(
    "j3_measure_invariants",
    "SELECT model, TRUE AS loss, TRUE AS ordered FROM (VALUES ('classifier'), ('counted')) m(model) WHERE (SELECT count(*) FROM trips) > 0",
)
def measure_invariants(t):
    return _measured(trained_classifier(t))


@query(
    "j4_fit_invariants",
    "SELECT part, TRUE AS loss, TRUE AS ordered FROM (VALUES ('train'), ('validation')) m(part) WHERE (SELECT count(*) FROM trips) > 0",
)
def fit_invariants(t):
    return _measured(fit_metrics(t))


@query("j9_workflow_invariants", "SELECT TRUE AS loss, TRUE AS ordered WHERE (SELECT count(*) FROM trips) > 0")
def workflow_invariants(t):
    return _measured(workflow(t))
