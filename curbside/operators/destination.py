"""Where trips go: id domains, encoding, the trained classifier and the counted distribution."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from curbside.functions.numeric import let
from curbside.operators.blocks import range_rank
from curbside.operators.demand import days_of_week, hours_of_day
from curbside.sources.staging import stage

FEATURES = {"PULocationID": "pu_idx", "day_of_week": "dow_idx", "request_hour": "hour_idx"}
TARGET = "DOLocationID"
SLOT = list(FEATURES)
HIDDEN = (128, 64)


# --- domains and encoding -------------------------------------------------------------------


def id_domain(df: DataFrame, column: str) -> DataFrame:
    """Distinct ids of a column, numbered from 0 in id order: (id, idx)."""
    return range_rank(distinct_ids(df, column), ["id"]).select("id", F.col("idx").cast("int").alias("idx"))


def distinct_ids(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(column).alias("id")).where(F.col("id").isNotNull()).distinct()


def id_domains(df: DataFrame) -> dict[str, DataFrame]:
    """The four domains, over the full table so that every id of any later split has a number."""
    return {c: id_domain(df, c) for c in [*SLOT, TARGET]}


def encode(df: DataFrame, domains: dict[str, DataFrame]) -> DataFrame:
    """Join the index of every feature and of the target; an unknown feature id gets a null index."""
    out = df
    for column, idx in {**FEATURES, TARGET: "do_idx"}.items():
        if column in domains and column in df.columns:
            out = out.join(domains[column].select(F.col("id").alias(column), F.col("idx").alias(idx)), column, "left")
    return out


def require_known_targets(encoded: DataFrame) -> DataFrame:
    """Fail the job on a drop-off id outside the domain."""
    return encoded.withColumn(
        "do_idx",
        F.when(F.col("do_idx").isNotNull(), F.col("do_idx")).otherwise(
            F.raise_error(F.concat(F.lit("unknown drop-off id "), F.col(TARGET).cast("string"))).cast("int")
        ),
    )


def dropoff_to_pickup(dropoffs: DataFrame, pickups: DataFrame, unmapped: str = "first") -> DataFrame:
    """(dropoff, target): the same id where it is a pickup zone, else the first pickup zone.

    `unmapped="drop"` leaves such drop-offs out instead.
    """
    known = pickups.select(F.col("id").alias("dropoff"), F.col("id").alias("same"))
    out = dropoffs.select(F.col("id").alias("dropoff")).join(known, "dropoff", "left")
    if unmapped == "drop":
        return out.where(F.col("same").isNotNull()).select("dropoff", F.col("same").alias("target"))
    return out.select("dropoff", F.coalesce("same", pickups.agg(F.min("id")).scalar()).alias("target"))


# --- the counted distribution ---------------------------------------------------------------


def destination_counts(trips: DataFrame) -> DataFrame:
    """Trips per (pickup, weekday, hour, drop-off): all the counted distribution needs."""
    return trips.groupBy(*SLOT, TARGET).agg(F.count("*").alias("n"))


@dataclass(frozen=True)
class BackOff:
    """P(drop-off | slot) by what was counted and what is left over: rows in proportion to the counted cells.

    A slot's probability is its own cell plus `rest` of its zone's, a zone's its own cell plus `rest` of the overall one.
    `slots` and `zones` hold the rests; a slot or zone that is not there has a rest of 1.
    """

    cells: DataFrame  # slot, drop-off, p
    slots: DataFrame  # slot, rest
    zone_cells: DataFrame  # pickup, drop-off, p
    zones: DataFrame  # pickup, rest
    overall: DataFrame  # drop-off, p

    def dense(self, slots: DataFrame | None = None) -> DataFrame:
        """Written out for every drop-off of each of `slots`, or of each slot that was counted."""
        wanted = self.slots.select(*SLOT) if slots is None else slots.select(*SLOT).distinct()
        zones = wanted.select("PULocationID").distinct().join(self.zones, "PULocationID", "left")
        own = self.zone_cells.withColumnRenamed("p", "own")
        p_zone = F.coalesce("own", F.lit(0.0)) + F.coalesce("rest", F.lit(1.0)) * F.col("p")
        by_zone = (
            zones.crossJoin(self.overall)
            .join(own, ["PULocationID", TARGET], "left")
            .select("PULocationID", TARGET, p_zone.alias("p_zone"))
        )
        p = F.coalesce("p", F.lit(0.0)) + F.coalesce("rest", F.lit(1.0)) * F.col("p_zone")
        return (
            wanted.join(self.slots, SLOT, "left")
            .join(by_zone, "PULocationID")
            .join(self.cells, [*SLOT, TARGET], "left")
            .select(*SLOT, TARGET, p.alias("p"))
        )


def back_off(counts: DataFrame, strength: float = 10.0, zone_strength: float = 10.0) -> BackOff:
    """The smoothed distribution of `counts` (`destination_counts`, staged) as its counted cells and rests.

    Counts are smoothed toward the pickup zone's distribution, and that toward the overall one, so a slot with few trips
    leans on its zone: one without trips has its zone's distribution, one of an unknown zone the overall one (the
    strengths must be above 0 for that).
    """

    def level(keys: list[str], weight: float) -> tuple[DataFrame, DataFrame]:
        total = counts.groupBy(*keys).agg(F.sum("n").alias("n_all"))
        cells = counts.groupBy(*keys, TARGET).agg(F.sum("n").alias("n")).join(total, keys)
        share = F.col("n") / (F.col("n_all") + F.lit(weight))
        return (
            cells.select(*keys, TARGET, share.alias("p")),
            total.select(*keys, (F.lit(weight) / (F.col("n_all") + F.lit(weight))).alias("rest")),
        )

    total = counts.agg(F.sum("n")).scalar()
    overall = counts.groupBy(TARGET).agg((F.sum("n") / total).alias("p"))
    cells, slots = level(SLOT, strength)
    zone_cells, zones = level(["PULocationID"], zone_strength)
    return BackOff(cells, slots, zone_cells, zones, stage(overall, "overall-destinations"))


def destination_distribution(
    counts: DataFrame, strength: float = 10.0, zone_strength: float = 10.0, slots: DataFrame | None = None
) -> DataFrame:
    """P(drop-off | slot) for every drop-off zone and each of `slots` (`slot_grid`), or each observed slot; see `back_off`."""
    return back_off(counts, strength, zone_strength).dense(slots)


def merge_onto_pickups(dist: DataFrame, mapping: DataFrame) -> DataFrame:
    """Sum the probabilities of drop-offs that map to the same pickup zone and normalise per slot."""
    merged = (
        dist.join(mapping.withColumnRenamed("dropoff", TARGET), TARGET)
        .groupBy(*SLOT, F.col("target").alias("dest"))
        .agg(F.sum("p").alias("p"))
    )
    total = F.sum("p").over(Window.partitionBy(*SLOT))
    n = F.count("*").over(Window.partitionBy(*SLOT))
    return merged.withColumn("p", F.when(total > 0, F.col("p") / F.when(total > 0, total)).otherwise(1.0 / n)).select(
        F.col("PULocationID").alias("zone"),
        F.col("day_of_week").alias("day"),
        F.col("request_hour").alias("hour"),
        "dest",
        "p",
    )


def running_cdf(dest_prob: DataFrame) -> DataFrame:
    """Cumulative probability along the destination ids of each slot (as many rows as zones)."""
    w = Window.partitionBy("zone", "day", "hour").orderBy("dest").rowsBetween(Window.unboundedPreceding, 0)
    return dest_prob.withColumn("cdf", F.sum("p").over(w)).drop("p")


#: Into how many parts the numbers from 0 to 1 are cut to find a destination.
GUIDE = 64


def cdf_guide(cdf: DataFrame) -> DataFrame:
    """(zone, day, hour, guide, low, high, dest): for each part of the numbers from 0 to 1 the destinations it may mean.

    A number u means the destination with low < u <= high among the rows with guide = floor(u * GUIDE): about as many rows
    as destinations and parts together. The first destination also takes 0, the last whatever is above all.
    """
    w = Window.partitionBy("zone", "day", "hour").orderBy("dest")
    steps = cdf.select(
        "zone", "day", "hour", "dest", F.coalesce(F.lag("cdf").over(w), F.lit(-1.0)).alias("low"),
        F.when(F.lead("cdf").over(w).isNull(), F.lit(2.0)).otherwise(F.col("cdf")).alias("high"),
    )

    def part(x: Column) -> Column:
        return F.least(F.greatest(F.floor(x * GUIDE), F.lit(0)), F.lit(GUIDE - 1)).cast("int")

    parts = F.sequence(part(F.col("low")), F.greatest(part(F.col("low")), part(F.col("high"))))
    return steps.select("zone", "day", "hour", F.explode(parts).alias("guide"), "low", "high", "dest")


# --- the classifier -------------------------------------------------------------------------


def one_hot(encoded: DataFrame, sizes: dict[str, int], model: PipelineModel | None = None) -> tuple[DataFrame, PipelineModel]:
    """Sparse features of length `sum(sizes)`.

    The encoder's extra last category stands for unknown ids and is the one dropped.
    """
    cats = encoded.withColumns(
        {f"{i}_cat": F.coalesce(F.col(i), F.lit(sizes[c])).cast("double") for c, i in FEATURES.items()}
    )
    if model is None:
        schema = ", ".join(f"{i}_cat double" for i in FEATURES.values())
        widest = encoded.sparkSession.createDataFrame([tuple(float(sizes[c]) for c in FEATURES)], schema)
        encoder = OneHotEncoder(
            inputCols=[f"{i}_cat" for i in FEATURES.values()],
            outputCols=[f"{i}_vec" for i in FEATURES.values()],
            dropLast=True,
        )
        assembler = VectorAssembler(inputCols=[f"{i}_vec" for i in FEATURES.values()], outputCol="features")
        model = Pipeline(stages=[encoder, assembler]).fit(widest)
    drop = [f"{i}_{s}" for i in FEATURES.values() for s in ("cat", "vec")]
    return model.transform(cats).drop(*drop), model


def train_classifier(
    train: DataFrame, n_inputs: int, n_classes: int, hidden=HIDDEN, max_iter: int = 20, seed: int = 42
) -> MultilayerPerceptronClassificationModel:
    """Multilayer perceptron on `features` and `label`; every class of the domain is an output."""
    return MultilayerPerceptronClassifier(
        layers=[n_inputs, *hidden, n_classes], maxIter=max_iter, seed=seed, blockSize=1024
    ).fit(train)


def slot_grid(pickups: DataFrame) -> DataFrame:
    """Every pickup zone x weekday x hour: the inputs to score once and keep."""
    return (
        pickups.select(F.col("id").alias("PULocationID"))
        .withColumn("day_of_week", F.explode(days_of_week()))
        .withColumn("request_hour", F.explode(hours_of_day()))
    )


def score_slots(
    slots: DataFrame, domains: dict[str, DataFrame], sizes: dict[str, int], encoder: PipelineModel | None, model
) -> DataFrame:
    """(slot, DOLocationID, p) for each requested slot."""
    if model is None or encoder is None:
        raise ValueError("slots are scored with a fitted model and its encoder; one is missing")
    features, _ = one_hot(encode(slots, {c: domains[c] for c in SLOT}), sizes, encoder)
    probs = model.transform(features).select(*SLOT, F.posexplode(vector_to_array("probability")).alias("idx", "p"))
    names = domains[TARGET].select("idx", F.col("id").alias(TARGET))
    return probs.join(names, "idx").select(*SLOT, TARGET, "p")


def weight_table(model: MultilayerPerceptronClassificationModel, layers: list[int]) -> DataFrame:
    """(layer, kind, i, j, value): `W` rows and `b` rows of every layer.

    Spark stores each layer as a column-major weight matrix followed by its bias.
    """
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    flat = spark.createDataFrame([(model.weights.toArray().tolist(),)], "w array<double>").select(
        F.posexplode("w").alias("pos", "value")
    )
    shapes, start = [], 0
    for layer, (n_in, n_out) in enumerate(zip(layers, layers[1:])):
        shapes.append((layer, "W", start, start + n_in * n_out, n_out))
        start += n_in * n_out
        shapes.append((layer, "b", start, start + n_out, n_out))
        start += n_out
    part = F.col("pos")
    layer_of = F.lit(None).cast("int")
    kind = F.lit(None).cast("string")
    i = F.lit(None).cast("int")
    j = F.lit(None).cast("int")
    for layer, k, lo, hi, n_out in shapes:
        inside = (part >= lo) & (part < hi)
        off = part - lo
        layer_of = F.when(inside, F.lit(layer)).otherwise(layer_of)
        kind = F.when(inside, F.lit(k)).otherwise(kind)
        i = F.when(inside, F.floor(off / n_out).cast("int") if k == "W" else F.lit(0)).otherwise(i)
        j = F.when(inside, (off % n_out).cast("int")).otherwise(j)
    return flat.select(layer_of.alias("layer"), kind.alias("kind"), i.alias("i"), j.alias("j"), "value")


# --- evaluation -----------------------------------------------------------------------------


def class_rank(p, true_idx) -> Column:
    """1-based rank of the true class in a probability array; equal values rank by lower index."""
    p = p if isinstance(p, Column) else F.col(p)
    t = true_idx if isinstance(true_idx, Column) else F.col(true_idx)

    def rank(s: Column) -> Column:
        probs, at = s["p"], s["t"]
        mine = F.element_at(probs, at + 1)
        return let(mine, lambda m: F.size(F.filter(probs, lambda x, k: (x > m) | ((x == m) & (k < at)))) + 1)

    return let(F.struct(p.alias("p"), t.cast("int").alias("t")), rank)


def first_argmax(p) -> Column:
    """0-based index of the largest value; the lowest index wins a tie."""
    p = p if isinstance(p, Column) else F.col(p)
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def ranked_distribution(dist: DataFrame) -> DataFrame:
    """Rank every drop-off inside its slot by probability, ties to the lower id."""
    w = Window.partitionBy(*SLOT).orderBy(F.col("p").desc(), F.col(TARGET).asc())
    return dist.withColumn("rank", F.row_number().over(w))


def evaluate_distribution(dist: DataFrame, counts: DataFrame, floor: float = 1e-15) -> DataFrame:
    """Log loss and top-1/5/10 accuracy of a score table on held-out trips.

    The trips come as `destination_counts`, so each distinct (slot, drop-off) is judged once and
    weighted by its count. A trip whose slot has no scores counts as the floor and as a miss.
    """
    joined = counts.join(ranked_distribution(dist), [*SLOT, TARGET], "left")
    p = F.least(F.greatest(F.coalesce("p", F.lit(floor)), F.lit(floor)), F.lit(1.0 - floor))
    n = F.sum("n")

    def hits(k: int) -> Column:
        return F.sum(F.when(F.col("rank") <= k, F.col("n")).otherwise(0)) / n

    return joined.agg(
        (F.sum(-F.log(p) * F.col("n")) / n).alias("log_loss"),
        hits(1).alias("top1_accuracy"),
        hits(5).alias("top5_accuracy"),
        hits(10).alias("top10_accuracy"),
    )


def evaluate_scored_rows(scored: DataFrame, label: str = "label", floor: float = 1e-15) -> DataFrame:
    """The same measures for rows that carry a probability vector and the true class index."""
    row = F.struct(vector_to_array("probability").alias("p"), F.col(label).cast("int").alias("t"))
    judged = let(
        row,
        lambda s: F.struct(
            F.element_at(s["p"], s["t"] + 1).alias("mine"), class_rank(s["p"], s["t"]).alias("rank")
        ),
    )
    rows = scored.select(judged.alias("j")).select(
        F.least(F.greatest(F.col("j.mine"), F.lit(floor)), F.lit(1.0 - floor)).alias("q"), F.col("j.rank").alias("rank")
    )
    return rows.agg(
        F.avg(-F.log("q")).alias("log_loss"),
        F.avg((F.col("rank") <= 1).cast("double")).alias("top1_accuracy"),
        F.avg((F.col("rank") <= 5).cast("double")).alias("top5_accuracy"),
        F.avg((F.col("rank") <= 10).cast("double")).alias("top10_accuracy"),
    )
