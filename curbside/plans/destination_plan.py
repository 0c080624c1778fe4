"""Sample, split, encode, train, evaluate and export the destination classifier."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassificationModel
from pyspark.sql import DataFrame, SparkSession

from curbside.operators import destination as dest
from curbside.operators.sampling import sample_rows, split_rows
from curbside.sources.staging import stage
from curbside.sources.tables import write_parquet

SAMPLE_SIZE = 300_000


@dataclass
class DestinationModel:
    """Classifier, encoder and the id domains they were fitted on."""

    domains: dict[str, DataFrame]
    sizes: dict[str, int]
    encoder: PipelineModel
    classifier: MultilayerPerceptronClassificationModel
    layers: list[int]

    def features(self, trips: DataFrame) -> DataFrame:
        """Rows with `features` and `label`; a drop-off outside the domain fails the job."""
        encoded = dest.require_known_targets(dest.encode(trips, self.domains))
        out, _ = dest.one_hot(encoded, self.sizes, self.encoder)
        return out.withColumn("label", out["do_idx"].cast("double"))

    def score(self, slots: DataFrame) -> DataFrame:
        return dest.score_slots(slots, self.domains, self.sizes, self.encoder, self.classifier)

    def weights(self) -> DataFrame:
        return dest.weight_table(self.classifier, self.layers)

    def save(self, folder: str) -> None:
        self.classifier.write().overwrite().save(f"{folder}/classifier")
        self.encoder.write().overwrite().save(f"{folder}/encoder")
        for column, domain in self.domains.items():
            write_parquet(domain, f"{folder}/domain/{column}")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> DestinationModel:
        domains = {c: spark.read.parquet(f"{folder}/domain/{c}") for c in [*dest.SLOT, dest.TARGET]}
        classifier = MultilayerPerceptronClassificationModel.load(f"{folder}/classifier")
        return cls(
            domains,
            {c: d.count() for c, d in domains.items()},
            PipelineModel.load(f"{folder}/encoder"),
            classifier,
            list(classifier.getLayers()),
        )


def prepare(trips: DataFrame, keys: list[str], sample_size: int = SAMPLE_SIZE, seed: int = 42) -> DataFrame:
    """The sampled trips with their split, staged: at most `sample_size` rows. `trips` is read twice.

    The split takes the hashes of `seed` and `seed + 1`, the sample that of `seed + 2`: rows chosen by a low hash of the
    split's own would all be test rows.
    """
    rows = trips.select(*keys, *dest.SLOT, dest.TARGET)
    return stage(split_rows(sample_rows(rows, sample_size, keys, seed + 2), keys, seed=seed), "destination-split")


def train(trips: DataFrame, rows: DataFrame, hidden=dest.HIDDEN, max_iter: int = 20, seed: int = 42) -> DestinationModel:
    """Fit the domains on all `trips` and the classifier on the 'train' part of `rows`."""
    domains = {c: stage(d, f"domain-{c}") for c, d in dest.id_domains(trips).items()}
    sizes = {c: d.count() for c, d in domains.items()}
    part = dest.encode(rows.where("split = 'train'"), domains)
    features, encoder = dest.one_hot(dest.require_known_targets(part), sizes)
    n_inputs = sum(sizes[c] for c in dest.SLOT)
    layers = [n_inputs, *hidden, sizes[dest.TARGET]]
    tasks = trips.sparkSession.sparkContext.defaultParallelism
    labelled = features.select("features", features["do_idx"].cast("double").alias("label")).repartition(tasks)
    classifier = dest.train_classifier(labelled, n_inputs, sizes[dest.TARGET], hidden, max_iter, seed)
    return DestinationModel(domains, sizes, encoder, classifier, layers)


def evaluate(model: DestinationModel, rows: DataFrame, split: str = "test") -> DataFrame:
    """Log loss and top-1/5/10 accuracy on one part of the split."""
    scored = model.classifier.transform(model.features(rows.where(rows["split"] == split)))
    return dest.evaluate_scored_rows(scored)


def workflow(trips: DataFrame, keys: list[str], folder: str, sample_size: int = SAMPLE_SIZE, hidden=dest.HIDDEN,
             max_iter: int = 20, seed: int = 42) -> tuple[DestinationModel, DataFrame]:
    """Everything in order; the model, its weights and the scored slot grid end up under `folder`."""
    rows = prepare(trips, keys, sample_size, seed)
    model = train(trips, rows, hidden, max_iter, seed)
    measures = evaluate(model, rows)
    model.save(folder)
    write_parquet(model.weights(), f"{folder}/weights")
    grid = model.score(dest.slot_grid(model.domains["PULocationID"]))
    write_parquet(grid, f"{folder}/slot_scores", partition_by=["day_of_week"])
    return model, measures
