"""Repeatable samples, splits and ranked cuts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from curbside.functions.hashing import key_hash, unit_hash

SEED = 42


def sample_rows(df: DataFrame, n: int, keys: list[str], seed: int = SEED) -> DataFrame:
    """Exactly min(n, rows) rows: those with the smallest key hash, ties by the keys.

    A histogram of the hash finds the bin in which the n-th row falls. Lower bins are taken
    whole, in parallel; only that one bin is ranked.
    """
    hashed = df.withColumn("_h", key_hash(*keys, seed=seed))
    hashed = hashed.withColumn("_bin", F.shiftright("_h", 36))
    order = Window.partitionBy(F.lit(0)).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = (
        hashed.groupBy("_bin").agg(F.count("*").alias("c"))
        .withColumn("upto", F.sum("c").over(order))
        .where(F.col("upto") >= n)
        .agg(F.min(F.struct("_bin", "upto", "c")).alias("b"))
    )
    edge = bins.select("b.*").first()
    if edge is None or edge["_bin"] is None:
        return df
    left = n - (edge["upto"] - edge["c"])
    whole = hashed.where(F.col("_bin") < edge["_bin"])
    last = hashed.where(F.col("_bin") == edge["_bin"]).orderBy("_h", *keys).limit(left)
    return whole.unionByName(last).drop("_h", "_bin")


def split_rows(df: DataFrame, keys: list[str], test: float = 0.15, validation: float = 0.15, seed: int = SEED) -> DataFrame:
    """Add `split`: 'test', then 'validation' and 'train' among the rest, by two independent hashes."""
    return df.withColumn(
        "split",
        F.when(unit_hash(*keys, seed=seed) < test, "test")
        .when(unit_hash(*keys, seed=seed + 1) < validation, "validation")
        .otherwise("train"),
    )


def first_rows(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    return df.orderBy(*order).limit(n)


def activate_top(scores: DataFrame, budget: int, group: list[str], score: str = "score", arm: str = "arm") -> DataFrame:
    """Add `active`: 1 for the `budget` highest scores of each group (ties to the lower arm), else 0.

    The cut-off row of each group comes from a rank filter that Spark applies before the shuffle;
    every row is then compared with its group's cut-off. Rows without a score are never active, a NaN score
    ranks above all others, and null group keys form a group.
    """
    if int(budget) <= 0:
        return scores.withColumn("active", F.lit(0))
    w = Window.partitionBy(*group).orderBy(F.col(score).desc(), F.col(arm).asc())
    top = scores.select(*group, score, arm).where(F.col(score).isNotNull()).withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= int(budget))
    cut = top.groupBy(*group).agg(F.max_by(F.struct(F.col(score).alias("s"), F.col(arm).alias("a")), "_rank").alias("_cut"))
    above = (F.col(score) > F.col("_cut.s")) | ((F.col(score) == F.col("_cut.s")) & (F.col(arm) <= F.col("_cut.a")))
    cut = cut.withColumnsRenamed({g: f"_{g}" for g in group})
    same = [scores[g].eqNullSafe(cut[f"_{g}"]) for g in group]
    joined = scores.join(cut, same, "left") if group else scores.crossJoin(cut)
    return joined.withColumn("active", F.coalesce(above.cast("int"), F.lit(0))).drop("_cut", *[f"_{g}" for g in group])
