"""Ordered-series operators that split each series into blocks.

A window over a whole series puts that series in one task. Here a series is cut by ranges of
its integer order column, windows run inside a block, and only one summary row per block
crosses between blocks. (keys, order) must be unique, so a block holds at most `size` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from curbside.sources.staging import stage

BLOCK = 65536


def _block(order: str, size: int) -> Column:
    return F.floor(F.col(order) / F.lit(size)).cast("bigint")


def _inside(keys, order):
    return Window.partitionBy(*keys, "_block").orderBy(order)


def _across(keys):
    return Window.partitionBy(*keys).orderBy("_block") if keys else Window.partitionBy(F.lit(0)).orderBy("_block")


def running_total(df: DataFrame, keys: list[str], order: str, value: str, out: str, size: int = BLOCK) -> DataFrame:
    """Cumulative sum of `value` along `order` within `keys`."""
    df = df.withColumn("_block", _block(order, size))
    before = (
        df.groupBy(*keys, "_block")
        .agg(F.sum(value).alias("_sum"))
        .withColumn("_before", F.coalesce(F.sum("_sum").over(_across(keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .drop("_sum")
    )
    inner = F.sum(value).over(_inside(keys, order).rowsBetween(Window.unboundedPreceding, 0))
    return (
        df.withColumn("_inner", inner)
        .join(before, [*keys, "_block"])
        .withColumn(out, F.col("_before") + F.col("_inner"))
        .drop("_block", "_inner", "_before")
    )


def dense_index(df: DataFrame, keys: list[str], order: str, out: str = "idx", size: int = BLOCK) -> DataFrame:
    """0-based position of each row along `order` within `keys`."""
    df = df.withColumn("_block", _block(order, size))
    before = (
        df.groupBy(*keys, "_block")
        .agg(F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(_across(keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .drop("_n")
    )
    return (
        df.withColumn("_inner", F.row_number().over(_inside(keys, order)) - 1)
        .join(before, [*keys, "_block"])
        .withColumn(out, F.col("_before") + F.col("_inner"))
        .drop("_block", "_inner", "_before")
    )


def range_rank(df: DataFrame, order: list[str], out: str = "idx") -> DataFrame:
    """0-based position of each row of `df` along `order` (values of any kind and spread; ties in any order).

    The rows are range-partitioned by `order`, so tasks hold about equal numbers of them however the values lie. A row's
    place in its range is fixed when the ranges are written; only one count of each range goes through one task.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = stage(ranged.withColumn("_place", F.monotonically_increasing_id()), "ranges")
    part, within_part = F.shiftright("_place", 33), F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    counts = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = stage(counts.select("_part", F.coalesce(before, F.lit(0)).alias("_before")), "range-offsets")
    ranked = ranged.withColumn("_part", part).join(offsets, "_part").withColumn(out, F.col("_before") + within_part)
    return ranked.drop("_place", "_part", "_before")


def next_values(df: DataFrame, keys: list[str], order: str, cols: dict[str, str], size: int = BLOCK) -> DataFrame:
    """For each `out: column`, the column's value on the following row of the series, else null."""
    df = df.withColumn("_block", _block(order, size))
    here = F.struct(*[F.col(c).alias(o) for o, c in cols.items()])
    heads = (
        df.groupBy(*keys, "_block")
        .agg(F.min_by(here, F.col(order)).alias("_head"))
        .withColumn("_after", F.lead("_head").over(_across(keys)))
        .drop("_head")
    )
    return (
        df.withColumn("_next", F.lead(here).over(_inside(keys, order)))
        .join(heads, [*keys, "_block"])
        .withColumn("_next", F.coalesce("_next", "_after"))
        .select("*", *[F.col(f"_next.{o}").alias(o) for o in cols])
        .drop("_block", "_next", "_after")
    )


def moving_mean(
    df: DataFrame, keys: list[str], index: str, value: str, out: str, before: int, after: int,
    pad: bool = False, size: int = BLOCK,
) -> DataFrame:
    """Mean over the `before` preceding rows, the row itself and the `after` following rows.

    `index` is a 0-based dense position (`dense_index`). Rows near a block edge are copied to the
    neighbour block as a halo. With `pad` the ends repeat the first and last value; without it,
    rows whose window does not fit are left out.
    """
    if max(before, after) > size:
        raise ValueError("the window must not be longer than a block")
    width = before + after + 1
    own = _block(index, size)
    reach = F.array(
        *[F.lit(0)],
        *([F.lit(1)] if before else []),
        *([F.lit(-1)] if after else []),
    )
    pos = F.pmod(F.col(index), F.lit(size))
    wanted = (
        (F.col("_shift") == 0)
        | ((F.col("_shift") == 1) & (pos >= size - before))
        | ((F.col("_shift") == -1) & (pos < after))
    )
    spread = (
        df.withColumn("_shift", F.explode(reach))
        .where(wanted)
        .withColumn("_block", own + F.col("_shift"))
    )
    w = Window.partitionBy(*keys, "_block").orderBy(index).rowsBetween(-before, after)
    cut = spread.withColumns({"_sum": F.sum(value).over(w), "_rows": F.count("*").over(w)}).where(F.col("_shift") == 0)
    if not pad:
        return (
            cut.where(F.col("_rows") == width)
            .withColumn(out, F.col("_sum") / F.lit(float(width)))
            .drop("_shift", "_block", "_sum", "_rows")
        )
    ends = df.groupBy(*keys).agg(
        F.min_by(value, index).alias("_first"), F.max_by(value, index).alias("_last"), F.max(index).alias("_end")
    )
    missing_left = F.greatest(F.lit(before) - F.col(index), F.lit(0))
    missing_right = F.greatest(F.col(index) + F.lit(after) - F.col("_end"), F.lit(0))
    joined = cut.join(ends, keys) if keys else cut.withColumn("_e", ends.select(F.struct("*")).scalar()).select("*", "_e.*").drop("_e")
    return joined.withColumn(
        out, (F.col("_sum") + missing_left * F.col("_first") + missing_right * F.col("_last")) / F.lit(float(width))
    ).drop("_shift", "_block", "_sum", "_rows", "_first", "_last", "_end")
