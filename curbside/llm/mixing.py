"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from curbside.sources.staging import stage

WORD = r"[^\x20\x09-\x0D]+"
#: A source's name and whether it has none; plain columns, so that rows without a source join and group like others.
SOURCE = ["source", "unnamed"]


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _whole_share(rows: int, least: int = 4096, each: int = 100_000) -> int:
    """Into how many ranges `rows` are cut: at least `least`, and more as soon as a range would exceed `each` rows."""
    return max(least, -(-rows // each))


def source_targets(sizes: DataFrame, weights: tuple[int, ...], repeats: int, budget: int | None = None) -> DataFrame:
    """`sizes` (source, unnamed, source_size: one row for each source) with `weight`, and `target`: the words each gives.

    Sources in order of code points, those without a name last, weigh `weights` in turn and share `budget` words (all
    there are if None). No target is above `repeats` times the source's size. What that leaves over is shared by weight
    among the others, until none is above: in order of size over weight the level that is left for a source and those
    behind it first rises, then falls, so its highest value is the level at which all that are not full stand.
    One row for each source goes through one task, never rows of documents.
    """
    order = F.row_number().over(Window.orderBy("unnamed", "source")) - 1
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (order % len(weights) + 1).cast("int"))
    most = (F.col("source_size") * repeats).alias("most")
    weighed = sizes.select("*", most, turn.cast("bigint").alias("weight"))
    total = F.sum("source_size").over(Window.partitionBy(F.lit(0)))
    if budget is not None:
        total = F.least(F.lit(budget), total * repeats)
    by_share = Window.orderBy(F.col("most") / F.col("weight"), "unnamed", "source")
    before = F.coalesce(F.sum("most").over(by_share.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(by_share.rowsBetween(0, Window.unboundedFollowing))
    leveled = weighed.select("*", ((total - before).cast("double") / rest).alias("left"))
    level = F.max("left").over(Window.partitionBy(F.lit(0)))
    target = F.least(F.col("most").cast("double"), F.col("weight") * level)
    return leveled.select(*SOURCE, "source_size", "weight", target.alias("target"))


def shuffled_queues(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), repeats: int = 3, budget: int | None = None, seed: int = 0
) -> DataFrame:
    """One row for each row of `docs` (doc_id, text, source): its place in its source's shuffled queue.

    Columns: doc_id, source, unnamed, size, source_size, target, and `start`: the words of the source before it. Texts
    are read once and do not move. A queue is in the order of a hash of doc_id and size, so reruns agree; rows that agree
    in both are alike here. A source is cut into ranges of that hash, one row of each crosses between them, so a source
    with a third of all rows is as many tasks as it has ranges. Rows without words have `start` null: they are never served.
    """
    size = word_count(F.col("text"))
    named = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        F.col("source").isNull().alias("unnamed"), size.alias("size"),
    )
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "size"))
    sized = stage(named.withColumn("key", key), "mix-sized")
    cuts = _whole_share(sized.count())
    spread = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / float(1 << 32) * cuts).cast("bigint")
    sized = sized.withColumn("cut", spread)
    parts = stage(sized.groupBy(*SOURCE, "cut").agg(F.sum("size").alias("words")), "mix-parts")
    targets = source_targets(parts.groupBy(*SOURCE).agg(F.sum("words").alias("source_size")), weights, repeats, budget)
    earlier = Window.partitionBy(*SOURCE).orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.withColumn("before", F.coalesce(F.sum("words").over(earlier), F.lit(0))).join(stage(targets, "mix-targets"), SOURCE)
    inside = Window.partitionBy(*SOURCE, "cut").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    placed = sized.join(offsets.drop("words"), [*SOURCE, "cut"])
    queued = placed.select(
        "doc_id", *SOURCE, "size", "source_size", "target", F.when(F.col("size") > 0, start).alias("start")
    )
    return stage(queued, "mix-queues")


def fair_mix(queues: DataFrame, budget: int | None = None) -> DataFrame:
    """The mix in order: one row for each copy of a document that `queues` (see `shuffled_queues`) give to it.

    A source's queue is served again and again, at a rate that reaches its target when the virtual clock shows 1. A copy's
    `finish` is the words of its source up to its end, divided by the target. Copies are range-sorted by that time over all
    sources (`position`: words of the mix before it) and the mix is truncated at the budget (all words if None, at most
    what the targets add up to). The copies being served when the clock shows 1 are cut at what they have got by then
    (`words` less than size), so every source gives its target to within one word, however long its documents are.

    Sources are served evenly, so ranges of equal time hold about equal words and rows; one row of each range crosses
    between them. Columns: those of `queues`, epoch, finish, words, position.
    """
    served = F.floor("target").cast("bigint")
    last = F.floor((served - F.col("start") - 1) / F.col("source_size")).cast("bigint")
    copies = (
        queues.where((F.col("size") > 0) & (served > F.col("start")))
        .withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
        .withColumn("begun", F.col("epoch") * F.col("source_size") + F.col("start"))
        .where(F.col("begun") < served)
        .withColumn("finish", (F.col("begun") + F.col("size")).cast("double") / F.col("target"))
        .withColumn("words", F.least(F.col("size"), served - F.col("begun")))
    )
    ranges = _whole_share(queues.count())
    copies = copies.withColumn("range", F.least(F.floor(F.col("finish") * ranges), F.lit(ranges)).cast("bigint"))
    totals = copies.groupBy("range").agg(F.sum("words").alias("total"))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("range", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("range").orderBy("finish", "unnamed", "source", "epoch", "start")
    running = F.coalesce(F.sum("words").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    mixed = copies.join(offsets, "range").withColumn("position", F.col("before") + running)
    if budget is not None:
        mixed = mixed.where(F.col("position") < budget).withColumn("words", F.least("words", F.lit(budget) - F.col("position")))
    return mixed.select(
        "doc_id", *SOURCE, "size", "source_size", "target", "start", "epoch", "finish", "words", "position"
    )


def words_taken(queues: DataFrame, mix: DataFrame) -> DataFrame:
    """For each row of `queues` the words that `mix` takes of it, repeats counted: doc_id, source (null where there is
    none), size, source_size, target, taken. Each row of documents is one row here, repeated ones too."""
    none = queues.select("doc_id", *SOURCE, "size", "source_size", "target", "start", F.lit(0).cast("bigint").alias("words"))
    row = ["doc_id", *SOURCE, "size", "source_size", "target", "start"]
    served = none.where("start IS NOT NULL").unionByName(mix.select(none.columns)).groupBy(*row).agg(F.sum("words").alias("words"))
    every = served.unionByName(none.where("start IS NULL"))
    source = F.when(~F.col("unnamed"), F.col("source")).alias("source")
    return every.select("doc_id", source, "size", "source_size", "target", F.col("words").alias("taken"))


def mix_sources(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), repeats: int = 3, budget: int | None = None, seed: int = 0
) -> DataFrame:
    """The words a mix of the sources of `docs` (doc_id, text, source) takes of each document; see `fair_mix`.

    Null and empty texts have no words and are taken 0 times. Rows without a source are a source of their own, the last.
    A null doc_id is a value like others. Repeated rows are documents of their own. Other columns are not looked at. An
    empty table gives no rows.
    """
    queues = shuffled_queues(docs, weights, repeats, budget, seed)
    return words_taken(queues, fair_mix(queues, budget))
