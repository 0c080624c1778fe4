import random

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from curbside.operators import blocks, reports


@pytest.fixture(scope="module")
def series(spark):
    rng = random.Random(3)
    rows = []
    for key, n in (("hot", 60), ("cold", 5), ("one", 1)):
        for order in sorted(rng.sample(range(200), n)):
            rows.append((key, order, float(rng.randrange(100))))
    return spark.createDataFrame(rows, "k string, t int, v double"), rows


def by_key(rows):
    out = {}
    for k, t, v in rows:
        out.setdefault(k, []).append((t, v))
    return {k: sorted(x) for k, x in out.items()}


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_totals_index_and_next_row(series, size):
    df, rows = series
    got = blocks.running_total(df, ["k"], "t", "v", "total", size)
    got = blocks.dense_index(got, ["k"], "t", "i", size)
    got = blocks.next_values(got, ["k"], "t", {"after": "v"}, size)
    seen = {(r.k, r.t): (r.total, r.i, r.after) for r in got.collect()}
    assert len(seen) == len(rows)
    for k, items in by_key(rows).items():
        total = 0.0
        for i, (t, v) in enumerate(items):
            total += v
            assert seen[k, t] == (total, i, items[i + 1][1] if i + 1 < len(items) else None)


@pytest.mark.parametrize("size", [4, 7, 1000])
def test_moving_means_match_numpy(series, size):
    df, rows = series
    indexed = blocks.dense_index(df, ["k"], "t", "idx", size)
    trailing = {(r.k, r.t): r.m for r in blocks.moving_mean(indexed, ["k"], "idx", "v", "m", 3, 0, size=size).collect()}
    padded = {(r.k, r.t): r.m for r in blocks.moving_mean(indexed, ["k"], "idx", "v", "m", 2, 1, pad=True, size=size).collect()}
    for k, items in by_key(rows).items():
        values = np.array([v for _, v in items])
        want = np.convolve(np.pad(values, (2, 1), mode="edge"), np.ones(4) / 4, mode="valid")
        assert np.allclose([padded[k, t] for t, _ in items], want)
        if len(values) >= 4:
            valid = np.convolve(values, np.ones(4) / 4, mode="valid")
            assert np.allclose([trailing[k, t] for t, _ in items[3:]], valid)
        assert not any((k, t) in trailing for t, _ in items[:3])


def test_global_series_without_keys(spark):
    df = spark.createDataFrame([(i * 3, float(i)) for i in range(20)], "t int, v double")
    out = blocks.running_total(df, [], "t", "v", "total", 5).orderBy("t").collect()
    assert [r.total for r in out] == list(np.cumsum(np.arange(20.0)))


def test_align_pads_with_the_last_value_and_cuts(spark):
    df = spark.createDataFrame([(0, "1"), (1, "x"), (5, "3"), (9, "NaN")], "Episode int, Revenue string")
    assert [r.value for r in reports.align_series(df, "Episode", "Revenue", 4, 2.0).orderBy("i").collect()] == [2.0, 6.0, 6.0, 6.0]
    assert [r.value for r in reports.align_series(df, "Episode", "Revenue", 1).collect()] == [1.0]


def test_positions_of_sparse_ids_are_dealt_evenly(spark):
    """Ids over all 64 bits: ranges hold about equal numbers of rows, and the positions are those of one window."""
    ids = spark.range(200_000).select(F.xxhash64("id").alias("id")).unionByName(spark.createDataFrame([(None,), (5,)], "id bigint"))
    ranked = blocks.range_rank(ids, ["id"])
    want = ids.withColumn("idx", F.row_number().over(Window.orderBy("id")) - 1)
    assert ranked.count() == 200_002
    assert ranked.select("id", F.col("idx").cast("bigint")).exceptAll(want.select("id", F.col("idx").cast("bigint"))).isEmpty()
    sizes = sorted(r[0] for r in ids.repartitionByRange("id").groupBy(F.spark_partition_id()).count().select("count").collect())
    assert sizes[-1] <= 2 * sizes[len(sizes) // 2]
    words = spark.createDataFrame([("b",), ("a",), (None,), ("é",)], "w string")
    assert {tuple(r) for r in blocks.range_rank(words, ["w"]).collect()} == {(None, 0), ("a", 1), ("b", 2), ("é", 3)}
