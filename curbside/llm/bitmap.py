"""A bitmap of hashes, of fixed size, that tells which rows cannot be among those wanted."""

from __future__ import annotations

import numpy as np
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

#: Bits of the map: 16 MB on the driver and on each executor, whatever the number of rows.
BITS = 27


def place(*cols: str) -> Column:
    """Where a key stands in the map."""
    return F.xxhash64(*cols).bitwiseAND(F.lit((1 << BITS) - 1))


def bitmap(df: DataFrame, *cols: str) -> Broadcast:
    """The places of all keys of `df`. A place that is not set belongs to no key; one that is set may belong
    to another key, so what passes must still be joined. More keys cost more rows that pass, never a row."""
    spot = df.select(place(*cols).alias("p"))
    bit = F.expr("shiftleft(1L, cast(p & 63 as int))")
    words = spot.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(bit).alias("b")).toArrow()
    out = np.zeros(1 << (BITS - 6), np.uint64)
    out[words["w"].to_numpy()] = words["b"].to_numpy().view(np.uint64)
    return df.sparkSession.sparkContext.broadcast(out)


def passes(map_: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Which of the places are set."""
    return (map_[places >> 6] >> (places & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
