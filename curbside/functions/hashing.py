"""Repeatable pseudo-random numbers from row keys, never from `rand()`."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

HEX_DIGITS = 13  # 52 bits, exact in a double


def key_hash(*keys, seed: int = 42) -> Column:
    """52-bit hash of the row key and the seed."""
    cols = [k if isinstance(k, Column) else F.col(k) for k in keys]
    text = F.concat_ws(":", *[c.cast("string") for c in cols], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, HEX_DIGITS), 16, 10).cast("bigint")


def unit_hash(*keys, seed: int = 42) -> Column:
    """Uniform number in [0, 1) fixed by the row key and the seed."""
    return key_hash(*keys, seed=seed) / F.lit(float(16**HEX_DIGITS))
