"""Scalar functions of the engine as column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tile geometry.
TILE_M, TILE_K, TILE_N, SLOTS = 8, 4, 8, 32
#: Increments of the two fingerprint words and of the sketch.
WORD_STEP, SKETCH_BASE, SKETCH_STEP = 0xD1B54A32D192ED03, 0x243F6A8885A308D3, 0x9E3779B97F4A7C15
LONG_MAX = (1 << 63) - 1


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def div(x: Column | str, d: int) -> Column:
    """Integer division of longs below 2**53 by a positive number, rounding down."""
    return F.floor(col(x) / F.lit(d)).cast("long")


def ceil_div(x: Column | str, d: int) -> Column:
    return div(col(x) + (d - 1), d)


def popcount(x: Column | str) -> Column:
    return F.bit_count(col(x)).cast("long")


def first_set(x: Column | str) -> Column:
    """Place of the lowest set bit; null for 0."""
    x = col(x)
    low = x.bitwiseAND(F.bitwise_not(x - 1))
    return F.when(x != 0, F.when(x == -LONG_MAX - 1, F.lit(63)).otherwise(F.bit_count(low - 1))).cast("long")


def log2_floor(x: Column | str) -> Column:
    """Exact for positive longs."""
    return (F.length(F.bin(col(x))) - 1).cast("long")


def soft_bucket(degree: Column | str) -> Column:
    return F.when(col(degree) <= 0, F.lit(-1).cast("long")).otherwise(div(log2_floor(degree), 2))


def degree_bucket(degree: Column | str, most: int = 7) -> Column:
    return F.when(col(degree) <= 1, F.lit(0).cast("long")).otherwise(F.least(log2_floor(degree), F.lit(most).cast("long")))


def saturating_add(a: Column, b: Column) -> Column:
    """Of non-negative longs."""
    return F.coalesce(F.try_add(a, b), F.lit(LONG_MAX))


def saturating_multiply(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_multiply(a, b), F.lit(LONG_MAX))


def heat_bin(index: Column | str, extent: int, bins: int) -> Column:
    return F.least(F.lit(bins - 1).cast("long"), div(col(index) * bins, max(1, extent)))


def gflops(products: Column, ms: Column) -> Column:
    return 2 * products / (ms * 1e6)


def compression(products: Column, nnz: Column) -> Column:
    return products / nnz


def popped(mask: Column, slot: Column) -> Column:
    """Set bits of ``mask`` below ``slot``."""
    return F.bit_count(mask.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), slot.cast("int")) - 1)).cast("long")


def bit(slot: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), slot.cast("int"))


def mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix finaliser on 64-bit words, wrapping around."""
    z = x.astype(np.int64).view(np.uint64) + np.uint64(SKETCH_STEP)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z ^ (z >> np.uint64(31))).view(np.int64)


@F.pandas_udf(T.LongType())
def mix64(x: pd.Series) -> pd.Series:
    return pd.Series(mixed(x.to_numpy()))


def signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def panel_sketches(panels: DataFrame) -> DataFrame:
    """panel, b0, b1 (fingerprint bits of the two words), h0, h1 (sketch hashes) for distinct panels (column panel)."""
    plus = lambda w: F.col("panel") + F.lit(signed(w * WORD_STEP))
    xor = lambda w: F.col("panel").bitwiseXOR(F.lit(signed(SKETCH_BASE + w * SKETCH_STEP)))
    hashed = panels.select("panel", mix64(plus(0)).alias("m0"), mix64(plus(1)).alias("m1"), mix64(xor(0)).alias("h0"), mix64(xor(1)).alias("h1"))
    return hashed.select("panel", *(F.col(f"m{w}").bitwiseAND(F.lit(63)).cast("int").alias(f"b{w}") for w in (0, 1)), "h0", "h1")
