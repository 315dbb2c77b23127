"""Figures of operands and products as tables."""

from __future__ import annotations

from statistics import median

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import SLOTS
from ..operators.matrix import Matrix
from ..operators.symbolic import mask_sizes
from ..operators.tiles import tiles


def operand(a: Matrix, name: str, right: bool = False) -> DataFrame:
    """name, key, value of a matrix in tiles: tiles, sparse and dense ones, distinct places, payload, fill, entries a tile at most."""
    t = tiles(a, right).agg(
        F.count(F.lit(1)).alias("tiles"), F.count(F.when(~F.col("dense"), 1)).alias("sparse_tiles"), F.count(F.when(F.col("dense"), 1)).alias("dense_tiles"),
        F.coalesce(F.sum("nnz"), F.lit(0)).alias("places"), F.coalesce(F.sum("span"), F.lit(0)).alias("payload"), F.coalesce(F.max("nnz"), F.lit(0)).alias("most_places"),
    )
    t = t.withColumn("fill", F.coalesce(F.try_divide("places", SLOTS * F.col("tiles")), F.lit(0.0)))
    return unpivoted(t, name)


def product_tiles(a: Matrix, b: Matrix, name: str = "c") -> DataFrame:
    """name, key, value of C in 8 x 8 tiles: tiles that hold entries, entries, fill, entries a tile at most."""
    t = mask_sizes(a, b).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tiles"), F.coalesce(F.sum(F.col("nnz") * F.col("n")), F.lit(0)).alias("entries"), F.coalesce(F.max("nnz"), F.lit(0)).alias("most_entries"))
    return unpivoted(t.withColumn("fill", F.coalesce(F.try_divide("entries", 64 * F.col("tiles")), F.lit(0.0))), name)


def unpivoted(row: DataFrame, name: str) -> DataFrame:
    return row.select(*(F.col(c).cast("double").alias(c) for c in row.columns)).unpivot([], row.columns, "key", "value").select(F.lit(name).alias("name"), "key", "value")


def product(a: Matrix, b: Matrix) -> DataFrame:
    """Both operands' and C's figures in one table."""
    return operand(a, "a").unionByName(operand(b, "b", True)).unionByName(product_tiles(a, b))


def times(samples: list[float]) -> dict[str, float | list[float]]:
    """samples_ms, min_ms, median_ms, max_ms of timed runs."""
    return {"samples_ms": [round(x, 3) for x in samples], "min_ms": round(min(samples), 3), "median_ms": round(median(samples), 3), "max_ms": round(max(samples), 3)}
