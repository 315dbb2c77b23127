"""Fixed-size tiles with bit-mask occupancy: 8 x 4 for the left operand, 4 x 8 for the right one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import SLOTS, TILE_K, TILE_M, bit, div, popcount, popped
from ..functions.ordering import numbered, running
from .matrix import Matrix

#: Unique places from which a tile is stored in full.
DENSE = 24


def keyed(a: Matrix, right: bool = False) -> DataFrame:
    """tile_row, tile_col, slot, v of every entry. Left slots run along rows, right ones down columns."""
    i, k = F.col("i"), F.col("k")
    if right:
        return a.df.select(div(i, TILE_K).alias("tile_row"), div(k, TILE_M).alias("tile_col"), (F.pmod(k, F.lit(TILE_M)) * TILE_K + F.pmod(i, F.lit(TILE_K))).alias("slot"), "v")
    return a.df.select(div(i, TILE_M).alias("tile_row"), div(k, TILE_K).alias("tile_col"), (F.pmod(i, F.lit(TILE_M)) * TILE_K + F.pmod(k, F.lit(TILE_K))).alias("slot"), "v")


def tiles(a: Matrix, right: bool = False, dense: int = DENSE) -> DataFrame:
    """tile_row, tile_col, mask, nnz, dense, span. Equal coordinates count once, zero values count."""
    if not 1 <= dense <= SLOTS:
        raise ValueError("the dense threshold is from 1 to 32")
    out = keyed(a, right).groupBy("tile_row", "tile_col").agg(F.bit_or(bit(F.col("slot"))).alias("mask"))
    out = out.withColumn("nnz", popcount("mask")).withColumn("dense", F.col("nnz") >= dense)
    return out.withColumn("span", F.when(F.col("dense"), F.lit(SLOTS).cast("long")).otherwise(F.col("nnz")))


def totals(t: DataFrame) -> DataFrame:
    """tiles, unique entries, dense tiles, payload slots."""
    return t.agg(F.count(F.lit(1)).alias("tiles"), F.coalesce(F.sum("nnz"), F.lit(0)).alias("entries"), F.count(F.when(F.col("dense"), 1)).alias("dense_tiles"), F.coalesce(F.sum("span"), F.lit(0)).alias("payload"))


def offsets(t: DataFrame) -> DataFrame:
    """``t`` with value_offset: payload slots of the tiles before it, in (tile_row, tile_col) order."""
    return running(t, ["tile_row", "tile_col"], "span", "value_offset")


def row_pointer(t: DataFrame, tile_rows: int) -> DataFrame:
    """r, ptr for r = 0..tile_rows: tiles of the tile rows before r, empty ones included."""
    return row_pointer_of(t.groupBy("tile_row").agg(F.count(F.lit(1)).alias("n")), tile_rows)


def row_pointer_of(counts: DataFrame, tile_rows: int) -> DataFrame:
    """The same from tile_row, n: the tiles of each tile row that has any."""
    every = counts.sparkSession.range(tile_rows + 1).select(F.col("id").alias("r")).join(counts.withColumnRenamed("tile_row", "r"), "r", "left").select("r", F.coalesce("n", F.lit(0)).alias("n"))
    return running(every, ["r"], "n", "ptr").select("r", "ptr")


def axis_sums(t: DataFrame) -> DataFrame:
    """axis, id, tiles, entries of every tile row and tile column that has tiles."""
    one = lambda axis, c: t.groupBy(F.col(c).alias("id")).agg(F.count(F.lit(1)).alias("tiles"), F.sum("nnz").alias("entries")).select(F.lit(axis).alias("axis"), "id", "tiles", "entries")
    return one("row", "tile_row").unionByName(one("column", "tile_col"))


def column_order(t: DataFrame) -> DataFrame:
    """csc_place, tile_row, tile_col, tile_id: tiles by column, with their place in row order."""
    by_row = numbered(t.select("tile_row", "tile_col"), ["tile_row", "tile_col"], "tile_id")
    return numbered(by_row, ["tile_col", "tile_row"], "csc_place")


def payload(a: Matrix, right: bool = False, dense: int = DENSE) -> DataFrame:
    """tile_row, tile_col, place, slot, v: stored values; dense tiles have all 32 slots, others only set ones."""
    t = tiles(a, right, dense)
    values = keyed(a, right).groupBy("tile_row", "tile_col", "slot").agg(F.sum("v").alias("v"))
    slots = t.select("tile_row", "tile_col", "mask", "dense", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SLOTS - 1).cast("long"))).alias("slot"))
    slots = slots.where(F.col("dense") | (F.getbit("mask", F.col("slot").cast("int")) == 1))
    place = F.when(F.col("dense"), F.col("slot")).otherwise(popped(F.col("mask"), F.col("slot")))
    return slots.withColumn("place", place).join(values, ["tile_row", "tile_col", "slot"], "left").select("tile_row", "tile_col", "place", "slot", F.coalesce("v", F.lit(0.0)).alias("v"))


def packed(a: Matrix, right: bool = False, dense: int = DENSE) -> DataFrame:
    """Tiles with their payload as an array of at most 32 values."""
    stored = payload(a, right, dense).groupBy("tile_row", "tile_col").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "v"))), lambda s: s["v"]).alias("payload"))
    return tiles(a, right, dense).join(stored, ["tile_row", "tile_col"])


def value(slot: Column) -> Column:
    """Of a packed tile: the value at a slot, 0 where nothing is stored."""
    place = popped(F.col("mask"), slot).cast("int") + 1
    return F.when(F.col("span") == SLOTS, F.element_at("payload", slot.cast("int") + 1)).when(F.getbit("mask", slot.cast("int")) == 0, F.lit(0.0)).otherwise(F.try_element_at("payload", place))


def entries(p: DataFrame, m: int, n: int, right: bool = False) -> Matrix:
    """Packed tiles back to entries: the set places inside the matrix."""
    s = F.col("slot")
    slots = p.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SLOTS - 1).cast("long")))).where(F.getbit("mask", s.cast("int")) == 1)
    minor, major = F.pmod(s, F.lit(TILE_K)), div(s, TILE_K)
    i, k = (F.col("tile_row") * TILE_K + minor, F.col("tile_col") * TILE_M + major) if right else (F.col("tile_row") * TILE_M + major, F.col("tile_col") * TILE_K + minor)
    return Matrix(slots.select(i.alias("i"), k.alias("k"), value(s).alias("v")).where((F.col("i") < m) & (F.col("k") < n)), m, n)


def squares(a: Matrix, by_column: bool = False) -> DataFrame:
    """16 x 16 tiles: tile_row, tile_col, r, mask of each non-empty row (or column), the first place in the highest bit."""
    i, k = (F.col("k"), F.col("i")) if by_column else (F.col("i"), F.col("k"))
    key = a.df.select(div("i", 16).alias("tile_row"), div("k", 16).alias("tile_col"), F.pmod(i, F.lit(16)).alias("r"), (15 - F.pmod(k, F.lit(16))).alias("b"))
    return key.groupBy("tile_row", "tile_col", "r").agg(F.bit_or(bit(F.col("b"))).alias("mask"))
