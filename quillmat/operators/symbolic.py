"""Structure of a product from tiles alone."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import TILE_K, TILE_M, bit, div
from ..functions.ordering import Tables
from . import blocks
from .matrix import Matrix
from .product import deal, group_messages, grouped, structure, structure_count, structure_in_blocks, structure_messages
from .tiles import tiles


def coarse(a: Matrix, rows: int, inner: int) -> Matrix:
    """The places of tiles of rows x inner ids that hold entries, as a matrix of ones."""
    df = a.df.select(div("i", rows).alias("i"), div("k", inner).alias("k")).distinct().withColumn("v", F.lit(1.0))
    return Matrix(df, -(-a.m // rows), -(-a.n // inner))


def match_counts(a: Matrix, b: Matrix) -> DataFrame:
    """tile_row, tile_col, matches: how many inner tiles a tile row and a tile column share, where any."""

    def counted(i: np.ndarray, j: np.ndarray, v: np.ndarray) -> pa.Table:
        return pa.table({"tile_row": i, "tile_col": j, "matches": v.astype(np.int64)})

    left, right = coarse(a, TILE_M, TILE_K), coarse(b, TILE_K, TILE_M)
    return grouped(left, right, deal(left, right), finish=counted, schema="tile_row long, tile_col long, matches long")


def pair_counts(a: Matrix, b: Matrix) -> DataFrame:
    """nnz_a, nnz_b, n: how many tile pairs that share an inner tile have so many places. Pairs are never rows of their own."""
    left = tiles(a).groupBy(F.col("tile_col").alias("tk"), F.col("nnz").alias("nnz_a")).agg(F.count(F.lit(1)).alias("x"))
    right = tiles(b, right=True).groupBy(F.col("tile_row").alias("tk"), F.col("nnz").alias("nnz_b")).agg(F.count(F.lit(1)).alias("y"))
    return left.join(right, "tk").groupBy("nnz_a", "nnz_b").agg(F.sum(F.col("x") * F.col("y")).alias("n"))


def candidates(a: Matrix, b: Matrix) -> DataFrame:
    """tile_row, tile_col of output tiles that may hold entries. Only coordinates meet, no masks."""
    return structure(coarse(a, TILE_M, TILE_K), coarse(b, TILE_K, TILE_M)).toDF("tile_row", "tile_col")


def parent_operands(a: Matrix, b: Matrix) -> tuple[Matrix, Matrix]:
    """The 16 x 16 parents of both operands, kept: counts and blocks read them again."""
    tables = Tables(a.df.sparkSession)
    keep = lambda name, m: Matrix(tables.put(name, m.df.select("i", "k")).withColumn("v", F.lit(1.0)), m.m, m.n)
    return keep("left", coarse(a, 16, 16)), keep("right", coarse(b, 16, 16))


def parents(a: Matrix, b: Matrix) -> DataFrame:
    """parent_row, parent_col of the pairs of 16 x 16 parents that share an inner one, each once."""
    return structure(*parent_operands(a, b)).toDF("parent_row", "parent_col")


def mask_rows(i: np.ndarray, j: np.ndarray, v=None) -> pa.Table:
    """tile_row, tile_col, mask_lo, mask_hi, nnz of the 8 x 8 tiles of coordinates."""
    row, col = i // TILE_M, j // TILE_M
    order = np.lexsort((col, row))
    row, col, i, j = row[order], col[order], i[order], j[order]
    first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (col[1:] != col[:-1]))[: len(row)])
    at = np.int64(1) << (i % 4 * 8 + j % TILE_M)
    n = np.diff(np.append(first, len(row)))
    halves = [np.bitwise_or.reduceat(np.where((i % TILE_M < 4) == low, at, 0), first) if len(first) else at for low in (True, False)]
    return pa.table({"tile_row": row[first], "tile_col": col[first], "mask_lo": halves[0], "mask_hi": halves[1], "nnz": n.astype(np.int64)})


def exact_masks(a: Matrix, b: Matrix) -> DataFrame:
    """tile_row, tile_col, mask_lo (rows 0-3), mask_hi (rows 4-7), nnz of the output tiles that hold entries."""
    return structure_in_blocks(a, b, mask_rows, "tile_row long, tile_col long, mask_lo long, mask_hi long, nnz long")


def tile_counts(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tile rows of the 8 x 8 tiles of distinct coordinates, by row and column, and how many each tile holds."""
    wide = np.int64(j.max(initial=0) // TILE_M + 1)
    tile, n = np.unique(i // TILE_M * wide + j // TILE_M, return_counts=True)
    return tile // wide, n


def mask_sizes(a: Matrix, b: Matrix) -> DataFrame:
    """nnz, n: how many output tiles hold so many entries."""

    def sizes(i: np.ndarray, j: np.ndarray, v=None) -> pa.Table:
        nnz, n = np.unique(tile_counts(i, j)[1], return_counts=True)
        return pa.table({"nnz": nnz.astype(np.int64), "n": n.astype(np.int64)})

    return structure_in_blocks(a, b, sizes, "nnz long, n long").groupBy("nnz").agg(F.sum("n").alias("n"))


def tile_rows_held(a: Matrix, b: Matrix) -> DataFrame:
    """tile_row, tiles, nnz: of each tile row of C that has any, its tiles and their entries. Tiles are no rows before."""

    def held(i: np.ndarray, j: np.ndarray, v=None) -> pa.Table:
        row, n = tile_counts(i, j)
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1])[: len(row)])
        nnz = np.add.reduceat(n, first) if len(first) else n
        return pa.table({"tile_row": row[first].astype(np.int64), "tiles": np.diff(np.append(first, len(row))).astype(np.int64), "nnz": nnz.astype(np.int64)})

    return structure_in_blocks(a, b, held, "tile_row long, tiles long, nnz long").groupBy("tile_row").agg(F.sum("tiles").alias("tiles"), F.sum("nnz").alias("nnz"))


def children(a: Matrix, b: Matrix) -> DataFrame:
    """parent_row, parent_col, children (0 to 4 output tiles that hold entries) of every candidate parent.

    Which tiles hold entries needs tile rows of A and tile columns of B alone, no single rows or columns of C. Tiles and
    candidates meet in the blocks of one grid, so neither are rows before.
    """
    left, right = coarse(a, TILE_M, 1), coarse(b, 1, TILE_M)
    tiles_, grid = group_messages(left, right, deal(left, right), None)
    two = grid.coarser(2)
    sent = structure_messages(*parent_operands(a, b), two)

    def counted(tile_rows: pa.Table, parent_rows_: pa.Table) -> pa.Table:
        i, j, _ = blocks.combine(tile_rows, None, grid)
        row, col, _ = blocks.combine(parent_rows_, None, two)
        wide = np.int64(two.n + 1)
        held, n = np.unique(i // 2 * wide + j // 2, return_counts=True)
        key = row * wide + col
        at = np.searchsorted(held, key)
        at[at == len(held)] = 0
        kids = np.where(held[at] == key, n[at], 0) if len(held) else np.zeros(len(key), np.int64)
        return pa.table({"parent_row": row, "parent_col": col, "children": kids.astype(np.int64)})

    return blocks.together([tiles_, sent], two, counted, "parent_row long, parent_col long, children long")


def raw_pairs(a: Matrix, b: Matrix) -> DataFrame:
    """raw_pairs, parents: pairs of parents that share an inner one, from counts alone, and how many different ones."""
    left, right = parent_operands(a, b)
    made = deal(left, right)
    return structure_count(left, right, made).select(F.lit(made.pairs).cast("long").alias("raw_pairs"), F.col("nnz_c").alias("parents"))


def parent_rows(a: Matrix) -> DataFrame:
    """parent_row, parent_col, r, bits: occupied columns of each row of the 16 x 16 parents."""
    key = a.df.select(div("i", 16).alias("parent_row"), div("k", 16).alias("parent_col"), F.pmod(F.col("i"), F.lit(16)).alias("r"), F.pmod(F.col("k"), F.lit(16)).alias("c"))
    return key.groupBy("parent_row", "parent_col", "r").agg(F.bit_or(bit(F.col("c"))).alias("bits"))


def parent_children(a: Matrix, right: bool = False) -> DataFrame:
    """parent_row, parent_col, child_mask: which leaf tiles a parent holds."""
    rows, cols = (4, 2) if right else (2, 4)
    slot = F.pmod(F.col("tile_row"), F.lit(rows)) * cols + F.pmod(F.col("tile_col"), F.lit(cols))
    return tiles(a, right).groupBy(div("tile_row", rows).alias("parent_row"), div("tile_col", cols).alias("parent_col")).agg(F.bit_or(bit(slot)).alias("child_mask"))


def invariants(a: Matrix, b: Matrix) -> DataFrame:
    """candidates, nonempty, children, and whether nonempty <= children <= 4 * nonempty."""
    sums = children(a, b).agg(F.count(F.lit(1)).alias("candidates"), F.count(F.when(F.col("children") > 0, 1)).alias("nonempty"), F.coalesce(F.sum("children"), F.lit(0)).alias("children"))
    return sums.withColumn("holds", (F.col("nonempty") <= F.col("children")) & (F.col("children") <= 4 * F.col("nonempty")))


def numeric_rows(i: np.ndarray, j: np.ndarray, v: np.ndarray) -> pa.Table:
    row, col, slot = i // 8, j // 8, i % 8 * 8 + j % 8
    order = np.lexsort((slot, col, row))
    row, col, slot, v = row[order], col[order], slot[order], v[order]
    first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (col[1:] != col[:-1]))[: len(row)])
    place = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
    return pa.table({"tile_row": row, "tile_col": col, "slot": slot, "place": place, "v": v})


def numeric(a: Matrix, b: Matrix) -> DataFrame:
    """tile_row, tile_col, slot, place, v: output tiles with their values in place order (slot = row * 8 + column)."""
    return grouped(a, b, deal(a, b), finish=numeric_rows, schema="tile_row long, tile_col long, slot long, place long, v double")


def row_work(a: Matrix, b: Matrix) -> DataFrame:
    """tile_row, degree, pairs, candidates: a tile row's inner tiles, the tile pairs they meet, output tiles at most."""
    right = tiles(b, right=True).groupBy(F.col("tile_row").alias("tk")).agg(F.count(F.lit(1)).alias("fan"))
    rows = tiles(a).select("tile_row", F.col("tile_col").alias("tk")).join(right, "tk", "left")
    rows = rows.groupBy("tile_row").agg(F.count(F.lit(1)).alias("degree"), F.sum(F.coalesce("fan", F.lit(0))).alias("pairs"))
    return rows.withColumn("candidates", F.least("pairs", F.lit((b.n + TILE_M - 1) // TILE_M).cast("long")))
