"""The registered queries and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as fn
from ..functions.ordering import Tables, medians, shared_dir
from ..operators import planner, product, reorder, symbolic, tiles
from ..operators.matrix import Matrix
from ..sources import mtx
from . import data, report
from .data import SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL where there is one."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def w(*names: str) -> str:
    return "WITH " + ", ".join(SQL.get(n, n) for n in names) + " "


def tile_sql(m: str, name: str, right: bool = False) -> str:
    slot = "(k % 8) * 4 + i % 4" if right else "(i % 8) * 4 + k % 4"
    row, col = ("i // 4", "k // 8") if right else ("i // 8", "k // 4")
    return f"{name} AS (SELECT {row} AS tile_row, {col} AS tile_col, bit_or(1::BIGINT << ({slot})::INT) AS mask, bit_count(bit_or(1::BIGINT << ({slot})::INT))::BIGINT AS nnz FROM {m} GROUP BY ALL)"


FULL = "SELECT tile_row, tile_col, mask, nnz, nnz >= 24 AS dense, CASE WHEN nnz >= 24 THEN 32 ELSE nnz END::BIGINT AS span"
#: Output tiles of sp x its transpose, through entries.
SPT = "spt AS (SELECT k AS i, i AS k, v FROM sp)"
CELLS = "cells AS (SELECT DISTINCT a.i AS i, b.k AS k FROM sp a JOIN spt b ON a.k = b.i)"
#: Work of the output tiles of sp x spt, from its lists of inner tiles.
WORK = """out AS (SELECT i // 8 AS tile_row, k // 8 AS tile_col, count(*) AS output_nnz FROM cells GROUP BY ALL),
    la AS (SELECT DISTINCT i // 8 AS tile_row, k // 4 AS tk FROM sp), lb AS (SELECT DISTINCT i // 4 AS tk, k // 8 AS tile_col FROM spt),
    ends AS (SELECT tile_row, tile_col, output_nnz, least((SELECT max(tk) FROM la WHERE la.tile_row = out.tile_row), (SELECT max(tk) FROM lb WHERE lb.tile_col = out.tile_col)) AS m FROM out),
    work AS (SELECT tile_row, tile_col, output_nnz, (SELECT count(*) FROM la JOIN lb USING (tk) WHERE la.tile_row = ends.tile_row AND lb.tile_col = ends.tile_col) AS matches,
        (SELECT count(*) FROM la WHERE la.tile_row = ends.tile_row AND tk <= m) + (SELECT count(*) FROM lb WHERE lb.tile_col = ends.tile_col AND tk <= m) AS steps,
        (SELECT count(*) FROM la WHERE la.tile_row = ends.tile_row) + (SELECT count(*) FROM lb WHERE lb.tile_col = ends.tile_col) AS steps_union FROM ends)"""


def both_ways(spark: SparkSession, folder: str) -> tuple[Matrix, Matrix]:
    """Structure of supplier x part (entries are 1), merged once and kept, and its transpose: counts, groups and lists read it again."""
    a = data.supplier_part(spark, folder)
    a = Matrix(Tables(spark).put("entries", a.df.select("i", "k")).withColumn("v", F.lit(1.0)), a.m, a.n)
    return a, a.transpose()


# products


@query(w("sp") + "SELECT a.i, b.i AS k, sum(a.v * b.v) AS v FROM sp a JOIN sp b ON a.k = b.k GROUP BY ALL")
def spgemm_aat_sp(spark, folder):
    return product.multiply(data.supplier_part(spark, folder), "aat").df


@query(w("op", "ps") + "SELECT a.i, b.k, sum(a.v * b.v) AS v FROM op a JOIN ps b ON a.k = b.i GROUP BY ALL")
def spgemm_ab_op_ps(spark, folder):
    return product.multiply(data.order_part(spark, folder), "ab", data.supplier_part(spark, folder).transpose()).df


@query(w("pp") + "SELECT a.i, b.k, sum(a.v * b.v) AS v FROM pp a JOIN pp b ON a.k = b.i GROUP BY ALL")
def spgemm_aa_pp(spark, folder):
    return product.multiply(data.part_succession(spark, folder), "aa").df


@query(w("op") + "SELECT a.k AS i, b.k, sum(a.v * b.v) AS v FROM op a JOIN op b ON a.i = b.i GROUP BY ALL")
def spgemm_ata_op(spark, folder):
    return product.multiply(data.order_part(spark, folder).transpose(), "aat").df


@query(w("sp") + "SELECT a.i, b.i AS k, sum(a.v * b.v) AS v FROM sp a JOIN sp b ON a.k = b.k GROUP BY ALL")
def split_accumulate_sp(spark, folder):
    """By a join in which every part of more than 125 pairs is cut on both sides."""
    a = data.supplier_part(spark, folder)
    return product.multiply_split(a, a.transpose(), most=500).df


@query(w("sp") + "SELECT a.i, b.i AS k, sum(a.v * b.v) AS v FROM sp a JOIN sp b ON a.k = b.k GROUP BY ALL")
def split_groups_sp(spark, folder):
    """In groups of some 3000 pairs, in which parts of more than a quarter are cut on both sides."""
    return product.multiply(data.supplier_part(spark, folder), "aat", most=3000).df


@query(w("op") + "SELECT DISTINCT a.k AS i, b.k AS j FROM op a JOIN op b ON a.i = b.i")
def spgemm_structure_op(spark, folder):
    a = data.order_part(spark, folder)
    return product.structure(a.transpose(), a)


@query(w("op") + "SELECT p.p_partkey AS i, count(DISTINCT b.k) AS nnz FROM part p LEFT JOIN op a ON a.k = p.p_partkey LEFT JOIN op b ON a.i = b.i GROUP BY ALL")
def row_nnz_c(spark, folder):
    a = data.order_part(spark, folder)
    return product.row_sizes(a.transpose(), a)


@query(w("sl") + "SELECT sum(n * n)::BIGINT AS nnz_cub FROM (SELECT k, count(*) AS n FROM sl GROUP BY k)")
def nnz_cub_aat(spark, folder):
    a = data.supplier_part(spark, folder, merged=False)
    return product.product_count(a, a.transpose())


@query(w("op", "ps") + "SELECT count(*) AS nnz_cub FROM op JOIN ps ON op.k = ps.i")
def nnz_cub_ab(spark, folder):
    return product.product_count(data.order_part(spark, folder), data.supplier_part(spark, folder).transpose())


@query(w("pp") + "SELECT count(*) AS nnz_cub FROM pp a JOIN pp b ON a.k = b.i")
def nnz_cub_aa(spark, folder):
    a = data.part_succession(spark, folder)
    return product.product_count(a, a)


@query(w("sp") + "SELECT a.i, count(*) AS products FROM sp a JOIN sp b ON a.k = b.k GROUP BY a.i")
def row_products(spark, folder):
    a = data.supplier_part(spark, folder)
    return product.row_product_counts(a, a.transpose())


@query(w("sp", SPT, CELLS, "p AS (SELECT count(*) AS nnz_cub FROM sp a JOIN spt b ON a.k = b.i)") + "SELECT nnz_cub, (SELECT count(*) FROM cells) AS nnz_c, nnz_cub / (SELECT count(*) FROM cells) AS compression, 2 * nnz_cub / (8.0 * 1e6) AS gflops_at_8_ms FROM p")
def compression(spark, folder):
    a, b = both_ways(spark, folder)
    both = product.product_count(a, b).withColumn("_x", F.lit(1)).join(product.structure_count(a, b).withColumn("_x", F.lit(1)), "_x")
    return both.select("nnz_cub", "nnz_c", fn.compression(F.col("nnz_cub"), F.col("nnz_c")).alias("compression"), fn.gflops(F.col("nnz_cub"), F.lit(8.0)).alias("gflops_at_8_ms"))


@query(w("sp") + "SELECT a.i, b.i AS k, min(a.v + b.v) AS v FROM sp a JOIN sp b ON a.k = b.k GROUP BY ALL")
def semiring_minplus(spark, folder):
    return product.multiply(data.supplier_part(spark, folder), "aat", semiring=product.MIN_PLUS).df


@query(w("sp") + "SELECT a.i, b.i AS k, max(least(a.v, b.v)) AS v FROM sp a JOIN sp b ON a.k = b.k GROUP BY ALL")
def semiring_maxmin(spark, folder):
    return product.multiply(data.supplier_part(spark, folder), "aat", semiring=product.MAX_MIN).df


@query(w("sp") + "SELECT a.i, b.i AS k, max(CASE WHEN a.v <> 0 AND b.v <> 0 THEN 1.0::DOUBLE ELSE 0 END) AS v FROM sp a JOIN sp b ON a.k = b.k GROUP BY ALL")
def semiring_bool(spark, folder):
    return product.multiply(data.supplier_part(spark, folder), "aat", semiring=product.BOOLEAN).df


@query(w("sp", SPT, CELLS, "t AS (SELECT DISTINCT i, k FROM sp)") + "SELECT 'left' AS side, i, k AS j FROM (SELECT * FROM cells EXCEPT SELECT * FROM t) UNION ALL SELECT 'right', i, k FROM (SELECT * FROM t EXCEPT SELECT * FROM cells)")
def structural_difference(spark, folder):
    a, b = both_ways(spark, folder)
    return product.difference(a, b, a.df.select("i", F.col("k").alias("j")).distinct())


# layout


@query(w("sp") + "SELECT k AS i, i AS k, v FROM sp")
def transpose(spark, folder):
    return data.supplier_part(spark, folder).transpose().df


@query(w("sp") + "SELECT * FROM sp")
def dedup(spark, folder):
    return data.supplier_part(spark, folder, merged=False).merged().df


@query(w("pp") + "SELECT i, k, v FROM pp UNION ALL SELECT k, i, v FROM pp WHERE i <> k")
def symmetrize(spark, folder):
    return data.part_succession(spark, folder).symmetrised("symmetric").df


@query(w("sl") + "SELECT count(*) AS entries, count(*) FILTER (WHERE i < 0 OR i >= (SELECT count(*) FROM supplier) OR k < 0 OR k >= (SELECT count(*) FROM part) - 7) AS faults FROM sl")
def validate_counts(spark, folder):
    a = data.supplier_part(spark, folder, merged=False)
    narrow = Matrix(a.df, a.m, a.n - 7)
    return a.df.agg(F.count(F.lit(1)).alias("entries")).withColumn("_x", F.lit(1)).join(narrow.faults().agg(F.count(F.lit(1)).alias("faults")).withColumn("_x", F.lit(1)), "_x").drop("_x")


@query(w("sp") + "SELECT i, k, ((row_number() OVER (ORDER BY i, k, v) - 1) % 10)::DOUBLE AS v FROM sp")
def sequential_values(spark, folder):
    return data.supplier_part(spark, folder).sequential().df


@query(w("sl") + "SELECT r.range AS r, (SELECT count(*) FROM sl WHERE i < r.range) AS ptr FROM range((SELECT count(*) + 1 FROM supplier)) r")
def row_pointer(spark, folder):
    return data.supplier_part(spark, folder, merged=False).row_pointer()


@query(w("ol") + "SELECT 'row' AS axis, i AS id, count(*) AS degree FROM ol GROUP BY i UNION ALL SELECT 'inner', k, count(*) FROM ol GROUP BY k")
def axis_degrees(spark, folder):
    a = data.order_part(spark, folder, merged=False)
    return a.row_counts().select(F.lit("row").alias("axis"), F.col("i").alias("id"), F.col("entries").alias("degree")).unionByName(a.column_counts().select(F.lit("inner").alias("axis"), F.col("k").alias("id"), F.col("entries").alias("degree")))


# tiles


@query(w("sp", tile_sql("sp", "t")) + FULL + " FROM t")
def tile_a_8x4(spark, folder):
    return tiles.tiles(data.supplier_part(spark, folder))


@query(w("sp", tile_sql("sp", "t", True)) + FULL + " FROM t")
def tile_b_4x8(spark, folder):
    return tiles.tiles(data.supplier_part(spark, folder), right=True)


@query(w("sp", tile_sql("sp", "t"), "u AS (" + FULL + " FROM t)") + "SELECT count(*) AS tiles, sum(nnz)::BIGINT AS entries, count(*) FILTER (WHERE dense) AS dense_tiles, sum(span)::BIGINT AS payload FROM u")
def tile_totals(spark, folder):
    return tiles.totals(tiles.tiles(data.supplier_part(spark, folder)))


@query(w("sp", tile_sql("sp", "t"), "u AS (" + FULL + " FROM t)") + "SELECT tile_row, tile_col, mask, nnz, dense, span, coalesce(sum(span) OVER (ORDER BY tile_row, tile_col ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS value_offset FROM u")
def tile_value_offsets(spark, folder):
    return tiles.offsets(tiles.tiles(data.supplier_part(spark, folder)))


@query(w("op", tile_sql("op", "t"), "n AS (SELECT tile_row, count(*) AS n FROM t GROUP BY 1)") + "SELECT r.range AS r, coalesce(sum(n) OVER (ORDER BY r.range ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ptr FROM range((SELECT (count(*) + 7) // 8 + 1 FROM orders)) r LEFT JOIN n ON n.tile_row = r.range")
def tile_row_ptr(spark, folder):
    a = data.order_part(spark, folder)
    return tiles.row_pointer(tiles.tiles(a), (a.m + 7) // 8)


@query(w("sp", tile_sql("sp", "t", True)) + "SELECT tile_row, tile_col, row_number() OVER (ORDER BY tile_row, tile_col) - 1 AS tile_id, row_number() OVER (ORDER BY tile_col, tile_row) - 1 AS csc_place FROM t")
def tile_csc_order(spark, folder):
    return tiles.column_order(tiles.tiles(data.supplier_part(spark, folder), right=True))


PAYLOAD = tile_sql("sp", "t"), "e AS (SELECT i // 8 AS tile_row, k // 4 AS tile_col, (i % 8) * 4 + k % 4 AS slot, v FROM sp)"


@query(w("sp", *PAYLOAD) + """SELECT tile_row, tile_col, CASE WHEN nnz >= 24 THEN s.range ELSE bit_count(mask & ((1::BIGINT << s.range::INT) - 1)) END::BIGINT AS place, s.range AS slot, coalesce(e.v, 0) AS v
    FROM t CROSS JOIN range(32) s LEFT JOIN e USING (tile_row, tile_col) WHERE e.slot = s.range OR nnz >= 24 AND e.slot IS NULL
    UNION ALL SELECT t.tile_row, t.tile_col, s.range, s.range, 0 FROM t CROSS JOIN range(32) s WHERE nnz >= 24 AND (mask >> s.range::INT) & 1 = 0""")
def tile_payload(spark, folder):
    return tiles.payload(data.supplier_part(spark, folder))


@query(w("sp") + "SELECT i, k, v FROM sp")
def tile_decode(spark, folder):
    a = data.supplier_part(spark, folder)
    return tiles.entries(tiles.packed(a), a.m, a.n).df


@query(w("sp") + "SELECT i, k, v FROM sp")
def tile_decode_right(spark, folder):
    a = data.supplier_part(spark, folder)
    return tiles.entries(tiles.packed(a, right=True), a.m, a.n, right=True).df


@query(w("sp") + "SELECT i // 16 AS tile_row, k // 16 AS tile_col, i % 16 AS r, bit_or(1::BIGINT << (15 - k % 16)::INT) AS mask FROM sp GROUP BY ALL")
def tile16_rows(spark, folder):
    return tiles.squares(data.supplier_part(spark, folder))


@query(w("sp") + "SELECT i // 16 AS tile_row, k // 16 AS tile_col, k % 16 AS r, bit_or(1::BIGINT << (15 - i % 16)::INT) AS mask FROM sp GROUP BY ALL")
def tile16_columns(spark, folder):
    return tiles.squares(data.supplier_part(spark, folder), by_column=True)


# structure of products


@query(w("op") + "SELECT DISTINCT a.k // 8 AS tile_row, b.k // 8 AS tile_col FROM (SELECT DISTINCT i // 4 AS t, k // 8 * 8 AS k FROM op) a JOIN (SELECT DISTINCT i // 4 AS t, k // 8 * 8 AS k FROM op) b USING (t)")
def cand_tiles(spark, folder):
    a = data.order_part(spark, folder)
    return symbolic.candidates(a.transpose(), a)


PARENTS = "pa AS (SELECT DISTINCT i // 16 AS parent_row, k // 16 AS pk FROM sp), pb AS (SELECT DISTINCT k // 16 AS pk, i // 16 AS parent_col FROM sp)"


@query(w("sp", PARENTS) + "SELECT DISTINCT parent_row, parent_col FROM pa JOIN pb USING (pk)")
def cand_parents(spark, folder):
    return symbolic.parents(*both_ways(spark, folder))


@query(w("sp", PARENTS) + "SELECT count(*) AS raw_pairs, count(DISTINCT (parent_row, parent_col)) AS parents, count(DISTINCT (parent_row, parent_col)) <= 16000000 AND count(*) <= 16 * count(DISTINCT (parent_row, parent_col)) AS admitted FROM pa JOIN pb USING (pk)")
def raw_pairs(spark, folder):
    pairs = symbolic.raw_pairs(*both_ways(spark, folder))
    return pairs.withColumn("admitted", planner.admission(F.col("parents"), F.col("raw_pairs")))


EXACT = "SELECT i // 8 AS tile_row, k // 8 AS tile_col, coalesce(bit_or(1::BIGINT << ((i % 4) * 8 + k % 8)::INT) FILTER (WHERE i % 8 < 4), 0) AS mask_lo, coalesce(bit_or(1::BIGINT << ((i % 4) * 8 + k % 8)::INT) FILTER (WHERE i % 8 >= 4), 0) AS mask_hi, count(*) AS nnz FROM {} GROUP BY ALL"


@query(w("op", "c AS (SELECT DISTINCT a.k AS i, b.k FROM op a JOIN op b ON a.i = b.i)") + EXACT.format("c"))
def exact_mask(spark, folder):
    a = data.order_part(spark, folder)
    return symbolic.exact_masks(a.transpose(), a)


@query(w("op", "c AS (SELECT DISTINCT a.k AS i, b.k FROM op a JOIN op b ON a.i = b.i)") + "SELECT i // 8 AS tile_row, count(DISTINCT k // 8) AS tiles, count(*) AS nnz FROM c GROUP BY 1")
def c_tile_nnz(spark, folder):
    a = data.order_part(spark, folder)
    return symbolic.tile_rows_held(a.transpose(), a)


@query(w("sp", SPT, CELLS, PARENTS, "q AS (SELECT i // 16 AS parent_row, k // 16 AS parent_col, count(DISTINCT (i // 8, k // 8)) AS children FROM cells GROUP BY ALL)") + "SELECT coalesce(children, 0) AS children, count(*) AS parents FROM (SELECT DISTINCT parent_row, parent_col FROM pa JOIN pb USING (pk)) LEFT JOIN q USING (parent_row, parent_col) GROUP BY 1")
def c16_children_hist(spark, folder):
    return symbolic.children(*both_ways(spark, folder)).groupBy("children").agg(F.count(F.lit(1)).alias("parents"))


@query(w("sp", SPT, CELLS, PARENTS) + "SELECT (SELECT count(*) FROM (SELECT DISTINCT parent_row, parent_col FROM pa JOIN pb USING (pk))) AS candidates, count(DISTINCT (i // 16, k // 16)) AS nonempty, count(DISTINCT (i // 8, k // 8)) AS children, count(DISTINCT (i // 16, k // 16)) <= count(DISTINCT (i // 8, k // 8)) AND count(DISTINCT (i // 8, k // 8)) <= 4 * count(DISTINCT (i // 16, k // 16)) AS holds FROM cells")
def super16_invariants(spark, folder):
    return symbolic.invariants(*both_ways(spark, folder))


@query(w("sp") + "SELECT i // 16 AS parent_row, k // 16 AS parent_col, i % 16 AS r, bit_or(1::BIGINT << (k % 16)::INT) AS bits FROM sp GROUP BY ALL")
def parent_boolean_rows(spark, folder):
    return symbolic.parent_rows(data.supplier_part(spark, folder))


@query(w("sp") + "SELECT i // 16 AS parent_row, k // 16 AS parent_col, bit_or(1::BIGINT << ((i // 8 % 2) * 4 + k // 4 % 4)::INT) AS child_mask FROM sp GROUP BY ALL")
def parent_child_masks(spark, folder):
    return symbolic.parent_children(data.supplier_part(spark, folder))


@query(w("sp", "c AS (SELECT a.i, b.i AS k, sum(a.v * b.v) AS v FROM sp a JOIN sp b ON a.k = b.k GROUP BY ALL)") + "SELECT i // 8 AS tile_row, k // 8 AS tile_col, (i % 8) * 8 + k % 8 AS slot, row_number() OVER (PARTITION BY i // 8, k // 8 ORDER BY i % 8, k % 8) - 1 AS place, v FROM c")
def numeric_tiles_c(spark, folder):
    a = data.supplier_part(spark, folder)
    return symbolic.numeric(a, a.transpose())


@query(w("op", "ta AS (SELECT DISTINCT k // 8 AS tile_row, i // 4 AS tk FROM op)", "f AS (SELECT tk, count(*) AS n FROM ta GROUP BY 1)", "r AS (SELECT tile_row, count(*) AS degree, sum(n)::BIGINT AS work FROM ta JOIN f USING (tk) GROUP BY 1)") + "SELECT tile_row, degree, work FROM r")
def wide_row_classes(spark, folder):
    a = data.order_part(spark, folder)
    return symbolic.row_work(a.transpose(), a).select("tile_row", "degree", F.col("pairs").alias("work"))


# work and splitting

POLICY = planner.TailPolicy(threshold=60.0, target=40.0, heavy_fraction=1.0)


@query(w("sp", SPT, CELLS, WORK) + "SELECT tile_row, tile_col, matches, steps - matches AS scans_trajectory, steps_union - matches AS scans_union, output_nnz, (steps - matches + 8 * matches)::DOUBLE AS splittable, (steps - matches + 8 * matches + 0.25 * output_nnz)::DOUBLE AS \"full\" FROM work")
def tile_work(spark, folder):
    return planner.tile_work(*both_ways(spark, folder))


CHUNKS = "ch AS (SELECT *, steps_union - matches + 8 * matches AS w, CASE WHEN steps_union - matches + 8 * matches > 60 AND steps_union - matches > 1 THEN least(greatest(ceil((steps_union - matches + 8 * matches)::FLOAT / 40::FLOAT), 2), 8, steps_union - matches) ELSE 0 END::BIGINT AS chunks FROM work)"


@query(w("sp", SPT, CELLS, WORK, CHUNKS) + "SELECT tile_row, tile_col, chunks FROM ch")
def chunk_counts(spark, folder):
    return planner.with_chunks(planner.tile_work(*both_ways(spark, folder)), POLICY).select("tile_row", "tile_col", "chunks")


TAIL = "SELECT count(*) AS tiles, count(*) FILTER (WHERE chunks > 0) AS heavy, sum(chunks)::BIGINT AS chunks, CASE WHEN count(*) FILTER (WHERE chunks > 0) = 0 THEN 'zero-heavy' WHEN count(*) FILTER (WHERE chunks > 0) > {} * count(*) THEN 'heavy-fraction' ELSE 'enabled' END AS gate FROM ch"


@query(w("sp", SPT, CELLS, WORK, CHUNKS) + TAIL.format("1.0"))
def tail_plan(spark, folder):
    return planner.tail_plan(planner.tile_work(*both_ways(spark, folder)), POLICY)


@query(w("sp", SPT, CELLS, WORK, CHUNKS) + TAIL.format("0.001"))
def early_split_plan(spark, folder):
    return planner.tail_plan(planner.tile_work(*both_ways(spark, folder)), planner.TailPolicy(60.0, 40.0, 8, 0.001))


@query(w("sp", SPT, CELLS, WORK, "s AS (SELECT o.tile_row, o.tile_col, tk, CASE WHEN a.tile_row IS NOT NULL AND b.tile_col IS NOT NULL THEN 9 ELSE 1 END AS wt, m FROM ends o, (SELECT DISTINCT tk FROM la UNION SELECT DISTINCT tk FROM lb) t LEFT JOIN la a ON a.tk = t.tk AND a.tile_row = o.tile_row LEFT JOIN lb b ON b.tk = t.tk AND b.tile_col = o.tile_col WHERE t.tk <= m AND (a.tile_row IS NOT NULL OR b.tile_col IS NOT NULL))".replace("t.tk <= m", "t.tk <= o.m").replace(" tk, CASE", " t.tk, CASE"), "c AS (SELECT tile_row, tile_col, CASE WHEN steps + 7 * matches > 60 AND steps - matches > 1 THEN least(greatest(ceil((steps + 7 * matches)::FLOAT / 40::FLOAT), 2), 8, steps - matches) ELSE 0 END::BIGINT AS chunks FROM work)", "x AS (SELECT s.tile_row, s.tile_col, wt, floor((sum(wt) OVER (PARTITION BY s.tile_row, s.tile_col ORDER BY tk) - wt) * chunks / sum(wt) OVER (PARTITION BY s.tile_row, s.tile_col))::BIGINT AS chunk FROM s JOIN c USING (tile_row, tile_col) WHERE chunks > 0)") + "SELECT tile_row, tile_col, chunk, count(*) AS steps, sum(wt)::DOUBLE AS work FROM x GROUP BY ALL")
def chunk_slices(spark, folder):
    return planner.chunk_slices(*both_ways(spark, folder), policy=POLICY)


@query(w("sp", SPT, CELLS, tile_sql("sp", "ta"), tile_sql("spt", "tb", True), "o AS (SELECT count(*) AS n FROM cells GROUP BY i // 8, k // 8)") + """SELECT q.quota, (SELECT count(*) FROM ta JOIN tb ON ta.tile_col = tb.tile_row) AS pairs, (SELECT count(*) FROM ta JOIN tb ON ta.tile_col = tb.tile_row WHERE ta.nnz * tb.nnz <= 64) AS sparse_pairs,
    (SELECT count(*) FROM o) AS outputs, (SELECT count(*) FROM o WHERE n <= q.quota) AS sparse_outputs, (SELECT 2 * sum(nnz) <= q.quota * count(*) FROM ta) AS left_ok, (SELECT 2 * sum(nnz) <= q.quota * count(*) FROM tb) AS right_ok FROM (VALUES (4::BIGINT), (8), (12), (16)) q(quota)""")
def low_fill_guard(spark, folder):
    return planner.low_fill(*both_ways(spark, folder))


@query(w("op", "ta AS (SELECT DISTINCT k // 8 AS tile_row, i // 4 AS tk FROM op)", "f AS (SELECT tk, count(*) AS n FROM ta GROUP BY 1)") + "SELECT tile_row, count(*) AS degree, sum(n)::BIGINT AS pairs, least(sum(n), (SELECT (count(*) + 7) // 8 FROM part))::BIGINT AS candidates FROM ta JOIN f USING (tk) GROUP BY 1")
def exact_forward_estimate(spark, folder):
    a = data.order_part(spark, folder)
    return symbolic.row_work(a.transpose(), a)


@query(w("op", "ps", "f AS (SELECT coalesce(a.k, b.i) AS key, coalesce(x, 0) AS x, coalesce(y, 0) AS y FROM (SELECT k, count(*) AS x FROM op GROUP BY 1) a FULL JOIN (SELECT i, count(*) AS y FROM ps GROUP BY 1) b ON a.k = b.i)", "g AS (SELECT key, greatest(x, 1) AS x, greatest(y, 1) AS y FROM f)")
    + "SELECT key, ceil(x / CASE WHEN x <= 10 THEN x WHEN y <= 10 THEN 100 // y ELSE 10 END)::BIGINT AS left_parts, ceil(y / CASE WHEN y <= 10 THEN y WHEN x <= 10 THEN 100 // x ELSE 10 END)::BIGINT AS right_parts FROM g WHERE x * y > 100")
def hot_inner_keys(spark, folder):
    """Parts with more than 100 pairs of an order and a supplier, and into how many strips either side is cut."""
    hot = product.deal(data.order_part(spark, folder), data.supplier_part(spark, folder).transpose(), most=400).hot
    return hot.toDF("key", "left_parts", "right_parts")


# orders


@query(w("ol", "d AS (SELECT i AS vid, count(*) AS degree FROM ol GROUP BY 1 UNION ALL SELECT k + (SELECT count(*) FROM orders), count(*) FROM ol GROUP BY k)") + "SELECT r.range AS vid, coalesce(degree, 0) AS degree, row_number() OVER (ORDER BY coalesce(degree, 0) = 0, coalesce(degree, 0), r.range) - 1 AS rank FROM range((SELECT count(*) FROM orders) + (SELECT count(*) FROM part)) r LEFT JOIN d ON d.vid = r.range")
def seed_order(spark, folder):
    return reorder.seeds(data.order_part(spark, folder, merged=False))


@query(w("ol", "d AS (SELECT count(*) AS degree FROM ol GROUP BY i UNION ALL SELECT count(*) FROM ol GROUP BY k)", "b AS (SELECT degree, length(bin(degree)) - 1 AS lg FROM d)") + "SELECT degree, least(lg, 7)::BIGINT AS bucket, (lg // 2)::BIGINT AS soft, count(*) AS ids FROM b GROUP BY ALL")
def degree_buckets(spark, folder):
    a = reorder.vertices(data.order_part(spark, folder, merged=False)).where("degree > 0")
    return a.select("degree", fn.degree_bucket("degree").alias("bucket"), fn.soft_bucket("degree").alias("soft")).groupBy("degree", "bucket", "soft").agg(F.count(F.lit(1)).alias("ids"))


def mix_sql(x: str) -> str:
    """Nested SQL for the splitmix finaliser of an expression of type UHUGEINT below 2**64."""
    wrap = "((({z}) * {lo}::UHUGEINT) + (((({z}) * {hi}::UHUGEINT) % 4294967296::UHUGEINT) << 32)) % 18446744073709551616::UHUGEINT"
    z = f"(({x}) + 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT"
    out = f"(SELECT xor(z, z >> 31) FROM (SELECT {wrap.format(z='z', lo=0x94D049BB133111EB & 0xFFFFFFFF, hi=0x94D049BB133111EB >> 32)} AS z FROM (SELECT xor(z, z >> 27) AS z FROM (SELECT {wrap.format(z='z', lo=0xBF58476D1CE4E5B9 & 0xFFFFFFFF, hi=0xBF58476D1CE4E5B9 >> 32)} AS z FROM (SELECT xor(z, z >> 30) AS z FROM (SELECT {z} AS z))))))"
    return out


def profile_sql(own: str, other: str, step: int, count: str) -> str:
    big = lambda x: f"{x % 2**64}::UHUGEINT"
    bits = [f"({mix_sql(f'panel::UHUGEINT + {big(word * fn.WORD_STEP)}')} % 64)::INT" for word in (0, 1)]
    sketches = [mix_sql(f"xor(panel::UHUGEINT, {big(fn.SKETCH_BASE + word * fn.SKETCH_STEP)})") for word in (0, 1)]
    signed = lambda x: f"(CASE WHEN {x} >= 9223372036854775808::UHUGEINT THEN {x}::HUGEINT - 18446744073709551616::HUGEINT ELSE {x}::HUGEINT END)::BIGINT"
    return w(
        "op", f"p AS (SELECT DISTINCT {other} // {step} AS panel FROM op)", f"f AS (SELECT panel, {bits[0]} AS b0, {bits[1]} AS b1, {sketches[0]} AS h0, {sketches[1]} AS h1 FROM p)",
        f"e AS (SELECT {own} AS id, panel, b0, b1, h0, h1 FROM op JOIN f ON panel = {other} // {step})",
        "g AS (SELECT id, count(*) AS degree, min(panel) AS lo, max(panel) AS hi, count(DISTINCT b0) + count(DISTINCT b1) AS occ, bit_or(1::UHUGEINT << b0::UHUGEINT) AS f0, bit_or(1::UHUGEINT << b1::UHUGEINT) AS f1, min(h0) AS h0, min(h1) AS h1 FROM e GROUP BY 1)",
    ) + f"SELECT r.range AS id, coalesce(degree, 0) AS degree, coalesce((length(bin(degree)) - 1) // 2, -1)::BIGINT AS soft_bucket, coalesce(occ, 0) AS panel_occupancy, coalesce(lo, -1) AS panel_min, coalesce(hi, -1) AS panel_max, coalesce(hi - lo + 1, 0) AS panel_span, coalesce({signed('f0')}, 0) AS f0, coalesce({signed('f1')}, 0) AS f1, coalesce({signed('h0')}, 0) AS h0, coalesce({signed('h1')}, 0) AS h1 FROM range((SELECT count(*) FROM {count})) r LEFT JOIN g ON g.id = r.range"


def axis_profile(spark, folder, name):
    a = data.order_part(spark, folder)
    return reorder.profiles(a, reorder.identity(a), name).drop("place").fillna(0, ["h0", "h1"])


@query(profile_sql("i", "k", 4, "orders"))
def axis_profile_rows(spark, folder):
    return axis_profile(spark, folder, "row")


@query(profile_sql("k", "i", 8, "part"))
def axis_profile_inner(spark, folder):
    return axis_profile(spark, folder, "inner")


def order_sql(m: str) -> tuple[str, str, str]:
    """Each axis by degree in SQL, and the entries with their new ids."""
    one = lambda name, c, of: f"{name} AS (SELECT r.range AS old_id, row_number() OVER (ORDER BY coalesce(d, 0) = 0, coalesce(d, 0), r.range) - 1 AS new_id FROM range((SELECT count(*) FROM {of})) r LEFT JOIN (SELECT {c} AS c, count(*) AS d FROM {m} GROUP BY 1) ON c = r.range)"
    return one("pr", "i", "orders"), one("pk", "k", "part"), f"x AS (SELECT {m}.i, {m}.k, pr.new_id AS ri, pk.new_id AS rk, v FROM {m} JOIN pr ON pr.old_id = {m}.i JOIN pk ON pk.old_id = {m}.k)"


MOVED = order_sql("op")
BOTH = "b AS (SELECT 'row' AS axis, * FROM pr UNION ALL SELECT 'inner', * FROM pk)"


@query(w("op", *MOVED, "t AS (SELECT count(DISTINCT (i // 8, k // 4)) AS before, count(DISTINCT (ri // 8, rk // 4)) AS after FROM x)") + "SELECT before, after, after < before AS accepted FROM t")
def global_tile_guard(spark, folder):
    a = data.order_part(spark, folder)
    perm = reorder.by_degree(a)
    both = a.df.join(reorder.axis(perm, "row", "i", "ri"), "i").join(reorder.axis(perm, "inner", "k", "rk"), "k")
    both = both.agg(F.count_distinct(fn.div("i", 8), fn.div("k", 4)).alias("before"), F.count_distinct(fn.div("ri", 8), fn.div("rk", 4)).alias("after"))
    return both.withColumn("accepted", F.col("after") < F.col("before"))


@query(w("op", "s AS (SELECT i // 32 AS win, k // 4 AS opp, unnest([{'state': 0, 'p': i}, {'state': 1, 'p': CASE WHEN i // 32 = ((SELECT count(*) FROM orders) - 1) // 32 THEN i ELSE i // 32 * 32 + 31 - i % 32 END}], recursive := true) FROM op)", "d AS (SELECT DISTINCT win, opp, state, (p % 32) // 8 AS grp FROM s)", "g AS (SELECT win, state, grp, count(*) AS t, max(opp) - min(opp) + 1 AS f FROM d GROUP BY ALL)", "x AS (SELECT win, coalesce(sum(t) FILTER (WHERE state = 0), 0)::BIGINT AS t0, coalesce(sum(f) FILTER (WHERE state = 0), 0)::BIGINT AS f0, coalesce(sum(t) FILTER (WHERE state = 1), 0)::BIGINT AS t1, coalesce(sum(f) FILTER (WHERE state = 1), 0)::BIGINT AS f1 FROM g GROUP BY 1)") + "SELECT *, t1 < t0 OR t1 = t0 AND f1 < f0 AS accepted FROM x")
def window_tiles_fanout(spark, folder):
    a = data.order_part(spark, folder)
    i = F.col("old_id")
    mirrored = F.when(fn.div(i, 32) == (a.m - 1) // 32, i).otherwise(fn.div(i, 32) * 32 + 31 - F.pmod(i, F.lit(32)))
    now = reorder.identity(a)
    return reorder.window_costs(a, now, now.where("axis = 'row'").select("old_id", mirrored.alias("new_id")), "row")


@query(w("op", *MOVED, BOTH) + "SELECT axis, count(*) FILTER (WHERE old_id <> new_id) AS moved, sum(abs(new_id - old_id))::BIGINT AS displacement FROM b GROUP BY 1")
def perm_summary(spark, folder):
    return reorder.summary(reorder.by_degree(data.order_part(spark, folder)))


@query(w("op", *MOVED, BOTH) + "SELECT axis, old_id, new_id, old_id AS new_to_old_at_new_id FROM b")
def perm_inverse(spark, folder):
    return mtx.permutation_rows(reorder.by_degree(data.order_part(spark, folder)))


@query(w("op", *MOVED) + "SELECT ri AS i, rk AS k, v FROM x")
def apply_perm(spark, folder):
    a = data.order_part(spark, folder)
    return reorder.apply(a, reorder.by_degree(a)).df


@query(w("sp") + "SELECT a.i, b.i AS k, sum(a.v * b.v) AS v FROM sp a JOIN sp b ON a.k = b.k GROUP BY ALL")
def product_perm_invariant(spark, folder):
    a = data.supplier_part(spark, folder)
    perm = reorder.by_degree(a)
    c = product.multiply(reorder.apply(a, perm), "ab", reorder.apply_inner_to_rows(a.transpose(), perm))
    return reorder.restore_rows(c, perm, a.m, reorder.apply(a, perm)).df


@query(w("op", *MOVED) + "SELECT 'row' AS axis, max(ri) + 1 AS active FROM x UNION ALL SELECT 'inner', max(rk) + 1 FROM x")
def active_prefix(spark, folder):
    a = data.order_part(spark, folder)
    return reorder.active(a, reorder.by_degree(a))


@query()
def coarse_order(spark, folder):
    return reorder.coarse(data.order_part(spark, folder))[0]


@query()
def reorder_plan(spark, folder):
    return reorder.plan(data.order_part(spark, folder)).perm


@query(w("op", "d AS (SELECT 'row' AS axis, i AS id, count(*) AS n FROM op GROUP BY ALL UNION ALL SELECT 'inner', k, count(*) FROM op GROUP BY ALL)", "m AS (SELECT axis, count(*) AS used, sum(n)::BIGINT AS entries, sum(n * n)::BIGINT AS squares FROM d GROUP BY 1)", "x AS (SELECT 'row' AS axis, count(DISTINCT o_orderkey) AS ids, min(o_orderkey) AS least, max(o_orderkey) AS most FROM orders UNION ALL SELECT 'inner', count(DISTINCT p_partkey), min(p_partkey), max(p_partkey) FROM part)")
    + "SELECT axis, ids, ids AS old_ids, ids AS new_ids, least, most, used, entries, squares, (SELECT count(DISTINCT (i // 8, k // 4)) FROM op) AS tiles_before, true AS fewer FROM x JOIN m USING (axis)")
def reorder_plan_effect(spark, folder):
    """The plan of order x part is a bijection on both axes that keeps entries and degrees, and gives fewer tiles."""
    a = data.order_part(spark, folder)
    made = reorder.plan(a)
    before = a.df.select(fn.div("i", 8), fn.div("k", 4)).distinct().count()
    # an id's entries are those of its new place, so counts are moved, not entries
    counts = a.row_counts().select(F.lit("row").alias("axis"), F.col("i").alias("old_id"), "entries").unionByName(a.column_counts().select(F.lit("inner").alias("axis"), F.col("k").alias("old_id"), "entries"))
    degrees = counts.join(made.perm, ["axis", "old_id"]).groupBy("axis", "new_id").agg(F.sum("entries").alias("entries"))
    degrees = degrees.groupBy("axis").agg(F.count(F.lit(1)).alias("used"), F.sum("entries").alias("_sum"), F.sum(F.col("entries") * F.col("entries")).alias("squares")).withColumnRenamed("_sum", "entries")
    ids = made.perm.groupBy("axis").agg(F.count(F.lit(1)).alias("ids"), F.count_distinct("old_id").alias("old_ids"), F.count_distinct("new_id").alias("new_ids"), F.min("new_id").alias("least"), F.max("new_id").alias("most"))
    fewer = made.stats["num_tiles"] < before
    return ids.join(degrees, "axis").withColumn("tiles_before", F.lit(before).cast("long")).withColumn("fewer", F.lit(fewer))


@query(w("sp") + "SELECT a.i, b.i AS k, sum(a.v * b.v) AS v FROM sp a JOIN sp b ON a.k = b.k GROUP BY ALL")
def reordered_product(spark, folder):
    return reorder.multiply_reordered(data.supplier_part(spark, folder), "aat")[0].df


#: Lines of the largest quantities: many orders and parts have none.
FEW = "few AS (SELECT l_orderkey AS i, l_partkey AS k, sum(l_quantity) AS v FROM lineitem WHERE l_quantity >= 49 GROUP BY ALL)"


def few_lines(spark: SparkSession, folder: str) -> tuple[Matrix, reorder.Plan]:
    """Order x part of the largest quantities, and its order by degree, which puts empty ids last."""
    whole = data.order_part(spark, folder, merged=False)
    a = Matrix(whole.df.where("v >= 49"), whole.m, whole.n).merged()
    return a, reorder.external_plan(a, reorder.by_degree(a), "degree")


@query(w(FEW, "ps", *order_sql("few")) + "SELECT pk.new_id AS i, ps.k, ps.v FROM ps JOIN pk ON pk.old_id = ps.i WHERE pk.new_id < (SELECT count(DISTINCT k) FROM few)")
def cut_right_operand(spark, folder):
    """B's rows under the order of A's inner indices, without those that no entry of A asks for."""
    a, plan = few_lines(spark, folder)
    return reorder.operands(a, data.supplier_part(spark, folder).transpose(), plan)[1].df


@query(w(FEW, *order_sql("few"), "n AS (SELECT ri // 8 AS tile_row, count(DISTINCT rk // 4) AS n FROM x GROUP BY 1)") + "SELECT r.range AS r, coalesce(sum(n) OVER (ORDER BY r.range ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ptr FROM range((SELECT (count(DISTINCT i) + 7) // 8 + 1 FROM few)) r LEFT JOIN n ON n.tile_row = r.range")
def cut_tile_row_ptr(spark, folder):
    """Tile rows end with the active prefix."""
    a, plan = few_lines(spark, folder)
    left = reorder.operands(a, a.transpose(), plan)[0]
    return tiles.row_pointer(tiles.tiles(left), (left.m + 7) // 8)


@query(w(FEW, "ps") + "SELECT a.i, b.k, sum(a.v * b.v) AS v FROM few a JOIN ps b ON a.k = b.i GROUP BY ALL")
def cut_product(spark, folder):
    a, plan = few_lines(spark, folder)
    return reorder.multiply_reordered(a, "ab", data.supplier_part(spark, folder).transpose(), plan)[0].df


@query(w("sp") + "SELECT a.i, b.i AS k, sum(a.v * b.v) AS v FROM sp a JOIN sp b ON a.k = b.k GROUP BY ALL")
def prepared_product_sp(spark, folder):
    """A written once in buckets of the inner index, under the order by degree."""
    a = data.supplier_part(spark, folder)
    name = f"quillmat_prepared_{uuid.uuid4().hex}"
    plan = reorder.external_plan(a, reorder.by_degree(a), "degree")
    return reorder.prepare(a, plan, name, f"{shared_dir(spark).rstrip('/')}/{name}").multiply(a.transpose()).df


REPORT = {"tiles": "count(*)", "sparse_tiles": "count(*) FILTER (WHERE NOT dense)", "dense_tiles": "count(*) FILTER (WHERE dense)", "places": "sum(nnz)", "payload": "sum(span)", "most_places": "max(nnz)", "fill": "sum(nnz)::DOUBLE / (32 * count(*))"}


@query(w("sp", tile_sql("sp", "ta"), tile_sql("sp", "tb", True), "c AS (SELECT i // 8 AS r, k // 8 AS c, count(*) AS n FROM (SELECT DISTINCT a.i, b.k FROM sp a JOIN sp b ON a.k = b.i) GROUP BY ALL)", *(f"{x} AS ({FULL} FROM t{x[1]})" for x in ("ua", "ub")))
    + " UNION ALL ".join(f"SELECT '{x[1]}' AS name, '{k}' AS key, ({v})::DOUBLE AS value FROM {x}" for x in ("ua", "ub") for k, v in REPORT.items())
    + " UNION ALL " + " UNION ALL ".join(f"SELECT 'c', '{k}', coalesce({v}, 0)::DOUBLE FROM c" for k, v in {"tiles": "count(*)", "entries": "sum(n)", "most_entries": "max(n)", "fill": "sum(n)::DOUBLE / nullif(64 * count(*), 0)"}.items()))
def product_report(spark, folder):
    """Figures in tiles of both operands and of their product, A A with the suppliers as parts."""
    a = data.supplier_part(spark, folder)
    return report.product(a, Matrix(a.df, a.n, a.n))


# exports


@query(w("ol", *order_sql("ol"), "y AS (SELECT least(15, i * 16 // (SELECT count(*) FROM orders)) AS r, least(15, k * 16 // (SELECT count(*) FROM part)) AS c, least(15, ri * 16 // (SELECT count(*) FROM orders)) AS rr, least(15, rk * 16 // (SELECT count(*) FROM part)) AS rc FROM x)") + "SELECT a.range AS bin_row, b.range AS bin_col, (SELECT count(*) FROM y WHERE r = a.range AND c = b.range) AS original_nnz, (SELECT count(*) FROM y WHERE rr = a.range AND rc = b.range) AS reordered_nnz FROM range(16) a, range(16) b")
def heatmap_16(spark, folder):
    a = data.order_part(spark, folder, merged=False)
    return mtx.heat_map(a, reorder.by_degree(a), 16)


@query(w("op", *MOVED, BOTH, "s AS (SELECT axis, count(*) FILTER (WHERE old_id <> new_id) AS moved, sum(abs(new_id - old_id))::BIGINT AS d FROM b GROUP BY 1)") + "SELECT CASE axis WHEN 'row' THEN 'moved_rows' ELSE 'moved_inner' END AS key, moved AS value FROM s UNION ALL SELECT axis || '_displacement_sum', d FROM s")
def heatmap_meta(spark, folder):
    return mtx.movement(reorder.by_degree(data.order_part(spark, folder)))


@query(w("sp", SPT, CELLS, PARENTS, "dim AS (SELECT (SELECT (count(*) + 15) // 16 FROM supplier) AS pm, (SELECT (count(*) + 15) // 16 FROM part) AS pn)", "kids AS (SELECT parent_row, parent_col, (SELECT count(DISTINCT (i // 8, k // 8)) FROM cells WHERE i // 16 = parent_row AND k // 16 = parent_col) AS n FROM (SELECT DISTINCT parent_row, parent_col FROM pa JOIN pb USING (pk)))", "k AS (SELECT least(7, parent_row * 8 // pm) AS r, least(7, parent_col * 8 // pm) AS c, n FROM kids, dim)", "ta AS (SELECT DISTINCT i // 8 AS tr, k // 4 AS tc FROM sp)", "tb AS (SELECT DISTINCT i // 4 AS tr, k // 8 AS tc FROM spt)", "xa AS (SELECT least(7, tr // 2 * 8 // pm) AS r, least(7, tc // 4 * 8 // pn) AS c FROM ta, dim)", "xb AS (SELECT least(7, tr // 4 * 8 // pn) AS r, least(7, tc // 2 * 8 // pm) AS c FROM tb, dim)")
    + "SELECT a.range AS bin_row, b.range AS bin_col, (SELECT count(*) FROM xa WHERE r = a.range AND c = b.range) AS a_tiles, (SELECT count(*) FROM xb WHERE r = a.range AND c = b.range) AS b_tiles, (SELECT count(*) FROM k WHERE r = a.range AND c = b.range) AS candidates, (SELECT count(*) FROM k WHERE r = a.range AND c = b.range AND n > 0) AS nonempty, (SELECT count(*) FROM k WHERE r = a.range AND c = b.range AND n = 0) AS empty, "
    + ", ".join(f"(SELECT count(*) FROM k WHERE r = a.range AND c = b.range AND n = {x}) AS children{x}" for x in (1, 2, 3, 4)) + " FROM range(8) a, range(8) b")
def super16_heatmap(spark, folder):
    return mtx.parent_heat_map(*both_ways(spark, folder), bins=8)


@query(w("sp", SPT, CELLS, PARENTS, "kids AS (SELECT parent_row, parent_col, (SELECT count(DISTINCT (i // 8, k // 8)) FROM cells WHERE i // 16 = parent_row AND k // 16 = parent_col) AS n FROM (SELECT DISTINCT parent_row, parent_col FROM pa JOIN pb USING (pk)))")
    + "SELECT key, value::BIGINT AS value FROM (SELECT 'parent_rows' AS key, (count(*) + 15) // 16 AS value FROM supplier UNION ALL SELECT 'parent_cols', (count(*) + 15) // 16 FROM supplier UNION ALL SELECT 'bins', 8 UNION ALL SELECT 'a_tiles', count(DISTINCT (i // 8, k // 4)) FROM sp UNION ALL SELECT 'b_tiles', count(DISTINCT (k // 4, i // 8)) FROM sp UNION ALL SELECT 'candidates', count(*) FROM kids UNION ALL SELECT 'nonempty', count(*) FROM kids WHERE n > 0 UNION ALL SELECT 'empty', count(*) FROM kids WHERE n = 0"
    + "".join(f" UNION ALL SELECT 'children{x}', count(*) FROM kids WHERE n = {x}" for x in (1, 2, 3, 4)) + ")")
def parent_meta(spark, folder):
    a, b = both_ways(spark, folder)
    return mtx.parent_heat_meta(mtx.parent_heat_map(a, b, bins=8), a, b, 8)


@query("SELECT l_returnflag, median(l_quantity) AS middle, min(l_quantity) AS least, max(l_quantity) AS most, list_sort(list(l_quantity))[count(*) // 2 + 1] AS upper_middle FROM lineitem GROUP BY 1")
def sample_median_stats(spark, folder):
    lines = data.table(spark, folder, "lineitem")
    made = lines.groupBy(F.col("l_returnflag").alias("_flag")).agg(F.min("l_quantity").alias("least"), F.max("l_quantity").alias("most"))
    return medians(lines, ["l_returnflag"], "l_quantity").join(made, F.col("l_returnflag").eqNullSafe(F.col("_flag")), "left").drop("_flag")


@query("SELECT l_returnflag, l_linestatus, list_sort(list(l_extendedprice))[(count(*) - 1) // 2 + 1] / 2 + list_sort(list(l_extendedprice))[count(*) // 2 + 1] / 2 AS middle, list_sort(list(l_extendedprice))[count(*) // 2 + 1] AS upper_middle FROM lineitem GROUP BY ALL")
def median_prices(spark, folder):
    """Of values that are nearly all different."""
    return medians(data.table(spark, folder, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice")


@query(w("sp", tile_sql("sp", "t")) + "SELECT mask, (nnz + 7) // 8 AS eighths, bit_count((mask & -mask) - 1)::BIGINT AS lowest, least(9223372036854775807::HUGEINT, mask::HUGEINT * 9000000000)::BIGINT AS product, least(9223372036854775807::HUGEINT, mask::HUGEINT + 9223372036854000000)::BIGINT AS total FROM t")
def scalar_functions(spark, folder):
    m = F.col("mask")
    return tiles.tiles(data.supplier_part(spark, folder)).select("mask", fn.ceil_div("nnz", 8).alias("eighths"), fn.first_set("mask").alias("lowest"), fn.saturating_multiply(m, F.lit(9000000000)).alias("product"), fn.saturating_add(m, F.lit(9223372036854000000)).alias("total"))


@query(w("sp", "uh") + "SELECT i, k FROM sp INTERSECT SELECT i, k FROM uh")
def coordinates_in_both(spark, folder):
    return data.supplier_part(spark, folder).df.select("i", "k").intersect(data.user_hour(spark, folder).df.select("i", "k"))


@query(w("sp", "uh") + "SELECT i, k FROM uh UNION SELECT i, k FROM sp")
def coordinates_in_either(spark, folder):
    return data.user_hour(spark, folder).df.select("i", "k").union(data.supplier_part(spark, folder).df.select("i", "k")).distinct()


#: Two rounds from the seed, whose component is deeper than that on the given tables.
@query(w("op", "e AS (SELECT i AS a, k + (SELECT count(*) FROM orders) AS b FROM op)", "n AS (SELECT a AS s, b AS d FROM e UNION ALL SELECT b, a FROM e)", "ol", "g AS (SELECT i AS v, count(*) AS d FROM ol GROUP BY 1 UNION ALL SELECT k + (SELECT count(*) FROM orders), count(*) FROM ol GROUP BY k)",
         "l0 AS (SELECT v FROM (SELECT s AS v, count(*) AS d FROM n GROUP BY 1) ORDER BY d, v LIMIT 1)", "l1 AS (SELECT d AS v FROM n WHERE s IN (SELECT v FROM l0))", "l2 AS (SELECT d AS v FROM n WHERE s IN (SELECT v FROM l1))")
    + "SELECT DISTINCT s AS vid FROM n WHERE s NOT IN (SELECT v FROM l0 UNION SELECT v FROM l1 UNION SELECT v FROM l2)")
def residual_ids(spark, folder):
    return reorder.residual(data.order_part(spark, folder), budget=2)


@query(w("op", "c AS (SELECT DISTINCT a.k // 8 AS tile_row, b.k // 8 AS tile_col FROM op a JOIN op b ON a.i = b.i)", "n AS (SELECT tile_row, count(*) AS n FROM c GROUP BY 1)") + "SELECT r.range AS r, coalesce(sum(n) OVER (ORDER BY r.range ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ptr FROM range((SELECT (count(*) + 7) // 8 + 1 FROM part)) r LEFT JOIN n ON n.tile_row = r.range")
def c_tile_row_ptr(spark, folder):
    a = data.order_part(spark, folder)
    return tiles.row_pointer_of(symbolic.tile_rows_held(a.transpose(), a).select("tile_row", F.col("tiles").alias("n")), (a.n + 7) // 8)


@query(w("op", tile_sql("op", "t")) + "SELECT 'row' AS axis, tile_row AS id, count(*) AS tiles, sum(nnz)::BIGINT AS entries FROM t GROUP BY 2 UNION ALL SELECT 'column', tile_col, count(*), sum(nnz)::BIGINT FROM t GROUP BY 2")
def tile_axis_sums(spark, folder):
    return tiles.axis_sums(tiles.tiles(data.order_part(spark, folder)))
