import random
import tempfile
import time

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmat.functions import columns as fn
from quillmat.functions.ordering import numbered, running
from quillmat.operators import blocks, planner, product, reorder, symbolic, tiles
from quillmat.operators.matrix import Matrix
from quillmat.sources import mtx
from quillmat.streaming import delta


def matrix(spark, entries, m, n):
    return Matrix(spark.createDataFrame([(i, k, float(v)) for i, k, v in entries], "i long, k long, v double"), m, n)


def triples(df):
    return sorted(tuple(r) for r in df.collect())


FOUR = [(0, 0, 1), (1, 4, 2), (8, 1, 3), (9, 5, 4)]
FORTY = [(i, 5 * i % 16, 1) for i in range(40)] + [(i, (7 * i + 3) % 16, 1) for i in range(0, 40, 2)]


def dense(entries, m, n):
    x = np.zeros((m, n))
    for i, k, v in entries:
        x[i, k] += v
    return x


@pytest.mark.parametrize("mode", ["aa", "aat", "ab"])
def test_product_against_numpy(spark, mode):
    rng = random.Random(7)
    e = [(rng.randrange(12), rng.randrange(12), rng.randrange(-3, 4)) for _ in range(60)]
    a, x = matrix(spark, e, 12, 12), dense(e, 12, 12)
    b, y = {"aa": (None, x), "aat": (None, x.T), "ab": (a, x)}[mode]
    got = dense(triples(product.multiply(a, mode, b).df), 12, 12)
    assert np.allclose(got, x @ y)
    right = product.right_operand(a, mode, b)
    assert np.allclose(dense(triples(product.multiply_split(a, right, 3).df), 12, 12), x @ y)


def test_zero_sums_and_explicit_zeros_stay(spark):
    a = matrix(spark, [(0, 0, 2), (0, 0, -2), (1, 1, 0)], 2, 2)
    assert triples(a.merged().df) == [(0, 0, 0.0), (1, 1, 0.0)]
    assert tiles.tiles(a).first()["mask"] == 0b100001
    assert triples(product.structure(a, a)) == [(0, 0), (1, 1)]


def test_shapes(spark):
    a = matrix(spark, [(0, 4, 1), (2, 0, 1)], 3, 5)
    assert product.multiply(a, "aat").m == product.multiply(a, "aat").n == 3
    with pytest.raises(ValueError):
        product.multiply(a, "aa")
    with pytest.raises(ValueError):
        matrix(spark, [(0, 5, 1)], 3, 5).validated()


@pytest.mark.parametrize("m,n", [(0, 0), (7, 3)])
def test_empty(spark, m, n):
    a = matrix(spark, [], m, n)
    assert product.multiply(a, "aat").df.count() == 0
    assert product.product_count(a, a.transpose()).first()[0] == 0
    assert tiles.totals(tiles.tiles(a)).first()["tiles"] == 0
    assert [r["ptr"] for r in a.row_pointer().collect()] == [0] * (m + 1)


def test_partial_tile(spark):
    a = matrix(spark, [(8, 4, 1)], 9, 5)
    t = tiles.tiles(a).first()
    assert (t["tile_row"], t["tile_col"], t["mask"]) == (1, 1, 1)
    assert triples(tiles.entries(tiles.packed(a), 9, 5).df) == [(8, 4, 1.0)]


@pytest.mark.parametrize("slots,span", [(23, 23), (24, 32)])
def test_dense_threshold(spark, slots, span):
    a = matrix(spark, [(s // 4, s % 4, s + 1) for s in range(slots)], 8, 4)
    assert tiles.tiles(a).first()["span"] == span
    assert tiles.payload(a).count() == span
    assert triples(tiles.entries(tiles.packed(a), 8, 4).df) == triples(a.df)


def test_offsets_and_tiles_of_an_order(spark):
    a = matrix(spark, FOUR, 16, 8)
    assert tiles.tiles(a).count() == 4
    order = {0: 0, 8: 1, 1: 2, 9: 3}
    rest = iter(range(4, 16))
    rows = [("row", i, order[i] if i in order else next(rest)) for i in range(16)] + [("inner", k, k) for k in range(8)]
    moved = reorder.apply(a, spark.createDataFrame(rows, "axis string, old_id long, new_id long"))
    got = tiles.offsets(tiles.tiles(moved)).orderBy("tile_col").collect()
    assert [(r["mask"], r["value_offset"]) for r in got] == [(0x21, 0), (0x2100, 2)]
    assert [r["v"] for r in tiles.payload(moved).orderBy("tile_row", "tile_col", "place").collect()] == [1.0, 3.0, 2.0, 4.0]


def test_symmetric_files(spark):
    with tempfile.TemporaryDirectory() as d:
        text = "%%MatrixMarket MATRIX coordinate real {}\n% note\n3 3 3\n1 1 5\n2 1 7\n3 2 -1\n"
        for scheme, count in (("symmetric", 5), ("general", 3), ("skew-symmetric", 3)):
            with open(f"{d}/a.mtx", "w") as f:
                f.write(text.format(scheme))
            a, head = mtx.read_mtx(spark, f"{d}/a.mtx")
            assert (a.m, a.n, a.df.count(), head.scheme) == (3, 3, count, scheme)
        mtx.write_mtx(a, f"{d}/out")
        b, _ = mtx.read_mtx(spark, f"{d}/out")
        assert triples(a.df) == triples(b.df)
        mtx.write_reordered(a, reorder.reversal(a), f"{d}/rev")
        assert triples(mtx.read_mtx(spark, f"{d}/rev")[0].df) == sorted((2 - i, 2 - k, 1.0) for i, k, _ in triples(a.df))
        assert mtx.find_matrices(spark, d).count() == 1


@pytest.mark.parametrize("head", ["%%MatrixMarket matrix array real general", "%%matrixmarket matrix coordinate real general", "%%MatrixMarket matrix coordinate real hermitian", "%%MatrixMarket matrix coordinate pattern skew-symmetric", "x"])
def test_bad_banners(head):
    with pytest.raises(ValueError):
        mtx.banner(head)


@pytest.mark.parametrize("body", ["3 3 2\n1 1 5\n", "3 3 1\n4 1 5\n", "3 3 1\n1 x 5\n", "3 3 1\n1 1\n"])
def test_bad_entries(spark, body, tmp_path):
    (tmp_path / "a.mtx").write_text("%%MatrixMarket matrix coordinate real general\n" + body)
    with pytest.raises(ValueError):
        mtx.read_mtx(spark, str(tmp_path / "a.mtx"))


def test_parts_of_a_file(spark, tmp_path):
    a = matrix(spark, FORTY, 40, 16)
    for one in (False, True):
        mtx.write_mtx(a, str(tmp_path / f"{one}"), one_file=one)
        files = sorted((tmp_path / f"{one}").glob("part-*"))
        assert len(files) == 1 if one else len(files) > 1
        text = "".join(f.read_text() for f in files)
        assert text.startswith("%%MatrixMarket matrix coordinate real general\n40 16 60\n1 1 ")
        (tmp_path / f"{one}.mtx").write_text(text)
        assert triples(mtx.read_mtx(spark, str(tmp_path / f"{one}.mtx"))[0].df) == triples(a.df)
        assert triples(mtx.read_mtx(spark, str(tmp_path / f"{one}"))[0].df) == triples(a.df)


def test_file_order_of_duplicates(spark, tmp_path):
    (tmp_path / "a.mtx").write_text("%%MatrixMarket matrix coordinate real general\n2 2 3\n2 2 5\n1 1 4\n2 2 1\n")
    a, _ = mtx.read_mtx(spark, str(tmp_path / "a.mtx"), expand=False, entry_ids=True)
    assert [r["v"] for r in a.df.orderBy("entry_id").collect()] == [5.0, 4.0, 1.0]
    assert triples(a.sequential(10, "entry_id").df) == [(0, 0, 0.0), (1, 1, 1.0), (1, 1, 2.0)]


def test_command_line(spark, tmp_path):
    from quillmat.__main__ import arguments, run

    a = matrix(spark, FORTY, 40, 16)
    mtx.write_mtx(a, str(tmp_path / "a.mtx"))
    mtx.write_mtx(a.transpose(), str(tmp_path / "b.mtx"))
    for f, n in (("rows", 40), ("inner", 16)):
        (tmp_path / f).write_text("\n".join(map(str, reversed(range(n)))))
    at = str(tmp_path)
    want = product.structure(a, a.transpose()).count()
    for more in (["--aat"], [f"{at}/b.mtx", "--control", "original"], ["--aat", "--reorder", "full", "--diagnostics", f"{at}/d", "--heatmap-bins", "16", "--parent-diagnostics", "--control", "both", "--report"], ["--aat", "--row-order", f"{at}/rows", "--inner-order", f"{at}/inner", "--order-name", "mine-1", "--out", f"{at}/c"], ["--aat", "--no-reorder"]):
        out = run(spark, arguments([f"{at}/a.mtx", *more, "--runs", "1", "--check", "--results", f"{at}/results"]))
        assert out["nnz_c"] == want and out["same_structure"] and out["rows"] == 40 and out["min_ms"] <= out["ms"] <= out["max_ms"]
        assert set(out.get("controls", {})) == {"original": {"original"}, "both": {"original", "same-order"}}.get(more[more.index("--control") + 1] if "--control" in more else "", set())
    assert out["algorithm"] == "identity_baseline"
    rows = spark.read.csv(f"{at}/results").collect()
    assert len(rows) == 5 and {(r[2], r[3], r[4], r[6], r[10]) for r in rows} == {("40", "16", "60", str(want), "1")}
    assert mtx.read_mtx(spark, f"{at}/c")[0].df.count() == want
    meta = [r["key"] for r in spark.read.csv(f"{at}/d/heatmap_meta", header=True).collect()]
    assert meta[:4] == ["rows", "cols", "nnz", "bins"] and meta[meta.index("inner_displacement_sum") + 1] == "unified_tiles" and meta[meta.index("unified_payload") + 1] == "accepted_row_windows"
    assert spark.read.csv(f"{at}/d/permutation", header=True).count() == 56 and spark.read.csv(f"{at}/d/heatmap", header=True).count() == 16 * 16
    parents = spark.read.csv(f"{at}/d/parent_heatmap", header=True, inferSchema=True)
    sums = {r["key"]: int(r["value"]) for r in spark.read.csv(f"{at}/d/parent_meta", header=True).collect()}
    assert parents.count() == 64 * 64 and all(sums[c] == parents.agg(F.sum(c)).first()[0] for c in parents.columns[2:]) and sums["parent_rows"] == 3
    only = run(spark, arguments([f"{at}/a.mtx", "--aat", "--prepare-only", "--reorder", "fine", "--diagnostics", f"{at}/p"]))
    assert "nnz_c" not in only and spark.read.csv(f"{at}/p/stats", header=True).count() == 32
    for bad in (["--inner-order", "x"], ["--row-order", "x", "--reorder", "full"], ["b", "--aat"], ["--runs", "0"], ["--heatmap-bins", "15"], ["--heatmap-bins", "1025"], ["--order-name", "x"], ["--row-order", "x", "--order-name", "a b"], ["--row-order", "x", "--order-name", "y" * 64], ["--no-reorder", "--reorder", "full"], ["--no-reorder", "--row-order", "x"], ["--prepare-only"], ["--limit", "3"], ["b", "--batch"], ["--parent-diagnostics"]):
        with pytest.raises(SystemExit):
            arguments(["a", *bad])
    with pytest.raises(ValueError):
        mtx.read_plan(spark, a, f"{at}/rows")


def test_order_files(spark, tmp_path):
    f = tmp_path / "order"
    for bad in ("0 1", "0 1 2 3", "0 1 1", "0 1 3", "0 1 x"):
        f.write_text(bad)
        with pytest.raises(ValueError):
            mtx.read_order(spark, str(f), 3, "row")
    f.write_text("2 0\n1\n")
    assert triples(mtx.read_order(spark, str(f), 3, "row")) == [("row", 0, 1), ("row", 1, 2), ("row", 2, 0)]


def test_restore_rejects_rows_beyond_the_prefix(spark):
    a = matrix(spark, FOUR, 16, 8)
    perm = reorder.reversal(a)
    assert triples(reorder.restore_rows(reorder.apply(a, perm, inner=False), perm).df) == triples(a.df)
    with pytest.raises(ValueError):
        reorder.restore_rows(a, perm, 9)


def order_of(perm, name):
    return [r["old_id"] for r in perm.where(F.col("axis") == name).orderBy("new_id").collect()]


def test_plan_of_four(spark):
    a = matrix(spark, FOUR, 16, 8)
    p = reorder.plan(a)
    assert order_of(p.perm, "row") == [9, 8, 1, 0, 2, 3, 4, 5, 6, 7, 10, 11, 12, 13, 14, 15]
    assert order_of(p.perm, "inner") == [5, 1, 4, 0, 2, 3, 6, 7]
    s = p.stats
    assert (s["num_tiles"], s["coarse_components"], s["coarse_levels"], s["active_rows"], s["active_inner"], s["accepted_row_windows"]) == (1, 4, 8, 4, 4, 0)


def test_plan_of_forty(spark):
    a = matrix(spark, FORTY, 40, 16)
    p = reorder.plan(a)
    assert order_of(p.perm, "row") == [24, 8, 31, 15, 34, 18, 2, 29, 13, 28, 12, 27, 11, 38, 22, 6, 25, 9, 32, 16, 0, 39, 23, 7, 26, 10, 37, 21, 5, 36, 20, 4, 35, 19, 3, 30, 14, 33, 17, 1]
    assert order_of(p.perm, "inner") == [8, 11, 10, 1, 12, 7, 14, 13, 0, 3, 2, 9, 4, 15, 6, 5]
    assert (p.stats["num_tiles"], p.stats["coarse_components"], p.stats["coarse_levels"]) == (8, 8, 32)
    assert p.stats["row_fanout_before"] == p.stats["row_fanout_after"] == 8


def test_budget_leaves_a_bijection(spark):
    a = matrix(spark, [(i, i, 1) for i in range(30)] + [(i, i + 1, 1) for i in range(29)], 30, 30)
    perm, components, rounds = reorder.coarse(a, budget=6)
    assert (components, rounds) == (1, 6)
    assert reorder.bijective(perm, "row", 30) and reorder.bijective(perm, "inner", 30)


@pytest.mark.parametrize("variant", ["fine", "coarse-inner", "unguarded"])
def test_variants_never_gain_tiles(spark, variant):
    a = matrix(spark, FORTY, 40, 16)
    p = reorder.plan(a, variant)
    before = reorder.tile_count(a, reorder.identity(a))
    assert variant == "unguarded" or p.stats["num_tiles"] <= before
    assert before - p.stats["num_tiles"] == p.stats["coarse_tile_reduction"] + p.stats["row_tile_reduction"] + p.stats["inner_tile_reduction"]
    assert reorder.bijective(p.perm, "row", 40)


def test_external_and_identity(spark):
    a = matrix(spark, FOUR, 16, 8)
    assert reorder.external_plan(a, reorder.reversal(a), "mine").stats["algorithm"] == "external:mine"
    assert reorder.identity_plan(a).stats["moved_rows"] == 0
    with pytest.raises(ValueError):
        reorder.external_plan(a, reorder.reversal(a).where("old_id > 0"), "bad")


def test_mixing(spark):
    x = [0, 1, 2, 3]
    got = [r[0] & (2**64 - 1) for r in spark.createDataFrame([(i,) for i in x], "x long").select(fn.mix64("x")).collect()]
    assert [f"{g:016x}" for g in got] == ["e220a8397b1dcdaf", "910a2dec89025cc1", "975835de1c9756ce", "1d0b14e4db018fed"]
    bits = fn.panel_sketches(spark.range(8).withColumnRenamed("id", "panel")).orderBy("panel").collect()
    assert [(r["b0"], r["b1"]) for r in bits] == [(47, 50), (1, 47), (14, 51), (45, 53), (10, 3), (26, 32), (0, 54), (23, 59)]


def test_work_of_lists(spark):
    # inner tiles {1, 3, 5} and {3, 4}
    a = matrix(spark, [(0, 4 * t, 1) for t in (1, 3, 5)], 8, 24)
    b = matrix(spark, [(4 * t, 0, 1) for t in (3, 4)], 24, 8)
    r = planner.tile_work(a, b).first()
    assert (r["matches"], r["scans_trajectory"], r["scans_union"]) == (1, 3, 4)


def test_chunk_rule(spark):
    p = planner.TailPolicy(256.0, 256.0, 8)
    df = spark.createDataFrame([(200, 20), (256, 0), (1, 40), (257, 0), (9000, 0)], "s long, m long")
    assert [r[0] for r in df.select(planner.chunks(F.col("s"), F.col("m"), p)).collect()] == [2, 0, 0, 2, 8]


def test_gates(spark):
    work = spark.createDataFrame([(0, 0, 0, 300), (0, 1, 0, 10)], "tile_row long, tile_col long, matches long, scans_union long")
    gate = lambda **k: planner.tail_plan(work, planner.TailPolicy(**({"threshold": 256.0, "target": 256.0} | k))).first()["gate"]
    assert gate() == "heavy-fraction"
    assert gate(heavy_fraction=1.0) == "enabled"
    assert gate(threshold=1e6) == "zero-heavy"
    assert gate(max_chunks=1) == "invalid-policy"


def test_masks_count_the_product(spark):
    rng = random.Random(3)
    e = {(rng.randrange(30), rng.randrange(20)) for _ in range(90)}
    a = matrix(spark, [(i, k, 1) for i, k in e], 30, 20)
    masks = symbolic.exact_masks(a, a.transpose())
    assert masks.agg(F.sum("nnz")).first()[0] == product.structure(a, a.transpose()).count()
    assert symbolic.invariants(a, a.transpose()).first()["holds"]


def hot_matrix(spark, seed=5):
    rng = random.Random(seed)
    e = [(rng.randrange(40), 3 if rng.random() < 0.5 else rng.randrange(12), rng.randrange(-3, 4)) for _ in range(300)]
    return matrix(spark, e, 40, 12), dense(e, 40, 12), e


def test_hot_inner_indices_are_cut_on_both_sides(spark):
    a, x, e = hot_matrix(spark)
    made = product.deal(a, a.transpose(), 500)
    n = sum(k == 3 for _, k, _ in e)
    side = 11  # of squares of at most 125 pairs
    assert {r["_k"]: (r["_px"], r["_py"]) for r in made.hot.collect()}[3] == (-(-n // side),) * 2
    assert made.pairs == sum(sum(q == k for _, q, _ in e) for _, k, _ in e) and made.entries == 600 and made.dense
    assert np.allclose(dense(triples(product.multiply_split(a, a.transpose(), 500).df), 40, 40), x @ x.T)
    assert product.deal(a, a.transpose()).hot is None


def test_pairs_of_a_task_are_bounded(spark):
    """However hot an inner index, and whether or not the other operand has it."""
    left = [(i, 0, 1.0 + i % 7) for i in range(6000)] + [(i, 1, 1.0) for i in range(3000)] + [(i, 2 + i % 50, 1.0) for i in range(2000)]
    right = [(0, j, 2.0) for j in range(900)] + [(2 + j % 50, j, 1.0) for j in range(500)]
    a, b = matrix(spark, left, 6000, 52), matrix(spark, right, 52, 900)
    most = 400_000
    made = product.deal(a, b, most)
    x, y = (d.groupBy("k", "_c").count() for d in product.cells(a, b, made))
    each = x.join(y.withColumnRenamed("count", "other"), ["k", "_c"]).select((F.col("count") * F.col("other")).alias("n"))
    assert each.agg(F.sum("n"), F.max("n") <= 1.5 * most / 4).first() == (made.pairs, True)
    assert x.agg(F.max("count")).first()[0] <= most / 4
    task = F.pmod(F.xxhash64("k", "_c"), F.lit(-(-made.pairs // most)))
    tasks = x.join(y.withColumnRenamed("count", "other"), ["k", "_c"]).groupBy(task).agg(F.sum(F.col("count") * F.col("other")))
    assert max(r[1] for r in tasks.collect()) <= 3 * most
    want = product.multiply(a, "ab", b).df
    assert made.dense and want.exceptAll(product.multiply(a, "ab", b, most=most).df).isEmpty()


@pytest.mark.parametrize("cells, step", [(0, 7), (0, 1 << 20), (1 << 23, 7), (1 << 23, 1 << 20)])
def test_groups_multiply_as_joins_do(spark, monkeypatch, cells, step):
    """In every semiring, with sums in an array or of sorted keys, all pairs at once or a few at a time."""
    import pyarrow as pa

    monkeypatch.setattr(product, "CELLS", cells)
    monkeypatch.setattr(product, "STEP", step)
    a, x, e = hot_matrix(spark, 9)
    b = a.transpose()
    for ring in (product.PLUS_TIMES, product.MIN_PLUS, product.MAX_MIN, product.BOOLEAN):
        want = triples(product.joined(a, b, None, ring).groupBy("i", "j").agg(ring.add("v").alias("v")))
        left, right = (d.toArrow() for d in product.cells(a, b, product.deal(a, b, 500)))
        got = product.group_product(left, right, ring)
        assert sorted(zip(*(got.column(c).to_pylist() for c in "ijv"), strict=True)) == want
        assert product.group_product(left.slice(0, 0), right, ring).num_rows == 0
    assert isinstance(got, pa.Table)


def test_both_ways_of_a_product(spark, monkeypatch):
    a, x, _ = hot_matrix(spark)
    for gain in (0, 10**9):
        monkeypatch.setattr(product, "GAIN", gain)
        for most in (300, product.GROUP_PAIRS):
            assert np.allclose(dense(triples(product.multiply(a, "aat", most=most).df), 40, 40), x @ x.T)
    plan = product.multiply(a, "aat").df._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroups" not in plan  # few pairs an entry: a join


def test_packed_structure(spark):
    rng = random.Random(2)
    e = {(rng.randrange(30), rng.randrange(20)) for _ in range(60)} | {(0, 0), (29, 19)}
    f = {(rng.randrange(20), rng.randrange(200)) for _ in range(90)} | {(0, 63), (19, 191), (0, 127)}
    a, b = matrix(spark, [(i, k, 1) for i, k in e], 30, 20), matrix(spark, [(k, j, 1) for k, j in f], 20, 200)
    want = {(i, j) for i, k in e for q, j in f if q == k}
    assert {tuple(r) for r in product.structure(a, b).collect()} == want
    assert {r["i"]: r["nnz"] for r in product.row_sizes(a, b).collect()} == {i: sum(x == i for x, _ in want) for i in range(30)}
    masks = {(r["tile_row"], r["tile_col"]): (r["mask_lo"], r["mask_hi"], r["nnz"]) for r in symbolic.exact_masks(a, b).collect()}
    at = lambda i, j: 1 << (i % 4 * 8 + j % 8)
    tile = lambda t, half: sum(at(i, j) for i, j in want if (i // 8, j // 8) == t and i % 8 // 4 == half)
    assert masks == {t: (tile(t, 0), tile(t, 1), sum((i // 8, j // 8) == t for i, j in want)) for t in {(i // 8, j // 8) for i, j in want}}
    pairs = {(i // 8, j // 8) for i, k in e for q, j in f if q // 4 == k // 4}
    assert {tuple(r) for r in symbolic.candidates(a, b).collect()} == pairs >= set(masks)


def test_product_through_a_plan(spark):
    a = matrix(spark, FORTY, 40, 16)
    want = dense(triples(product.multiply(a, "aat").df), 40, 40)
    for variant in reorder.VARIANTS:
        c, made = reorder.multiply_reordered(a, "aat", made=reorder.plan(a, variant))
        assert np.allclose(dense(triples(c.df), 40, 40), want), variant
        assert reorder.bijective(made.perm, "row", 40) and reorder.bijective(made.perm, "inner", 16)


def test_plan_of_orders_and_parts(spark, small):
    """Tile counts before, after the coarse order and after both."""
    from quillmat.plans import data

    a = data.order_part(spark, small)
    p = reorder.plan(a)
    before = reorder.tile_count(a, reorder.identity(a))
    assert (before, before - p.stats["coarse_tile_reduction"], p.stats["num_tiles"]) == (4410, 3363, 3046)
    assert p.stats["coarse_ms"] > 0 and p.stats["fine_ms"] > 0 and p.table().where("value IS NULL").count() == 1


def test_trajectory_ranks_against_lists(spark):
    rng = random.Random(8)
    e = {(rng.randrange(60), rng.randrange(90)) for _ in range(160)}
    a = matrix(spark, [(i, k, 1) for i, k in e], 60, 90)
    left = {r: sorted({k // 4 for i, k in e if i // 8 == r}) for r in range(8)}
    for r in planner.tile_work(a, a.transpose()).collect():
        x, y = left[r["tile_row"]], left[r["tile_col"]]
        end = min(x[-1], y[-1])
        both = len(set(x) & set(y))
        assert r["matches"] == both and r["scans_union"] == len(x) + len(y) - both
        assert r["scans_trajectory"] == sum(t <= end for t in x) + sum(t <= end for t in y) - both


def test_sequential_values_follow_a_file(spark):
    df = spark.createDataFrame([(1, 1, 5.0, 0), (0, 0, 9.0, 1), (1, 1, 2.0, 2), (0, 0, 1.0, 3)], "i long, k long, v double, entry long")
    got = numbered(df, ["i", "k", "entry"], "p").orderBy("p").collect()
    assert [r["v"] for r in got] == [9.0, 1.0, 5.0, 2.0]
    assert sorted(r["v"] for r in Matrix(df, 2, 2).sequential(10, "entry").df.collect()) == [0.0, 1.0, 2.0, 3.0]
    assert {r["v"] for r in Matrix(df.drop("entry"), 2, 2).scrambled(9).df.collect()} <= set(map(float, range(1, 10)))


def test_manifest_results_and_sketches(spark, tmp_path):
    (tmp_path / "m.csv").write_text("Group,Name,rows,cols,nonzeros\nG,a,3,4,5\n")
    assert tuple(mtx.read_manifest(spark, str(tmp_path / "m.csv")).first()) == ("G", "a", 3, 4, 5)
    df = spark.createDataFrame([("x,y", 1.5)], "name string, ms double")
    for append in (False, True):
        mtx.write_csv(df, str(tmp_path / "out"), header=False, append=append)
    assert sorted(tuple(r) for r in spark.read.csv(str(tmp_path / "out")).collect()) == [("x,y", "1.5")] * 2
    plan = reorder.identity_plan(matrix(spark, FOUR, 16, 8))
    assert plan.stats["algorithm"] == "identity_baseline"
    mtx.write_csv(plan.table(), str(tmp_path / "stats"))
    assert spark.read.csv(str(tmp_path / "stats"), header=True).count() == 32


def test_global_places(spark):
    df = spark.range(1000).select(F.pmod(F.xxhash64("id"), F.lit(97)).alias("g"), "id", F.lit(2).cast("long").alias("x"))
    got = numbered(df, ["g", "id"], "p").orderBy("p").collect()
    assert [r["p"] for r in got] == list(range(1000)) and [(r["g"], r["id"]) for r in got] == sorted((r["g"], r["id"]) for r in got)
    assert [r["s"] for r in running(df, ["g", "id"], "x", "s").orderBy("g", "id").collect()] == list(range(0, 2000, 2))


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9), st.integers(-2, 2)), max_size=25))
def test_product_follows_an_order(spark, entries):
    a = matrix(spark, entries, 10, 10)
    perm = reorder.reversal(a)
    c = product.multiply(reorder.apply(a, perm), "ab", reorder.apply_inner_to_rows(a.transpose(), perm))
    assert np.allclose(dense(triples(reorder.restore_rows(c, perm).df), 10, 10), dense(triples(product.multiply(a, "aat").df), 10, 10))


def test_control_with_another_structure_is_an_error(spark, tmp_path, monkeypatch):
    from quillmat import __main__ as command

    mtx.write_mtx(matrix(spark, FOUR, 16, 8), str(tmp_path / "a.mtx"))
    args = command.arguments([str(tmp_path / "a.mtx"), "--aat", "--runs", "1", "--control", "original"])
    joined = product.joined
    monkeypatch.setattr(product, "joined", lambda *a: joined(*a).where("i > 0"))
    monkeypatch.setattr(product, "GAIN", 0)
    with pytest.raises(command.CheckFailed):
        command.run(spark, args)


def test_batch_of_matrices(spark, tmp_path):
    """Over a folder and a manifest; one that fails or takes too long doesn't end the others."""
    from quillmat import __main__ as command

    for name in ("G/a/a", "G/b/b", "H/a"):
        mtx.write_mtx(matrix(spark, FOUR, 16, 8), str(tmp_path / "parts"), one_file=True)
        target = tmp_path / f"{name}.mtx"
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(next((tmp_path / "parts").glob("part-*")).read_text())
    (tmp_path / "G" / "bad.mtx").write_text("x")
    (tmp_path / "m.csv").write_text("Group,Name,rows,cols,nonzeros\nH,a,16,8,4\nG,b,16,8,4\nG,none,1,1,1\n")
    lines = list(command.batch(spark, command.arguments([str(tmp_path / "G"), "--batch", "--aat", "--runs", "1", "--limit", "100", "--results", str(tmp_path / "r")])))
    assert [(x["left"].rsplit("/", 1)[-1], x["outcome"].split(":")[0], x.get("nnz_c")) for x in lines] == [("a.mtx", "done", 4), ("b.mtx", "done", 4), ("bad.mtx", "ValueError", None)]
    assert spark.read.csv(str(tmp_path / "r")).count() == 2
    lines = list(command.batch(spark, command.arguments([str(tmp_path / "m.csv"), "--batch", "--root", str(tmp_path), "--aat", "--runs", "1"])))
    assert [("/H/" in x["left"], x["outcome"]) for x in lines] == [(True, "done"), (False, "done")]
    slow = lambda: spark.range(4).repartition(2).mapInPandas(lambda chunks: (time.sleep(60) or c for c in chunks), "id long").count()
    started = time.monotonic()
    assert command.limited(spark, 2.0, slow) == (None, "timeout") and time.monotonic() - started < 40
    assert command.limited(spark, 30.0, lambda: {"x": spark.range(3).count()}) == ({"x": 3}, "done")


def test_operands_end_with_the_active_prefix(spark):
    a, b = matrix(spark, FOUR, 16, 8), matrix(spark, [(k, j, 1.0) for k in range(8) for j in range(3)], 8, 3)
    made = reorder.plan(a)
    left, right = reorder.operands(a, b, made)
    assert (left.m, left.n, right.m, right.n) == (4, 4, 4, 3) and left.df.count() == 4 and right.df.count() == 12
    assert triples(reorder.multiply_reordered(a, "ab", b, made)[0].df) == triples(product.multiply(a, "ab", b).df)
    assert triples(reorder.cut(a, 9, 5).df) == [(0, 0, 1.0), (1, 4, 2.0), (8, 1, 3.0)]


def test_prepared_operand_stays_where_it_is(spark, tmp_path):
    a, x = matrix(spark, FORTY, 40, 16), dense(FORTY, 40, 16)
    held = reorder.prepare(a, reorder.plan(a), "prepared_forty", str(tmp_path / "t"), 4)
    rng = random.Random(3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for _ in range(2):
            e = [(rng.randrange(16), rng.randrange(9), rng.randrange(1, 5)) for _ in range(40)]
            c = held.multiply(matrix(spark, e, 16, 9))
            assert np.allclose(dense(triples(c.df), 40, 9), x @ dense(e, 16, 9))
        met = held.multiply(matrix(spark, e, 16, 9)).df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = met.split("\n")
    scan = next(k for k, line in enumerate(lines) if "prepared_forty" in line)
    above = next(k for k in range(scan, -1, -1) if "SortMergeJoin" in lines[k])
    assert not any("Exchange" in line for line in lines[above : scan + 1]) and "Bucketed: true" in lines[scan]
    with pytest.raises(ValueError):
        held.multiply(matrix(spark, [], 15, 9))


def test_both_operands_change(spark, tmp_path):
    """Batches that run again count once, folds change nothing, and a query goes on after a stop in the midst of a batch."""
    rng = random.Random(11)
    e, f = ([(rng.randrange(6), rng.randrange(6), rng.randrange(1, 4)) for _ in range(9)] for _ in range(2))
    a, b = matrix(spark, e, 6, 6), matrix(spark, f, 6, 6)
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    schema = "side string, i long, k long, v double"
    x, y, batches = dense(e, 6, 6), dense(f, 6, 6), []
    for _ in range(5):
        batches.append([(rng.choice("AB"), rng.randrange(6), rng.randrange(6), float(rng.randrange(-2, 3))) for _ in range(6)])
    for n, rows in enumerate(batches[:4]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        delta.follow_both(a, b, spark.readStream.schema(schema).parquet(src), out, cp, every=2).awaitTermination(120)
        for side, i, k, v in rows:
            (x if side == "A" else y)[i, k] += v
        assert np.allclose(dense(triples(delta.product_now(a, b, out).df), 6, 6), x @ y)
        assert len(delta.parts(spark, f"{out}/C")["batch"]) <= 2
    # the next batch writes the product's share, then is broken off before the operands' changes
    change = spark.createDataFrame(batches[4], schema)
    write, seen = delta.write, []

    def broken(df, folder, name, number):
        if folder.endswith("/A") and name == "batch":
            raise OSError("lost")
        seen.append(folder)
        write(df, folder, name, number)

    delta.write = broken
    try:
        with pytest.raises(OSError):
            delta.step(change, 4, a, b, out, 2)
    finally:
        delta.write = write
    assert seen[-1].endswith("/C")
    for _ in range(2):  # as it runs again
        delta.step(change, 4, a, b, out, 2)
    for side, i, k, v in batches[4]:
        (x if side == "A" else y)[i, k] += v
    assert np.allclose(dense(triples(delta.product_now(a, b, out).df), 6, 6), x @ y)
    assert np.allclose(dense(triples(delta.state(spark, f"{out}/A")), 6, 6) + dense(e, 6, 6), x)


def test_stream_of_changes(spark, tmp_path):
    a = matrix(spark, FOUR, 16, 8)
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "i long, k long, v double"
    for part in ([(0, 0, 1.0), (4, 1, 2.0)], [(0, 0, 3.0)]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(src)
    q = delta.follow(a, spark.readStream.schema(schema).parquet(src), 2, out, str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert triples(delta.current(spark, out)) == [(0, 0, 4.0), (1, 1, 4.0)]


def test_heat_map_counts_every_entry(spark):
    a = matrix(spark, FORTY, 40, 16)
    h = mtx.heat_map(a, reorder.reversal(a), 16)
    assert h.count() == 256
    assert tuple(h.agg(F.sum("original_nnz"), F.sum("reordered_nnz")).first()) == (60, 60)
    plan = reorder.identity_plan(a)
    assert mtx.heat_meta(a, plan, 16).count() == 4 + len(plan.stats)
    assert len(plan.stats) == 32


@pytest.mark.parametrize("ranges", [2, 4096])
def test_values_at_ranks(spark, monkeypatch, ranges):
    from quillmat.functions import ordering

    monkeypatch.setattr(ordering, "RANGES", ranges)
    inf, nan = float("inf"), float("nan")
    rng = random.Random(4)
    groups = {"a": [5.0, 1.0, 1.0, 9.0], "b": [3.0], None: [2.0, 4.0], "far": [-inf, inf, nan, 1e308, -1e308, 0.0, 5e-324], "same": [7.0] * 9, "many": [rng.gauss(0, 1e6) for _ in range(300)], "near": [1 + k * 2**-52 for k in range(50)]}
    df = spark.createDataFrame([(k, x) for k, xs in groups.items() for x in xs] + [("b", None), ("empty", None)], "k string, x double").repartition(3)
    n = F.col("_n")
    got = {r["k"]: tuple(r)[1:] for r in ordering.at_ranks(df, ["k"], "x", {"low": n - n, "mid": F.floor(n / 2), "top": n - 1, "out": n}).collect()}
    order = {k: sorted(xs, key=lambda x: (x != x, x)) for k, xs in groups.items()}
    assert repr(sorted(got.items(), key=str)) == repr(sorted(((k, (v[0], v[len(v) // 2], v[-1], None)) for k, v in order.items()), key=str))
    both = {r["k"]: (r["middle"], r["upper_middle"]) for r in ordering.medians(df.where("k <> 'far' OR k IS NULL"), ["k"], "x").collect()}
    assert both == {k: (v[(len(v) - 1) // 2] / 2 + v[len(v) // 2] / 2, v[len(v) // 2]) for k, v in order.items() if k != "far"}
    every = sorted(x for k, xs in groups.items() if k != "far" for x in xs)
    assert tuple(ordering.at_ranks(df.where("k <> 'far' OR k IS NULL"), [], "x", {"q": F.floor(n / 10)}).first()) == (every[len(every) // 10],)
    plan = ordering.medians(df, ["k"], "x")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "percentile" not in plan


def test_windows_are_packed_as_one_by_one():
    """Against the rule written out for one window: anchor, then the best fit for the group so far."""
    from fractions import Fraction

    rng = np.random.default_rng(3)
    cols = {c: rng.integers(0, high, (60, 32)) for c, high in (("degree", 5), ("soft_bucket", 3), ("panel_occupancy", 4), ("panel_min", 6), ("f0", 8), ("f1", 4))}
    cols["f0"][::7] = -cols["f0"][::7] - 1  # words with the top bit
    cols["id"] = np.argsort(rng.random((60, 32)), axis=1) + 100
    cols["panel_max"] = cols["panel_min"] + rng.integers(0, 5, (60, 32))
    cols["panel_min"][cols["degree"] == 0] = cols["panel_max"][cols["degree"] == 0] = -1
    cols["panel_span"] = np.where(cols["degree"] == 0, 0, cols["panel_max"] - cols["panel_min"] + 1)
    there = np.arange(32) < rng.integers(1, 33, 60)[:, None]

    def alone(ids, group):
        word = lambda r: (r["f0"] % 2**64) | (r["f1"] % 2**64) << 64
        out = []
        while ids:
            lead = min(ids, key=lambda r: (r["degree"] == 0, -r["soft_bucket"], -r["panel_occupancy"], r["panel_min"], r["panel_span"], -r["degree"], r["f0"] % 2**64, r["f1"] % 2**64, r["id"]))
            mine = [lead]
            ids.remove(lead)
            while ids and len(mine) < group:
                bits = 0
                for r in mine:
                    bits |= word(r)
                held = lambda more: [r for r in [*mine, *more] if r["panel_min"] >= 0]  # noqa: E731, B023
                span = lambda rs: max(r["panel_max"] for r in rs) - min(r["panel_min"] for r in rs) + 1 if rs else 0
                fit = lambda r: (abs(lead["soft_bucket"] - r["soft_bucket"]), (word(r) & ~bits).bit_count(), -Fraction((word(r) & bits).bit_count(), max(1, (word(r) | bits).bit_count())), -(word(r) & bits).bit_count(), span(held([r])) - span(held([])), abs(lead["degree"] - r["degree"]), r["id"])  # noqa: E731, B023
                mine.append(min(ids, key=fit))
                ids.remove(mine[-1])
            out += [r["id"] for r in mine]
        return out

    for group in (4, 8):
        got = reorder.packed_windows({c: x.astype(np.int64) for c, x in cols.items()}, there, group)
        for w in range(60):
            rows = [{c: int(x[w, p]) for c, x in cols.items()} for p in range(32) if there[w, p]]
            n = len(rows)
            assert got[w, :n].tolist() == alone(rows, group) and (got[w, n:] == -1).all()


def test_labels_of_gathered_links(spark):
    from quillmat.operators import graph

    rng = random.Random(6)
    for links in ([(i, i + 1) for i in range(500)], [(rng.randrange(300), rng.randrange(300)) for _ in range(200)], [(9, 3), (3, 9), (4, 4)], []):
        df = spark.createDataFrame(links, "src long, dst long")
        assert triples(graph.components(df)) == triples(graph.components(df, local=0))


def traversed(a, budget, local):
    rows, components, rounds = reorder.traversal(a, budget, local)
    return [tuple(r) for r in rows.orderBy("component", "level", "place").select("vid", "component", "level").collect()], components, rounds


def test_gathered_graphs_are_traversed_alike(spark):
    """One task for all, tasks for small components, and level by level until little is left give the same order."""
    rng = random.Random(1)
    a = matrix(spark, {(rng.randrange(60), rng.randrange(50), 1) for _ in range(70)}, 60, 50)
    for budget in (2048, 7):
        want = traversed(a, budget, 1 << 20)
        for local in (0, 40):
            assert traversed(a, budget, local) == want


def test_a_path_of_more_levels_than_the_budget(spark):
    a = matrix(spark, [(i, i, 1) for i in range(1500)] + [(i, i + 1, 1) for i in range(1499)], 1500, 1500)
    started = time.monotonic()
    p = reorder.plan(a)
    assert time.monotonic() - started < 60
    s = p.stats
    assert (s["num_tiles"], s["coarse_components"], s["coarse_levels"], s["coarse_candidate_accepted"], s["accepted_row_windows"], s["accepted_inner_windows"]) == (562, 1, 2048, 0, 0, 0)
    assert (s["active_rows"], s["active_inner"]) == (1500, 1500)
    assert reorder.bijective(p.perm, "row", 1500) and reorder.bijective(p.perm, "inner", 1500)
    proposal = reorder.coarse(a)[0]
    assert reorder.tile_count(a, proposal) == 562 and reorder.bijective(proposal, "row", 1500)


def test_cells_of_a_block_meet_packed(spark):
    """Between groups and sums a cell takes few bytes, whatever its type, and blocks end no tile."""
    from quillmat.operators import blocks

    rng = np.random.default_rng(4)
    grid = blocks.Grid.of(1000, 70, 30 * blocks.BLOCK)
    at = np.unique(rng.integers(0, 70_000, 9000))
    i, j = at // 70, at % 70
    for v in (np.ones(len(at)), np.arange(len(at)) - 5.0, rng.random(len(at)), np.where(at % 2, -0.0, np.inf)):
        sent = blocks.messages(i, j, v, grid)
        got = []
        for b in set(sent["_block"].to_pylist()):
            x, y, z = blocks.combine(sent.filter(pc.equal(sent["_block"], b)), product.PLUS_TIMES, grid)
            assert len({(p // 16 % grid.r, q // 16 % grid.s) for p, q in zip(x, y, strict=True)}) == 1
            got += zip(x.tolist(), y.tolist(), map(repr, z.tolist()), strict=True)
        assert sorted(got) == sorted(zip(i.tolist(), j.tolist(), map(repr, v.tolist()), strict=True))
    assert sum(map(len, blocks.messages(i, j, np.ones(len(at)), grid)["places"].to_pylist())) <= 2 * len(at)


def test_rows_that_are_shuffled_don_t_grow_with_pairs(spark):
    """A product's sum gets a row for each group and block, parents none for each pair of inner ones."""
    a = matrix(spark, [(i, k, 1.0) for i in range(160) for k in range(0, 320, 16)], 160, 320)
    assert symbolic.parents(a, a.transpose()).count() == 100
    assert tuple(symbolic.raw_pairs(a, a.transpose()).first()) == (2000, 100)
    for df in (symbolic.parents(a, a.transpose()), product.multiply(a, "aat").df, planner.match_counts(a, a.transpose())):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "FlatMapCoGroups" in plan and "Join" not in plan.split("FlatMapCoGroups")[0]


def test_rows_are_put_back_without_a_second_product(spark):
    """The checks look at the left operand's rows."""
    a = matrix(spark, FORTY, 40, 16)
    perm = reorder.by_degree(a)
    boom = Matrix(spark.range(4).select(F.raise_error(F.lit("computed")).cast("long").alias("i"), F.col("id").alias("k"), F.lit(1.0).alias("v")), 40, 40)
    assert reorder.restore_rows(boom, perm, 40, reorder.apply(a, perm)).m == 40


def test_slices_of_heavy_tiles_come_from_packed_lists_not_from_rows_of_steps(spark):
    """As a plain count over the merged lists says, with lists that end apart, and without a row for each step."""
    rng = np.random.default_rng(3)
    left, right = {0: np.unique(rng.integers(0, 900, 300)), 70: np.unique(rng.integers(0, 70_000, 200))}, {5: np.unique(rng.integers(0, 900, 400)), 6: np.array([69_000])}
    tile = [(side, x, t) for side, lists in enumerate((left, right)) for x, ts in lists.items() for t in ts.tolist()]
    packed = spark.createDataFrame(tile, "side long, id long, tk long").groupBy("side", "id").applyInArrow(planner.packed_list, "side long, id long, kt string, gaps binary").toArrow()
    heavy = pa.table({"tile_row": [0, 0, 70], "tile_col": [5, 6, 5], "chunks": [7, 2, 3]})
    want = {}
    for r, c, n in zip(*(heavy[x].to_pylist() for x in heavy.column_names), strict=True):
        end = min(left[r].max(), right[c].max())
        steps = [9.0 if t in left[r] and t in right[c] else 1.0 for t in np.union1d(left[r], right[c]) if t <= end]
        before = 0.0
        for x in steps:
            key = (r, c, int(before * n / sum(steps)))
            want[key] = (want.get(key, (0, 0.0))[0] + 1, want.get(key, (0, 0.0))[1] + x)
            before += x
    got = planner.sliced(heavy, packed, planner.Cost()).to_pylist()
    assert {(x["tile_row"], x["tile_col"], x["chunk"]): (x["steps"], x["work"]) for x in got} == want and len(got) == len(want)


def test_links_of_a_partition_become_stars_before_the_rounds(spark):
    """As many links as vertices less one for each tree, whatever the links between them, and the same components."""
    from quillmat.operators import graph

    rng = np.random.default_rng(5)
    src, dst = rng.integers(0, 40, (2, 4000))
    far = np.repeat(np.arange(3) * 1000, 4000)
    links = pa.RecordBatch.from_arrays([pa.array(np.tile(src, 3) + far), pa.array(np.tile(dst, 3) + far)], names=["src", "dst"])
    (stars,) = graph.forests(iter([links.slice(0, 5000), links.slice(5000)]))
    assert len(stars) == 3 * 39 and set(stars["dst"].to_pylist()) == {0, 1000, 2000}
    df = spark.createDataFrame(pa.Table.from_batches([links]).to_pandas())
    got = {r["vid"]: r["label"] for r in graph.components(df, local=0).collect()}
    assert got == {1000 * c + v: 1000 * c for c in range(3) for v in range(40)}


def random_matrix(spark, m, n, entries, seed):
    rng = np.random.default_rng(seed)
    return matrix(spark, sorted({(int(i), int(k), 1.0) for i, k in zip(rng.integers(0, m, entries), rng.integers(0, n, entries), strict=True)}), m, n)


def test_output_tiles_are_not_joined_to_their_work(spark, monkeypatch):
    """Lists go to the blocks of C, several here, where its cells are."""
    from quillmat.operators import blocks

    a, b = random_matrix(spark, 90, 120, 200, 1), random_matrix(spark, 120, 70, 200, 2)
    monkeypatch.setattr(blocks, "BLOCK", 40)
    work = planner.tile_work(a, b)
    assert "Join" not in work._jdf.queryExecution().optimizedPlan().toString()
    x, y = ([(r["i"], r["k"]) for r in d.df.collect()] for d in (a, b))
    cells = {(i, j) for i, k in x for q, j in y if k == q}
    want = {}
    for r, c in {(i // 8, j // 8) for i, j in cells}:
        left, right = {k // 4 for i, k in x if i // 8 == r}, {i // 4 for i, j in y if j // 8 == c}
        both, end = len(left & right), min(max(left), max(right))
        want[r, c] = (both, len({t for t in left | right if t <= end}), len(left | right), sum((i // 8, j // 8) == (r, c) for i, j in cells))
    assert {(t[0], t[1]): tuple(t[2:6]) for t in work.collect()} == want


def test_candidates_are_not_joined_to_their_children(spark, monkeypatch):
    from quillmat.operators import blocks

    a, b = random_matrix(spark, 90, 120, 150, 3), random_matrix(spark, 120, 70, 150, 4)
    monkeypatch.setattr(blocks, "BLOCK", 40)
    kids = symbolic.children(a, b)
    assert "Join" not in kids._jdf.queryExecution().optimizedPlan().toString()
    x, y = ([(r["i"], r["k"]) for r in d.df.collect()] for d in (a, b))
    tiles_ = {(i // 8, j // 8) for i, k in x for q, j in y if k == q}
    want = {(i // 16, j // 16): sum((r // 2, c // 2) == (i // 16, j // 16) for r, c in tiles_) for i, k in x for q, j in y if k // 16 == q // 16}
    assert {(r[0], r[1]): r[2] for r in kids.collect()} == want and 0 in want.values()


def test_a_difference_meets_in_the_blocks_of_the_product(spark):
    """C's coordinates go from the groups to the blocks once, and what the other side has outside C stays."""
    a = Matrix(spark.createDataFrame([(i, k, 1.0) for i in range(40) for k in range(0, 60, 7) if (i * k) % 5 < 2], "i long, k long, v double"), 40, 60)
    c = {(r["i"], r["j"]) for r in product.structure(a, a.transpose()).collect()}
    own = {(0, 0), (3, 39), (39, 40), (70, 2), *list(c)[:20]}
    found = product.difference(a, a.transpose(), spark.createDataFrame(list(own), "i long, j long"))
    assert sorted(map(tuple, found.collect())) == sorted([("left", *x) for x in c - own] + [("right", *x) for x in own - c])
    assert found._jdf.queryExecution().optimizedPlan().toString().count("FlatMapGroupsInArrow") == 1


def test_tile_rows_are_counted_in_blocks(spark):
    a = Matrix(spark.createDataFrame([(i, (i * 13 + t) % 90, 1.0) for i in range(50) for t in (0, 5, 41)], "i long, k long, v double"), 50, 90)
    want = symbolic.exact_masks(a, a.transpose()).groupBy("tile_row").agg(F.count(F.lit(1)), F.sum("nnz"))
    assert sorted(map(tuple, symbolic.tile_rows_held(a, a.transpose()).collect())) == sorted(map(tuple, want.collect()))
    sizes = symbolic.exact_masks(a, a.transpose()).groupBy("nnz").count()
    assert sorted(map(tuple, symbolic.mask_sizes(a, a.transpose()).collect())) == sorted(map(tuple, sizes.collect()))


def test_operands_of_a_structure_travel_without_values(spark):
    a = Matrix(spark.createDataFrame([(0, 1, 2.0), (1, 1, 3.0)], "i long, k long, v double"), 2, 2)

    def width(ring):
        sent, _ = product.group_messages(a, a.transpose(), product.deal(a, a.transpose()), ring)
        plan, sizes = sent._jdf.queryExecution().optimizedPlan().children(), []
        for n in range(plan.size()):
            sizes.append(plan.apply(n).output().size())
        return sizes

    assert width(None) == [4, 4]  # the group twice, as key and as column, k, and i or j
    assert width(product.PLUS_TIMES) == [5, 5]


def test_messages_take_the_bits_that_places_and_values_need():
    """Places some 60,000 apart would take four bytes each as integers, products of small numbers two."""
    rng = np.random.default_rng(1)
    at = np.sort(rng.choice(3_000_000_000, 50_000, replace=False))
    grid, v = blocks.Grid(100_000, 30_000, 1, 1), (rng.integers(1, 51, len(at)) * rng.integers(1, 51, len(at))).astype(float)
    sent = blocks.messages(at // 30_000, at % 30_000, v, grid)
    assert sum(len(x) for c in ("places", "vals") for x in sent[c].to_pylist()) < 4 * len(at)
    i, j, w = blocks.combine(sent, product.PLUS_TIMES, grid)
    assert (i * 30_000 + j == at).all() and (w == v).all()
    for kind in ("u1", "u2", "u4", "i4", "i8", "f8"):
        for n in (0, 1, 9):
            x = rng.integers(0, 200, n).astype(kind)
            assert (blocks.unpacked(blocks.packed(x), kind) == x).all()


def test_a_pass_takes_whole_windows_as_profiles_and_costs_do(spark, monkeypatch):
    """The plan's windows are packed where their entries are, without a join, and as the aggregates would."""
    a = random_matrix(spark, 150, 90, 700, 6)
    want = reorder.plan(a, "unguarded"), reorder.plan(a, "fine")
    monkeypatch.setattr(reorder, "MOST_OF_ONE", 0)
    for variant, p in zip(("unguarded", "fine"), want, strict=True):
        q = reorder.plan(a, variant)
        assert triples(p.perm) == triples(q.perm)
        assert {k: v for k, v in p.stats.items() if not k.endswith("_ms")} == {k: v for k, v in q.stats.items() if not k.endswith("_ms")}
    monkeypatch.setattr(reorder, "MOST_OF_ONE", 1 << 22)
    monkeypatch.setattr(reorder, "profiles", None)
    monkeypatch.setattr(reorder, "PACKED", 1)
    assert triples(reorder.plan(a, "fine").perm) == triples(want[1].perm)


def test_few_rounds_need_no_components(spark, monkeypatch):
    a = matrix(spark, [(i, i, 1) for i in range(30)] + [(i, i + 1, 1) for i in range(20)], 30, 31)
    want = traversed(a, 9, 1 << 20)
    monkeypatch.setattr(reorder, "components", None)
    assert traversed(a, 9, 0) == want and want[2] == 9


def test_stars_that_share_vertices_are_a_smaller_graph(spark, monkeypatch):
    """Links of the same components in many partitions: their centres are connected, no rounds over all links."""
    from quillmat.operators import graph

    rng = random.Random(9)
    pairs = [(1000 * c + rng.randrange(200), 1000 * c + rng.randrange(200)) for c in range(4) for _ in range(2000)]
    df = spark.createDataFrame(pairs, "src long, dst long").repartition(4)
    want = triples(graph.components(df))
    monkeypatch.setattr(graph, "rounds", None)
    assert triples(graph.components(df, local=50, dealt=True)) == want and len({x for _, x in want}) == 4


def test_slices_look_at_single_steps_only_where_parts_begin():
    """164 million steps of 4096 tiles, which a merge of the lists would take one by one; some tiles against that merge."""
    rng = np.random.default_rng(4)
    rows, cols = ([np.sort(rng.choice(40_000, 20_000, replace=False)) for _ in range(64)] for _ in range(2))
    cols[3], cols[4] = cols[3][:900], rows[7]
    parts = [planner.packed_list(pa.table({"side": [side] * len(t), "id": [x] * len(t), "tk": t})) for side, ts in enumerate((rows, cols)) for x, t in enumerate(ts)]
    r, c = (x.ravel() for x in np.indices((64, 64)))
    heavy = pa.table({"tile_row": r, "tile_col": c, "chunks": 1 + (r + c) % 8})
    started = time.monotonic()
    got = planner.sliced(heavy, pa.concat_tables(parts), planner.Cost())
    assert time.monotonic() - started < 2
    at, found = (got[x].to_numpy() for x in ("tile_row", "tile_col")), list(zip(*(got[x].to_pylist() for x in ("chunk", "steps", "work")), strict=True))
    at = np.stack(list(at), axis=1)
    for x, y in ((0, 0), (7, 4), (9, 3), (63, 62), (7, 7)):
        end, n = min(rows[x][-1], cols[y][-1]), 1 + (x + y) % 8
        both = np.union1d(rows[x], cols[y])
        both = both[both <= end]
        weight = np.where(np.isin(both, rows[x]) & np.isin(both, cols[y]), 9, 1)
        part = (np.cumsum(weight) - weight) * n // weight.sum()
        want = [(p, int((part == p).sum()), float(weight[part == p].sum())) for p in np.unique(part).tolist()]
        assert [found[t] for t in np.flatnonzero((at == (x, y)).all(axis=1))] == want


def test_lists_take_the_bits_that_their_gaps_need():
    tk = np.sort(np.random.default_rng(2).choice(1_800_000, 5000, replace=False))
    packed = planner.packed_list(pa.table({"side": [0] * 5000, "id": [1] * 5000, "tk": tk})).to_pylist()[0]
    assert len(packed["gaps"]) < 1.5 * len(tk) and (planner.listed(packed["gaps"], packed["kt"]) == tk).all()


def test_crowded_structures_come_from_stripes(spark, monkeypatch):
    """Where pairs are many times the cells, blocks OR the operands that cross them; no cells of groups are sent."""
    a, b = random_matrix(spark, 90, 50, 1500, 3), random_matrix(spark, 50, 70, 1200, 4)
    hollow = Matrix(a.df.where("i < 20 OR k < 9"), 90, 50)
    want = [triples(product.grouped(x, b, product.deal(x, b), None, finish=blocks.places, schema="i long, j long")) for x in (a, hollow)]
    kids = triples(symbolic.children(a, b))
    monkeypatch.setattr(product, "CROWDED", 0)
    monkeypatch.setattr(product, "STRIPED", 1000)
    monkeypatch.setattr(product, "SLAB", 100)
    monkeypatch.setattr(product, "group_cells", None)
    assert [triples(product.structure(x, b)) for x in (a, hollow)] == want
    monkeypatch.undo()
    monkeypatch.setattr(product, "CROWDED", 0)
    monkeypatch.setattr(product, "CELLS", 8)
    assert triples(symbolic.children(a, b)) == kids and triples(product.structure(a, b)) == want[0]


def test_raw_pairs_come_from_one_count_of_the_parents(spark, monkeypatch):
    a, b = random_matrix(spark, 90, 120, 300, 5), random_matrix(spark, 120, 70, 300, 6)
    x, y = ({(r["i"] // 16, r["k"] // 16) for r in d.df.collect()} for d in (a, b))
    met = [(i, j) for i, k in x for q, j in y if k == q]
    monkeypatch.setattr(product, "product_count", None)
    monkeypatch.setattr(symbolic, "product_count", None, raising=False)
    assert [tuple(r) for r in symbolic.raw_pairs(a, b).collect()] == [(len(met), len(set(met)))]
