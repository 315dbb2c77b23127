"""Matrix Market files, axis orders, manifests, and the diagnostic tables as CSV."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import heat_bin
from ..functions.ordering import numbered, settled
from ..operators.matrix import Matrix
from ..operators.reorder import Plan, apply, external_plan, operands, summary

#: The words of a banner.
BANNER, FIELDS, SCHEMES = "%%MatrixMarket", ("real", "complex", "pattern", "integer"), ("general", "symmetric", "hermitian", "skew-symmetric")


@dataclass(frozen=True)
class Header:
    field: str
    scheme: str
    m: int
    n: int
    entries: int


def banner(line: str) -> tuple[str, str]:
    """field and scheme; case counts only in the first word. Dense arrays are refused."""
    words = line.split()
    if len(words) < 5 or words[0] != BANNER:
        raise ValueError("no Matrix Market banner")
    thing, form, kind, scheme = (w.lower() for w in words[1:5])
    if thing != "matrix" or form not in ("coordinate", "array") or kind not in FIELDS or scheme not in SCHEMES:
        raise ValueError(f"unsupported Matrix Market type: {line}")
    if form == "array" or kind == "real" and scheme == "hermitian" or kind == "pattern" and scheme in ("hermitian", "skew-symmetric"):
        raise ValueError(f"invalid Matrix Market type: {line}")
    return kind, scheme


def read_mtx(spark: SparkSession, path: str, expand: bool = True, entry_ids: bool = False) -> tuple[Matrix, Header]:
    """The matrix (indices from 0) and its header, from a file or the parts in a folder, in the order of their names. Complex values keep their real part, patterns are 1.

    Symmetric and hermitian files have their off-diagonal entries mirrored; skew-symmetric ones stay as they are.
    Missing, extra, unreadable or out-of-range entries are errors. ``entry_ids`` (with ``expand`` off) keeps the entries'
    order in the file as the column entry_id. One pass finds banner and size line, one counts all faults.
    """
    if entry_ids and expand:
        raise ValueError("mirrored entries have no place in the file")
    # a place in the file, or in files by name: the splits of a file in order, and lines within each
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line"))
    lines = spark.read.text(path).select("value", at.alias("_at"))
    told = ~F.col("value").startswith("%") & (F.trim("value") != "")
    first, head = lines.agg(F.min_by("value", "_at"), F.min_by(F.when(told, F.struct("_at", "value")), F.when(told, F.col("_at")))).first()
    kind, scheme = banner(first or "")
    data = lines.where(told)
    size = head["value"].split() if head else []
    if len(size) < 3 or not all(x.isdigit() for x in size[:3]):
        raise ValueError("no size line")
    m, n, count = map(int, size[:3])
    spot = F.struct(F.lit(head["_at"]["file"]).alias("file"), F.lit(head["_at"]["split"]).alias("split"), F.lit(head["_at"]["line"]).alias("line"))
    rest = data.where(F.col("_at") > spot).select("_at", F.split(F.trim("value"), r"\s+").alias("w"))
    value = F.lit(1.0) if kind == "pattern" else F.try_element_at("w", F.lit(3)).try_cast("double")
    df = rest.select((F.try_element_at("w", F.lit(1)).try_cast("long") - 1).alias("i"), (F.try_element_at("w", F.lit(2)).try_cast("long") - 1).alias("k"), value.alias("v"), F.col("_at").alias("entry_id"))
    outside = (F.col("i") < 0) | (F.col("i") >= m) | (F.col("k") < 0) | (F.col("k") >= n)
    bad = df.agg(F.count(F.lit(1)), F.count(F.when(F.col("i").isNull() | F.col("k").isNull() | F.col("v").isNull(), 1)), F.count(F.when(outside, 1))).first()
    if bad[0] != count or bad[1] or bad[2]:
        raise ValueError(f"{bad[0]} entries, {bad[1]} of them unreadable, {bad[2]} outside {m} x {n}; {count} announced")
    a = Matrix(df if entry_ids else df.drop("entry_id"), m, n)
    return (a.symmetrised(scheme) if expand else a), Header(kind, scheme, m, n, count)


def write_mtx(a: Matrix, path: str, pattern: bool = False, one_file: bool = False) -> None:
    """Coordinate files, rows in order, indices from 1. The first part begins with the header, and parts in the order of
    their names make up the file; ``one_file`` writes a single part instead, in one task.
    """
    spark, n = a.df.sparkSession, a.df.count()
    head = [f"{BANNER} matrix coordinate {'pattern' if pattern else 'real'} general", f"{a.m} {a.n} {n}"]
    body = a.df.select("i", "k", "v", F.concat_ws(" ", (F.col("i") + 1).cast("string"), (F.col("k") + 1).cast("string"), *([] if pattern else [F.format_string("%.16g", "v")])).alias("value"))
    top = spark.createDataFrame([(-2 + k, -1, 0.0, h) for k, h in enumerate(head)], body.schema)
    parts = 1 if one_file else int(spark.conf.get("spark.sql.shuffle.partitions"))
    every = body.unionByName(top).repartitionByRange(parts, "i", "k", "v").sortWithinPartitions("i", "k", "v")
    every.select("value").write.mode("overwrite").text(path)


def write_reordered(a: Matrix, perm: DataFrame, path: str, one_file: bool = False) -> None:
    """The pattern under new ids, every entry kept."""
    write_mtx(apply(a, perm), path, True, one_file)


def write_diagnostics(a: Matrix, plan: Plan, folder: str, bins: int = 256, b: Matrix | None = None, parent_bins: int = 64) -> None:
    """A plan's files below ``folder``: permutation, stats, heatmap, heatmap_meta (CSV) and reordered (Matrix Market).

    With the right operand ``b`` also parent_heatmap and parent_meta, of the operands under the plan.
    """
    folder = folder.rstrip("/")
    if b is not None:
        left, right = operands(a, b, plan)
        write_parent_diagnostics(left, right, folder, parent_bins)
    write_csv(permutation_rows(plan.perm), f"{folder}/permutation")
    write_csv(plan.table(), f"{folder}/stats")
    write_csv(heat_map(a, plan.perm, bins), f"{folder}/heatmap")
    write_csv(heat_meta(a, plan, bins), f"{folder}/heatmap_meta")
    write_reordered(a, plan.perm, f"{folder}/reordered")


def write_parent_diagnostics(a: Matrix, b: Matrix, folder: str, bins: int = 64) -> None:
    """parent_heatmap (the grid) and parent_meta (extents, bins and the grid's sums) as CSV; the grid is computed once."""
    grid = settled(parent_heat_map(a, b, bins))
    write_csv(grid, f"{folder}/parent_heatmap")
    write_csv(parent_heat_meta(grid, a, b, bins), f"{folder}/parent_meta")


def parent_heat_meta(grid: DataFrame, a: Matrix, b: Matrix, bins: int) -> DataFrame:
    """key, value of a grid of parents: its extents, bins, and the sums of its columns."""
    names = [c for c in grid.columns if c not in ("bin_row", "bin_col")]
    sums = grid.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names)).first()
    rows = {"parent_rows": -(-a.m // 16), "parent_cols": -(-b.n // 16), "bins": bins} | {n: sums[n] for n in names}
    return grid.sparkSession.createDataFrame([(k, int(v)) for k, v in rows.items()], "key string, value long").coalesce(1)


def read_order(spark: SparkSession, path: str, size: int, name: str) -> DataFrame:
    """perm of one axis from a file of ``size`` old ids, blank-separated, the one at place p getting the new id p."""
    words = spark.read.text(path, wholetext=False).select(F.posexplode(F.split(F.trim("value"), r"\s+")).alias("at", "w"), F.monotonically_increasing_id().alias("line")).where("w <> ''")
    got = words.agg(F.count(F.lit(1)), F.count(F.when(F.col("w").rlike(r"^\d+$"), 1)), F.count_distinct(F.col("w").try_cast("long")), F.min(F.col("w").try_cast("long")), F.max(F.col("w").try_cast("long"))).first()
    if tuple(got) != (size, size, size, 0, size - 1) and not (size == 0 and got[0] == 0):
        raise ValueError(f"{path} is no order of {size} ids")
    placed = numbered(words, ["line", "at"], "new_id")
    return placed.select(F.lit(name).alias("axis"), F.col("w").cast("long").alias("old_id"), "new_id")


def read_plan(spark: SparkSession, a: Matrix, rows: str | None, inner: str | None = None, name: str = "file") -> Plan:
    """The plan of order files: one for each axis, or one for both of a square matrix. Both or none must be given."""
    if rows is None or (inner is None and a.m != a.n):
        raise ValueError("an order file for each axis is needed")
    perm = read_order(spark, rows, a.m, "row").unionByName(read_order(spark, inner or rows, a.n, "inner"))
    return external_plan(a, perm, name)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema="`Group` string, Name string, rows long, cols long, nonzeros long")


def manifest_paths(spark: SparkSession, path: str, root: str) -> list[str]:
    """The manifest's matrices that are below ``root``, in its order, wherever sets of matrices keep them."""
    found: dict[str, list[str]] = {}
    for r in find_matrices(spark, root).select("path").toLocalIterator():
        found.setdefault(r["path"].rsplit("/", 1)[-1], []).append(r["path"])
    out = []
    for r in read_manifest(spark, path).toLocalIterator():
        here = found.get(f"{r['Name']}.mtx", [])
        out += [next((p for p in here if f"/{r['Group']}/" in p), here[0])] if here else []
    return out


def find_matrices(spark: SparkSession, folder: str) -> DataFrame:
    """path, length of all .mtx files below a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.mtx").option("recursiveFileLookup", True).load(folder)
    return files.select("path", "length").orderBy("path")


def permutation_rows(perm: DataFrame) -> DataFrame:
    """axis, old_id, new_id, new_to_old_at_new_id: the last from the inverse, so it must repeat old_id."""
    back = perm.select("axis", F.col("new_id").alias("_at"), F.col("old_id").alias("new_to_old_at_new_id"))
    return perm.join(back.withColumnRenamed("_at", "new_id"), ["axis", "new_id"]).select("axis", "old_id", "new_id", "new_to_old_at_new_id")


def heat_map(a: Matrix, perm: DataFrame, bins: int = 256) -> DataFrame:
    """bin_row, bin_col, original_nnz, reordered_nnz of all bins x bins cells; entries count one by one."""
    if not 16 <= bins <= 1024:
        raise ValueError("16 to 1024 bins")
    binned = lambda m, name: m.df.select(heat_bin("i", a.m, bins).alias("bin_row"), heat_bin("k", a.n, bins).alias("bin_col")).groupBy("bin_row", "bin_col").agg(F.count(F.lit(1)).alias(name))
    grid = a.df.sparkSession.range(bins * bins).select(F.floor(F.col("id") / bins).cast("long").alias("bin_row"), F.pmod("id", F.lit(bins)).alias("bin_col"))
    both = grid.join(binned(a, "original_nnz"), ["bin_row", "bin_col"], "left").join(binned(apply(a, perm), "reordered_nnz"), ["bin_row", "bin_col"], "left")
    return both.select("bin_row", "bin_col", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("original_nnz", "reordered_nnz")))


def heat_meta(a: Matrix, plan: Plan, bins: int = 256) -> DataFrame:
    """key, value: dimensions, then the plan's figures under their names in heat-map files (fixed values)."""
    rename = {"num_tiles": "unified_tiles", "active_row_tiles": "unified_active_row_tiles", "active_k_tiles": "unified_active_k_tiles", "sparse_tiles": "unified_sparse_tiles", "dense_tiles": "unified_dense_tiles", "payload": "unified_payload", "row_tile_reduction": "exact_row_tile_reduction", "inner_tile_reduction": "exact_inner_tile_reduction"}
    moved = list(plan.stats)[: list(plan.stats).index("inner_displacement_sum") + 1]
    tiles = [k for k, v in rename.items() if v.startswith("unified_")]
    order = [*moved, *tiles, *(k for k in plan.stats if k not in moved and k not in tiles)]
    stats = {"rows": a.m, "cols": a.n, "nnz": a.df.count(), "bins": bins} | {rename.get(k, k): plan.stats[k] for k in order}
    return a.df.sparkSession.createDataFrame([(k, None if v is None else str(v)) for k, v in stats.items()], "key string, value string").coalesce(1)


def movement(perm: DataFrame) -> DataFrame:
    """key, value of how far ids move."""
    s = summary(perm).groupBy().pivot("axis", ["row", "inner"]).agg(F.first("moved").alias("moved"), F.first("displacement").alias("displacement"))
    return s.select(F.expr("stack(4, 'moved_rows', row_moved, 'moved_inner', inner_moved, 'row_displacement_sum', row_displacement, 'inner_displacement_sum', inner_displacement) AS (key, value)"))


def parent_heat_map(a: Matrix, b: Matrix, bins: int = 64) -> DataFrame:
    """bin_row, bin_col, a_tiles, b_tiles, candidates, nonempty, empty, children1..children4 over parents of 16 x 16.

    Left and right tiles are binned by their own parents (2 x 4 and 4 x 2 tiles), candidates by theirs.
    """
    from ..functions.columns import div
    from ..operators.symbolic import children
    from ..operators.tiles import tiles

    lit = lambda x: max(1, -(-x // 16))
    rows, inner, cols = lit(a.m), lit(a.n), lit(b.n)
    put = lambda d, r, rn, c, cn: d.select(heat_bin(r, rn, bins).alias("bin_row"), heat_bin(c, cn, bins).alias("bin_col"), *[x for x in d.columns if x == "children"])
    at = put(tiles(a).select(div("tile_row", 2).alias("r"), div("tile_col", 4).alias("c")), "r", rows, "c", inner).groupBy("bin_row", "bin_col").agg(F.count(F.lit(1)).alias("a_tiles"))
    bt = put(tiles(b, True).select(div("tile_row", 4).alias("r"), div("tile_col", 2).alias("c")), "r", inner, "c", cols).groupBy("bin_row", "bin_col").agg(F.count(F.lit(1)).alias("b_tiles"))
    kids = put(children(a, b), "parent_row", rows, "parent_col", cols)
    counts = kids.groupBy("bin_row", "bin_col").agg(F.count(F.lit(1)).alias("candidates"), F.count(F.when(F.col("children") > 0, 1)).alias("nonempty"), F.count(F.when(F.col("children") == 0, 1)).alias("empty"), *(F.count(F.when(F.col("children") == x, 1)).alias(f"children{x}") for x in range(1, 5)))
    grid = a.df.sparkSession.range(bins * bins).select(F.floor(F.col("id") / bins).cast("long").alias("bin_row"), F.pmod("id", F.lit(bins)).alias("bin_col"))
    for d in (at, bt, counts):
        grid = grid.join(d, ["bin_row", "bin_col"], "left")
    return grid.select("bin_row", "bin_col", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("a_tiles", "b_tiles", "candidates", "nonempty", "empty", "children1", "children2", "children3", "children4")))


def append_result(spark: SparkSession, row: tuple, path: str) -> None:
    """One line more in a table of results: left, right, m, n, entries, pairs, entries of C, compression, ms, gflops, whether checked."""
    schema = "a string, b string, m long, n long, nnz_a long, nnz_cub long, nnz_c long, compression double, ms double, gflops double, checked int"
    write_csv(spark.createDataFrame([row], schema).coalesce(1), path, header=False, append=True)


def write_csv(df: DataFrame, path: str, header: bool = True, append: bool = False) -> None:
    """A table as CSV; results are appended, diagnostics replaced."""
    df.write.mode("append" if append else "overwrite").option("header", header).csv(path)
