"""``python -m quillmat A.mtx [B.mtx]``: a product of Matrix Market files and its figures, one JSON line.

With --batch the first argument is a folder of such files or a manifest, and each matrix gets a line of its own.
"""

from __future__ import annotations

import argparse
import json
import re
import threading
import time
import uuid

from pyspark.sql import SparkSession

from .functions.ordering import settled
from .operators import product, reorder
from .operators.matrix import Matrix
from .plans import report
from .sources import mtx

CONTROLS = ("off", "original", "same-order", "both")


class CheckFailed(RuntimeError):
    """A control or check gave another structure than the product."""


def arguments(words: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="quillmat", description="C = A B of sparse matrices in Matrix Market files.")
    p.add_argument("left", help="the left operand; with --batch a folder or a manifest (.csv)")
    p.add_argument("right", nargs="?", help="the right operand; without it A itself or, with --aat, its transpose")
    p.add_argument("--aat", action="store_true", help="multiply A by its transpose")
    p.add_argument("--reorder", choices=["none", *reorder.VARIANTS], default="none", help="which order the product goes through")
    p.add_argument("--no-reorder", action="store_true", help="go through the identity, with its figures")
    p.add_argument("--row-order", help="a file of old row ids; needs --inner-order too unless A is square")
    p.add_argument("--inner-order")
    p.add_argument("--order-name", help="name of the order in the files: up to 63 letters, digits, and _ - . +")
    p.add_argument("--prepare-only", action="store_true", help="make the order and its files, no product")
    p.add_argument("--diagnostics", help="folder for the order's tables")
    p.add_argument("--heatmap-bins", type=int, default=256, help="16 to 1024")
    p.add_argument("--parent-diagnostics", action="store_true", help="with --diagnostics: tables of the 16 x 16 parents too")
    p.add_argument("--report", action="store_true", help="figures of operands and product in tiles")
    p.add_argument("--out", help="folder for C in Matrix Market parts")
    p.add_argument("--results", help="folder of result rows (CSV) that one is added to")
    p.add_argument("--warmups", type=int, default=0)
    p.add_argument("--runs", type=int, default=5)
    p.add_argument("--control", choices=CONTROLS, default="off", help="a plain join of the operands as given, or in the product's order, timed and held against it")
    p.add_argument("--check", action="store_true", help="hold the structure against a product without an order")
    p.add_argument("--batch", action="store_true", help="run over all matrices of a folder or manifest")
    p.add_argument("--root", help="with a manifest: the folder of its matrices (Group/Name/Name.mtx, Group/Name.mtx or Name.mtx)")
    p.add_argument("--limit", type=float, default=0, help="with --batch: seconds for each matrix; 0 for no limit")
    args = p.parse_args(words)
    orders = bool(args.row_order or args.inner_order)
    for wrong, why in (
        (args.inner_order and not args.row_order, "--inner-order needs --row-order"),
        (orders and args.reorder != "none", "either order files or --reorder"),
        (args.no_reorder and (orders or args.reorder != "none"), "--no-reorder goes through no other order"),
        (args.order_name is not None and not orders, "--order-name names order files"),
        (args.order_name is not None and not re.fullmatch(r"[A-Za-z0-9_.+-]{1,63}", args.order_name), "an order's name has up to 63 letters, digits, and _ - . +"),
        (args.right and args.aat, "either a right operand or --aat"),
        (args.right and args.batch, "--batch has no right operand"),
        (args.root and not args.batch, "--root is for --batch"),
        (args.limit < 0 or args.limit and not args.batch, "--limit is for --batch"),
        (args.runs < 1 or args.warmups < 0, "one run at least"),
        (not 16 <= args.heatmap_bins <= 1024, "16 to 1024 bins"),
        (args.parent_diagnostics and not args.diagnostics, "--parent-diagnostics needs --diagnostics"),
        (args.prepare_only and not (args.diagnostics or args.report), "--prepare-only without --diagnostics or --report leaves nothing"),
        (args.prepare_only and (args.check or args.control != "off" or args.out or args.results), "--prepare-only makes no product"),
    ):
        if wrong:
            p.error(why)
    return args


def timed(make, warmups: int, runs: int) -> list[float]:
    """Milliseconds of each run after the warm-ups; every run makes the product anew."""
    times = []
    for _ in range(warmups + runs):
        started = time.monotonic()
        make().df.write.format("noop").mode("overwrite").save()
        times.append(1000 * (time.monotonic() - started))
    return times[warmups:]


def plan_of(spark: SparkSession, a: Matrix, args: argparse.Namespace) -> reorder.Plan | None:
    if args.row_order:
        return mtx.read_plan(spark, a, args.row_order, args.inner_order, args.order_name or "file")
    if args.reorder != "none":
        return reorder.plan(a, args.reorder)
    return reorder.identity_plan(a) if args.no_reorder or args.diagnostics else None


def controls(a: Matrix, right: Matrix, plan: reorder.Plan | None, args: argparse.Namespace, want: int) -> dict:
    """Times and entries of the controls that were asked for. One with other than ``want`` entries is an error."""
    out = {}
    for name in ("original", "same-order") if args.control == "both" else (args.control,):
        x, y = reorder.operands(a, right, plan) if name == "same-order" and plan else (a, right)
        make = lambda x=x, y=y: Matrix(product.joined(x, y).groupBy("i", "j").agg(product.PLUS_TIMES.add("v").alias("v")), x.m, y.n)
        got = make().df.count()
        if got != want:
            raise CheckFailed(f"control {name}: {got} entries, {want} expected")
        out[name] = report.times(timed(make, args.warmups, args.runs)) | {"nnz_c": got}
    return out


def run(spark: SparkSession, args: argparse.Namespace) -> dict:
    a = mtx.read_mtx(spark, args.left)[0]
    b = mtx.read_mtx(spark, args.right)[0] if args.right else None
    mode = "ab" if b else "aat" if args.aat else "aa"
    right = product.right_operand(a, mode, b)
    plan = plan_of(spark, a, args)
    out = {"left": args.left, "right": args.right or mode, "rows": a.m, "cols": right.n}
    if plan:
        out["algorithm"] = plan.algorithm
    if args.diagnostics:
        mtx.write_diagnostics(a, plan, args.diagnostics, args.heatmap_bins, right if args.parent_diagnostics else None)
    if args.report:
        left, other = reorder.operands(a, right, plan) if plan else (a, right)
        out["report"] = [tuple(r) for r in report.product(left, other).collect()]
    if args.prepare_only:
        return out
    made = lambda: reorder.multiply_reordered(a, mode, b, plan)[0] if plan else product.multiply(a, mode, b)
    times = report.times(timed(made, args.warmups, args.runs))
    c = made()
    out |= {"nnz_a": a.df.count(), "nnz_cub": product.product_count(a, right).first()[0], "nnz_c": c.df.count(), "ms": times["median_ms"]} | times
    out |= {"compression": out["nnz_cub"] / out["nnz_c"] if out["nnz_c"] else None, "gflops": 2 * out["nnz_cub"] / (out["ms"] * 1e6)}
    if args.check:
        want = settled(product.structure(a, right))
        out["same_structure"] = product.structural_difference(c.df.selectExpr("i", "k AS j"), want, c.m, c.n, 2 * out["nnz_c"]).isEmpty()
        if not out["same_structure"]:
            raise CheckFailed("the product's structure differs from that without an order")
    if args.control != "off":
        out["controls"] = controls(a, right, plan, args, out["nnz_c"])
    if args.out:
        mtx.write_mtx(c, args.out)
    if args.results:
        row = (out["left"], out["right"], a.m, a.n, out["nnz_a"], out["nnz_cub"], out["nnz_c"], out["compression"], out["ms"], out["gflops"], int(args.check))
        mtx.append_result(spark, row, args.results)
    return out


def limited(spark: SparkSession, seconds: float, work) -> tuple[dict | None, str]:
    """What ``work`` gives, and "done", "timeout" (its jobs are cancelled after ``seconds``) or what went wrong."""
    context, group = spark.sparkContext, f"quillmat-{uuid.uuid4().hex}"
    late, over = threading.Event(), threading.Event()

    def stop() -> None:
        late.set()
        while not over.wait(0.2):  # a job may start after others were cancelled
            context.cancelJobGroup(group)

    timer = threading.Timer(seconds, stop) if seconds else None
    context.setJobGroup(group, "one matrix of a batch", interruptOnCancel=True)
    try:
        if timer:
            timer.start()
        return work(), "done"
    except Exception as e:
        return None, "timeout" if late.is_set() else f"{type(e).__name__}: {str(e)[:200]}"
    finally:
        over.set()
        if timer:
            timer.cancel()
        for name in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
            context.setLocalProperty(name, None)


def batch(spark: SparkSession, args: argparse.Namespace):
    """A line for each matrix of a folder or manifest, in order of their paths: its figures, or why there are none."""
    if args.left.endswith(".csv"):
        paths = mtx.manifest_paths(spark, args.left, args.root or ".")
    else:
        paths = [r["path"] for r in mtx.find_matrices(spark, args.left).select("path").toLocalIterator()]
    for path in paths:
        one = argparse.Namespace(**vars(args) | {"left": path, "batch": False})
        if args.diagnostics:
            one.diagnostics = f"{args.diagnostics.rstrip('/')}/{path.rsplit('/', 1)[-1].removesuffix('.mtx')}"
        made, how = limited(spark, args.limit, lambda one=one: run(spark, one))
        yield (made or {"left": path}) | {"outcome": how}


def main() -> None:
    args = arguments()
    spark = SparkSession.builder.appName("quillmat").getOrCreate()
    for line in batch(spark, args) if args.batch else [run(spark, args)]:
        print(json.dumps(line), flush=True)


if __name__ == "__main__":
    main()
