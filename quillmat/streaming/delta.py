"""Products that follow changes of their operands.

A product is linear in each operand, so a batch of changes dA and dB adds dA B + A dB + dA dB. All that a batch adds is kept
under its number: changes of A and B, and the product's. A batch that runs again reads only what lies before its number
and replaces what it left, so it counts once. Now and then batches are folded into a base, after which they are deleted.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.ordering import delete_folder
from ..operators.matrix import Matrix
from ..operators.product import multiply

ENTRY = "i long, k long, v double"
#: Batches after which those before are folded into a base.
FOLD = 16


def parts(spark: SparkSession, folder: str) -> dict[str, list[int]]:
    """Numbers of the committed bases and batches in a folder."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found: dict[str, list[int]] = {"base": [], "batch": []}
    if files.exists(where):
        for status in files.listStatus(where):
            path = status.getPath()
            name = re.fullmatch(r"(base|batch)=(\d+)", path.getName())
            if name and files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")):
                found[name[1]].append(int(name[2]))
    return found


def state(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """i, k, v of a folder: the last base and the batches after it (all before the batch ``before``), summed."""
    found = parts(spark, folder)
    here = [n for n in found["base"] if before is None or n < before]
    base = max(here, default=-1)
    paths = [f"{folder}/base={base}"] if here else []
    paths += [f"{folder}/batch={n}" for n in sorted(found["batch"]) if n > base and (before is None or n < before)]
    every = spark.read.schema(ENTRY).parquet(*paths) if paths else spark.createDataFrame([], ENTRY)
    return every.groupBy("i", "k").agg(F.sum("v").alias("v"))


def write(df: DataFrame, folder: str, name: str, number: int) -> None:
    df.select("i", "k", "v").write.mode("overwrite").parquet(f"{folder}/{name}={number}")


def fold(spark: SparkSession, folder: str, number: int) -> None:
    """A base of all batches up to ``number``, then without the parts that it replaces.

    A base is written from what lies before it, so a fold that is broken off runs again; what is left of the parts it
    replaced is never read any more.
    """
    write(state(spark, folder, number + 1), folder, "base", number)
    found = parts(spark, folder)
    for name, n in [("base", n) for n in found["base"] if n < number] + [("batch", n) for n in found["batch"] if n <= number]:
        delete_folder(spark, f"{folder}/{name}={n}")


def step(batch: DataFrame, number: int, a: Matrix, b: Matrix, folder: str, every: int = FOLD) -> None:
    """Count one batch of changes (side "A" or "B", i, k, v); ``a`` and ``b`` are the operands at the start."""
    spark = batch.sparkSession
    if number and number % every == 0:  # what came before is whole by now
        for name in "ABC":
            if max(parts(spark, f"{folder}/{name}")["base"], default=-1) < number - 1:
                fold(spark, f"{folder}/{name}", number - 1)
    batch = batch.persist()
    try:
        change = {side: Matrix.of(batch.where(F.col("side") == side), m.m, m.n).merged() for side, m in (("A", a), ("B", b))}
        now = {side: Matrix(m.df.select("i", "k", "v").unionByName(state(spark, f"{folder}/{side}", number)), m.m, m.n) for side, m in (("A", a), ("B", b))}
        new_b = Matrix(now["B"].df.unionByName(change["B"].df), b.m, b.n)
        # dA (B + dB) + A dB
        sums = multiply(change["A"], "ab", new_b).df.unionByName(multiply(now["A"], "ab", change["B"]).df)
        write(sums.groupBy("i", "k").agg(F.sum("v").alias("v")), f"{folder}/C", "batch", number)
        for side, m in change.items():
            write(m.df, f"{folder}/{side}", "batch", number)
    finally:
        batch.unpersist()


def follow_both(a: Matrix, b: Matrix, changes: DataFrame, folder: str, checkpoint: str, every: int = FOLD, **trigger) -> StreamingQuery:
    """Start a query that keeps the product of two operands under ``folder`` while ``changes`` (side, i, k, v) come in."""
    run = lambda batch, number: step(batch, number, a, b, folder, every)
    return changes.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def product_now(a: Matrix, b: Matrix, folder: str) -> Matrix:
    """The product of the operands as of the batches so far: that of the start, and what the batches added."""
    spark = a.df.sparkSession
    both = multiply(a, "ab", b).df.unionByName(state(spark, f"{folder}/C"))
    return Matrix(both.groupBy("i", "k").agg(F.sum("v").alias("v")), a.m, b.n)


def follow(a: Matrix, changes: DataFrame, columns: int, folder: str, checkpoint: str, every: int = FOLD, **trigger) -> StreamingQuery:
    """Start a query that adds A x (changes i, k, v) to the table in ``folder`` batch by batch; B is zero at the start."""

    def step(batch: DataFrame, number: int) -> None:
        if number and number % every == 0 and max(parts(batch.sparkSession, folder)["base"], default=-1) < number - 1:
            fold(batch.sparkSession, folder, number - 1)
        write(multiply(a, "ab", Matrix.of(batch, a.n, columns)).df, folder, "batch", number)

    return changes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The product as of the batches so far."""
    return state(spark, folder)
