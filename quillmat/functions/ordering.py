"""Places in a global order, without a task that holds all rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; on one machine only (master local), where it is unset, a temporary one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(where)
    elif not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return where or spark.sparkContext.getCheckpointDir()


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that no result needs any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once, its lineage cut by a checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Whether the files that a query shuffled go as soon as it is done.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Tables:
    """Tables of a job under the shared folder, written in columns: scans of them take a fraction of a checkpoint's bytes
    and time, and what no later step needs can go. Rows come back in any order.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, f"{shared_dir(spark).rstrip('/')}/quillmat-{uuid.uuid4().hex}"

    def put(self, name: str, df: DataFrame) -> DataFrame:
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(f"{self.path}/{name}")
        finally:
            self.spark.conf.unset(CLEANUP) if before is None else self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            delete_folder(self.spark, f"{self.path}/{name}")


def numbered(df: DataFrame, keys: list[Column | str], name: str, start: int = 0) -> DataFrame:
    """``df`` with the place (from ``start``) of each row in the order of ``keys``, which should be total.

    Rows are dealt by ranges of the keys; a place is the row's place in its range plus the sizes of the ranges before.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    dealt = settled(dealt.withColumn("_range", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))  # one row for each range
    before = sizes.select("_range", (F.sum("_size").over(Window.orderBy("_range")) - F.col("_size")).alias("_before"))
    return dealt.join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + F.col("_at") + F.lit(start)).drop("_range", "_at", "_before")


def running(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows before it in the order of ``keys``.

    Sums run within ranges of the keys, however many rows share the first one; only the ranges' sums cross them.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = settled(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_range", F.spark_partition_id()))
    sums = dealt.groupBy("_range").agg(F.sum(value).alias("_sum"))  # one row for each range
    base = sums.select("_range", (F.sum("_sum").over(Window.orderBy("_range")) - F.col("_sum")).alias("_base"))
    own = F.sum(value).over(Window.partitionBy("_range").orderBy(*keys)) - F.col(value)
    return dealt.withColumn("_own", own).join(F.broadcast(base), "_range").withColumn(name, F.col("_base") + F.col("_own")).drop("_own", "_base", "_range")


#: Ranges into which a group's values are counted at once.
RANGES = 4096


def at_ranks(df: DataFrame, keys: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """keys and, for each name in ``ranks``, the value at that rank (from 0, in ascending order) of the group's values.

    A rank is a column over ``_n``, the number of the group's values; it is null where it lies outside. Null values don't
    count, a null key is a group, infinities are values, NaN is the greatest, as Spark orders it.

    Values are numbers (as doubles) and are never gathered: each round counts those of all groups by ranges, and goes on
    within the range that holds the rank, between the least and the greatest value there, until these are equal. The
    state of a round is a row for each group and rank.
    """
    if not keys:
        return at_ranks(df.withColumn("_all", F.lit(0)), ["_all"], value, ranks).drop("_all")
    x = F.col("_x")
    held = df.select(*keys, F.col(value).cast("double").alias("_x")).where(F.col("_x").isNotNull())
    match = F.lit(True)
    for i, k in enumerate(keys):
        match &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    aside = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    finite = F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)
    groups = held.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(finite).alias("_lo"), F.max(finite).alias("_hi"))
    asked = F.explode(F.array(*(F.struct(F.lit(name).alias("_name"), rank.cast("long").alias("_rank")) for name, rank in ranks.items()))).alias("_r")
    state = groups.select(*keys, "_n", "_lo", "_hi", asked).select(*keys, "_r._name", "_r._rank", "_n", "_lo", "_hi", F.lit(None).cast("double").alias("_found"))
    state = settled(state.where((F.col("_rank") >= 0) & (F.col("_rank") < F.col("_n"))))
    # halves, so that a range over all doubles doesn't overflow
    width = F.col("_hi") / 2 - F.col("_lo") / 2
    inside = F.when(width > 0, F.floor((x / 2 - F.col("_lo") / 2) / width * RANGES)).otherwise(F.when(x == F.col("_hi"), RANGES).otherwise(0))
    at = F.when(x == F.lit(float("-inf")), F.lit(-1)).when(F.isnan(x), RANGES + 1).when(x == F.lit(float("inf")), RANGES)
    at = at.when(F.col("_lo") == F.col("_hi"), F.lit(0)).otherwise(F.least(inside, F.lit(RANGES - 1))).cast("int")
    first = True
    while not state.where("_found IS NULL").isEmpty():
        open_ = state.where("_found IS NULL").select(*aside, "_name", "_rank", "_lo", "_hi")
        met = held.join(open_, match)
        if not first:
            met = met.where(x.between(F.col("_lo"), F.col("_hi")) & ~F.isnan(x))
        counts = met.withColumn("_at", at).groupBy(*keys, "_name", "_rank", "_at").agg(F.count(F.lit(1)).alias("_c"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
        upto = F.sum("_c").over(Window.partitionBy(*keys, "_name").orderBy("_at"))
        hit = counts.withColumn("_to", upto).where((F.col("_rank") < F.col("_to")) & (F.col("_rank") >= F.col("_to") - F.col("_c")))
        one = F.col("_lo").eqNullSafe(F.col("_hi"))
        hit = hit.select(*keys, "_name", (F.col("_rank") - F.col("_to") + F.col("_c")).alias("_rank"), F.col("_c").alias("_n"), "_lo", "_hi", F.when(one, F.col("_lo")).alias("_found"))
        state = settled(state.where("_found IS NOT NULL").unionByName(hit))
        first = False
    found = state.groupBy(*keys).agg(*(F.max(F.when(F.col("_name") == name, F.col("_found"))).alias(name) for name in ranks))
    return groups.select(*keys).join(found.select(*aside, *ranks), match, "left").select(*keys, *ranks)


def medians(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, middle (the mean of the two middle values), upper_middle (of rank n div 2) of each group."""
    n = F.col("_n")
    both = at_ranks(df, keys, value, {"_lower": F.floor((n - 1) / 2), "upper_middle": F.floor(n / 2)})
    return both.select(*keys, (F.col("_lower") / 2 + F.col("upper_middle") / 2).alias("middle"), "upper_middle")
