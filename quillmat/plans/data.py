"""Matrices that the given tables hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.matrix import Matrix


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def size(spark: SparkSession, folder: str, name: str) -> int:
    return table(spark, folder, name).count()


def lines(spark: SparkSession, folder: str, i: str, k: str) -> DataFrame:
    """i, k, v: one entry per order line, equal coordinates not merged."""
    return table(spark, folder, "lineitem").select(F.col(i).cast("long").alias("i"), F.col(k).cast("long").alias("k"), F.col("l_quantity").alias("v"))


def supplier_part(spark: SparkSession, folder: str, merged: bool = True) -> Matrix:
    a = Matrix(lines(spark, folder, "l_suppkey", "l_partkey"), size(spark, folder, "supplier"), size(spark, folder, "part"))
    return a.merged() if merged else a


def order_part(spark: SparkSession, folder: str, merged: bool = True) -> Matrix:
    a = Matrix(lines(spark, folder, "l_orderkey", "l_partkey"), size(spark, folder, "orders"), size(spark, folder, "part"))
    return a.merged() if merged else a


def part_succession(spark: SparkSession, folder: str) -> Matrix:
    """Part x part: how often a line with the second part follows one with the first in an order."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").cast("long"))
    then = lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("_k"))
    n = size(spark, folder, "part")
    df = lines.join(then, ["l_orderkey", "l_linenumber"]).groupBy(F.col("l_partkey").alias("i"), F.col("_k").alias("k")).agg(F.count(F.lit(1)).cast("double").alias("v"))
    return Matrix(df, n, n)


def user_hour(spark: SparkSession, folder: str) -> Matrix:
    """User x hour of the day: events."""
    events = table(spark, folder, "events")
    df = events.groupBy(F.col("user_id").alias("i"), F.hour("ts").cast("long").alias("k")).agg(F.count(F.lit(1)).cast("double").alias("v"))
    users = (events.agg(F.max("user_id")).first()[0] or 0) + 1
    return Matrix(df, users, 24)


#: The same in SQL, by name.
SQL = {
    "sl": "sl AS (SELECT l_suppkey AS i, l_partkey AS k, l_quantity AS v FROM lineitem)",
    "ol": "ol AS (SELECT l_orderkey AS i, l_partkey AS k, l_quantity AS v FROM lineitem)",
    "sp": "sp AS (SELECT l_suppkey AS i, l_partkey AS k, sum(l_quantity) AS v FROM lineitem GROUP BY ALL)",
    "ps": "ps AS (SELECT l_partkey AS i, l_suppkey AS k, sum(l_quantity) AS v FROM lineitem GROUP BY ALL)",
    "op": "op AS (SELECT l_orderkey AS i, l_partkey AS k, sum(l_quantity) AS v FROM lineitem GROUP BY ALL)",
    "pp": "pp AS (SELECT a.l_partkey AS i, b.l_partkey AS k, count(*)::DOUBLE AS v FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber + 1 = b.l_linenumber GROUP BY ALL)",
    "uh": "uh AS (SELECT user_id AS i, hour(ts)::BIGINT AS k, count(*)::DOUBLE AS v FROM events GROUP BY ALL)",
}
