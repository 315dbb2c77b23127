"""Sparse matrices as relations (i, k, v)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import numbered


@dataclass(frozen=True)
class Matrix:
    """Entries i, k, v (long, long, double) of an m x n matrix. Absent entries are zero; entries with value 0 stay."""

    df: DataFrame
    m: int
    n: int

    @classmethod
    def of(cls, df: DataFrame, m: int, n: int, i: str = "i", k: str = "k", v: str = "v") -> Matrix:
        return cls(df.select(F.col(i).cast("long").alias("i"), F.col(k).cast("long").alias("k"), F.col(v).cast("double").alias("v")), m, n)

    def transpose(self) -> Matrix:
        return Matrix(self.df.select(F.col("k").alias("i"), F.col("i").alias("k"), "v"), self.n, self.m)

    def merged(self) -> Matrix:
        """Equal coordinates summed; a sum of zero stays."""
        return Matrix(self.df.groupBy("i", "k").agg(F.sum("v").alias("v")), self.m, self.n)

    def symmetrised(self, scheme: str = "symmetric") -> Matrix:
        """Off-diagonal entries mirrored for symmetric and hermitian schemes; others as they are."""
        if scheme not in ("symmetric", "hermitian"):
            return self
        mirrored = self.df.where("i <> k").select(F.col("k").alias("i"), F.col("i").alias("k"), "v")
        return Matrix(self.df.unionByName(mirrored), max(self.m, self.n), max(self.m, self.n))

    def faults(self) -> DataFrame:
        """Entries outside the matrix or without a coordinate."""
        return self.df.where((F.col("i") < 0) | (F.col("i") >= self.m) | (F.col("k") < 0) | (F.col("k") >= self.n) | F.col("i").isNull() | F.col("k").isNull())

    def validated(self) -> Matrix:
        if not self.faults().isEmpty():
            raise ValueError(f"entries outside {self.m} x {self.n}")
        return self

    def row_counts(self) -> DataFrame:
        """i, entries: of rows that have any, duplicates counted."""
        return self.df.groupBy("i").agg(F.count(F.lit(1)).alias("entries"))

    def column_counts(self) -> DataFrame:
        return self.df.groupBy("k").agg(F.count(F.lit(1)).alias("entries"))

    def sequential(self, modulus: int = 10, entry_id: str | None = None) -> Matrix:
        """Values e mod ``modulus``, e being an entry's place in row order.

        Entries with equal coordinates are in the order of the column ``entry_id`` (their place in a file), else of
        their values.
        """
        rows = numbered(self.df, ["i", "k", entry_id or "v"], "_e")
        return Matrix(rows.select("i", "k", F.pmod(F.col("_e"), F.lit(modulus)).cast("double").alias("v")), self.m, self.n)

    def scrambled(self, most: int = 9) -> Matrix:
        """Values from 1 to ``most`` drawn by a hash of the coordinates."""
        return Matrix(self.df.select("i", "k", (F.pmod(F.xxhash64("i", "k"), F.lit(most)) + 1).cast("double").alias("v")), self.m, self.n)

    def row_pointer(self) -> DataFrame:
        """r, ptr for r = 0..m: entries of the rows before r."""
        from ..functions.ordering import running

        counts = self.df.sparkSession.range(self.m + 1).select(F.col("id").alias("r")).join(self.row_counts().withColumnRenamed("i", "r"), "r", "left").select("r", F.coalesce("entries", F.lit(0)).alias("entries"))
        return running(counts, ["r"], "entries", "ptr").select("r", "ptr")
