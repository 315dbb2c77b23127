"""Tables between jobs, in the folder that the cluster shares.

The folder is ``spark.checkpoint.dir`` of the session. Where that is unset it is an error on a cluster; on one machine, as
in tests, a temporary folder is made and set. Tables are written with Spark's own Parquet writer, so a lost executor costs a re-read and
nothing else.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession



def give_back() -> None:
    """Hand memory that a worker no longer uses back to the system, so that it is there for others."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # where the C library has no such function
        ctypes.CDLL(None).malloc_trim(0)


def lean(run):
    """``run`` (batches to batches), after whose last batch a worker gives memory back."""

    def wrapped(chunks):
        try:
            yield from run(chunks)
        finally:
            give_back()

    return wrapped


_open: list[list[tuple[SparkSession, str]]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; set to a new temporary one where the session names none."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(where)
    return where


def table(df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` once to the shared folder and return the written table."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/quillmat-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    for made in _open:
        made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def noted():
    """A list of the tables that are written meanwhile, for :func:`delete`."""
    made: list[tuple[SparkSession, str]] = []
    _open.append(made)
    try:
        yield made
    finally:
        _open[:] = [x for x in _open if x is not made]


def delete(tables: list[tuple[SparkSession, str]]) -> None:
    """Delete tables that no result needs any more."""
    for spark, path in tables:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    tables.clear()
