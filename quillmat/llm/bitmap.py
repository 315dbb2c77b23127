"""Bitmaps of keys: which rows surely have none of some keys, without sending those rows anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a map (2 MB) unless it is sized by its keys, and at most (128 MB); bits for each key of a sized one. Of a map
#: with too few more rows go the exact way.
BITS, MOST_BITS, EACH = 1 << 24, 1 << 30, 16


def sized(keys: int) -> int:
    """Bits of a map of so many keys: about one row in EACH that has none of them goes the exact way, up to MOST_BITS."""
    return min(MOST_BITS, max(BITS, 1 << (EACH * keys).bit_length()))


def free(df: DataFrame, name: str) -> str:
    """``name``, after as many underscores as no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def marked(df: DataFrame, hashed: Column, wanted: DataFrame, name: str = "_hit", bits: int = BITS) -> DataFrame:
    """``df`` with ``name``, a free one: false where the hash is surely none of those in ``wanted`` (its only column, ``_hash``)."""
    bit, bucket, held = (free(df, x) for x in ("_bit", "_bucket", "_map"))
    maps = wanted.select(F.pmod("_hash", F.lit(bits)).alias("_bit"))
    maps = maps.groupBy(F.bitmap_bucket_number("_bit").alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_bit")).alias(held))
    rows = df.withColumn(bit, F.pmod(F.coalesce(hashed, F.lit(0).cast("long")), F.lit(bits))).withColumn(bucket, F.bitmap_bucket_number(bit))
    place = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.substring(F.col(held), (place / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))
    return rows.join(F.broadcast(maps), bucket, "left").select(*df.columns, hit.alias(name))


def thinned(df: DataFrame, hashed: Column, wanted: DataFrame, bits: int = BITS) -> DataFrame:
    """Rows of ``df`` whose hash may be in ``wanted``."""
    hit = free(df, "_hit")
    return marked(df, hashed, wanted, hit, bits).where(F.col(hit)).select(*df.columns)


def within(df: DataFrame, hashed: Column, wanted: DataFrame, keep: DataFrame, on: Column, once: list[str] | None = None, bits: int = BITS) -> DataFrame:
    """Rows of ``df`` that ``keep`` matches under ``on``, where every row without a match has its hash in ``wanted``.

    Rows whose hash isn't there stay without a join; the others are joined, and left once for each ``once``.
    """
    hit = free(df, "_hit")
    rows = marked(df, hashed, wanted, hit, bits)
    exact = rows.where(F.col(hit)).join(keep, on, "left_semi")
    if once:
        exact = exact.dropDuplicates(once)
    return rows.where(~F.col(hit)).unionByName(exact).select(*df.columns)
