"""Drop lines that many documents share; DataFrame functions only."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bitmap, scratch

#: Keys that are sent to every task at most (24 bytes each).
HOT_KEYS = 100_000
#: Fixed value: the blanks that a line's key has stripped.
BLANKS = " \t\n\x0b\x0c\r"


def key_hash(line: Column) -> Column:
    """128 bits of a line's key (blanks stripped at both ends, A-Z lower-cased) as two integers; null for an empty key."""
    key = F.translate(F.btrim(line, F.lit(BLANKS)), ascii_uppercase, ascii_lowercase)
    return F.when(F.length(key) > 0, F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(1), key).alias("b")))


def dedup_lines(df: DataFrame, least_docs: int = 10, least_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Drop, in every document, the lines whose key at least ``least_docs`` documents (rows) have.

    Texts are split at \\n; a null text counts as one empty line. Keys shorter than ``least_chars`` (1 at least) code
    points stay. Returns the id column, ``n_lines`` (before), ``n_dropped`` and ``kept`` (the other lines joined by \\n).
    Rows are told apart by their place, so repeated and null ids keep a row each; an empty table gives no rows; very long
    texts take time in proportion to their lines; other columns don't matter. Keys are told apart by 128 bits.

    Counts need one hash per document and distinct key, pre-aggregated. The most frequent keys over the threshold, at
    most HOT_KEYS, are sent to every task, so no task gets all lines of one of them; lines with others are joined, but
    for those that a bitmap rules out. A text goes to another task only where it may lose a line.
    """
    if least_chars < 1:
        raise ValueError("least_chars must be 1 or more")
    lines = F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "\n")
    src = df.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), lines.alias("_lines"))
    src = scratch.table(src.select("_row", "_id", "_lines", F.transform("_lines", lambda x: F.when(F.length(F.btrim(x, F.lit(BLANKS))) >= least_chars, key_hash(x))).alias("_keys")), "lines", "zstd")
    held = src.select(F.explode(F.array_distinct(F.filter("_keys", lambda k: k.isNotNull()))).alias("_key"))
    common = scratch.table(held.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least_docs), "common")
    hot = common.orderBy(F.col("_n").desc(), "_key").limit(HOT_KEYS).select("_key")
    places = src.select("_row", F.posexplode("_keys").alias("_pos", "_key")).where(F.col("_key").isNotNull())
    hashed = F.xxhash64("_key.a", "_key.b")
    drops = places.join(F.broadcast(hot), "_key", "left_semi")
    if common.count() > HOT_KEYS:
        cold = common.join(F.broadcast(hot), "_key", "left_anti").select("_key")
        maybe = bitmap.thinned(places, hashed, cold.select(hashed.alias("_hash")))
        drops = drops.unionByName(maybe.join(cold, "_key", "left_semi"))
    drops = scratch.table(drops.groupBy("_row").agg(F.collect_list("_pos").alias("_drop")), "drops")
    marked = bitmap.marked(src.drop("_keys"), F.xxhash64("_row"), drops.select(F.xxhash64("_row").alias("_hash")), bits=bitmap.sized(drops.count()))
    # sorted and merged at every size: the places grow with the input, so what small inputs cost tells of large ones
    both = marked.where("_hit").join(drops.hint("merge"), "_row", "left")
    both = both.unionByName(marked.where("NOT _hit").withColumn("_drop", F.lit(None).cast("array<int>")))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_drop")
    kept = F.when(F.col("_drop").isNull(), F.col("_lines")).otherwise(F.transform(stay, lambda i: F.get("_lines", i)))
    both = both.select(F.col("_id"), F.size("_lines").cast("long").alias("n_lines"), kept.alias("_kept"))
    return both.select(F.col("_id").alias(id_col), "n_lines", (F.col("n_lines") - F.size("_kept")).alias("n_dropped"), F.array_join("_kept", "\n").alias("kept"))
