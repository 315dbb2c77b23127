"""Exact dedup by deterministic block naming.

A text is cut into blocks of a fixed size. Equal blocks get the same integer name: blocks are dealt by their hash,
sorted, and numbered in each task. Then adjacent pairs of names are named the same way, again and again, until each
document has one name; with its number of blocks that is a collision-free identity, since every step compares the
contents themselves.

A task first names its own blocks, so a block that a third of all documents hold is sent once by each batch of rows,
not once by each document.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe, scratch

BLANKS = b" \t\n\x0b\x0c\r"
#: Bytes of a block. Most texts are one or two blocks; a text of n blocks takes log2(n) rounds.
BLOCK = 8192
#: Names are task * 2**NAME_BITS + place in the task's sorted order.
NAME_BITS = 40


def blocks(df: DataFrame, id_col: str, text_col: str, block: int) -> DataFrame:
    """A row per block: _row, _id, _chars, _sha and _md5 (of the document), _n blocks, _pos, and the batch's first such block.

    Only that first block carries its bytes in _block.
    """
    kind = df.schema[id_col].dataType
    src = df.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    schema = T.StructType([T.StructField("_row", T.LongType()), T.StructField("_id", kind), T.StructField("_chars", T.LongType()), T.StructField("_sha", T.StringType()), T.StructField("_md5", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("_n", "_pos", "_same_row", "_same_pos")), T.StructField("_block", T.BinaryType())])

    def run(chunks):
        for b in chunks:
            for lo, hi in bpe.batches(b.column(2)):
                rows = b.column(0).slice(lo, hi - lo).to_pylist()
                texts = b.column(2).slice(lo, hi - lo)
                chars = pc.fill_null(pc.utf8_length(texts), 0).to_pylist()
                seen: dict[bytes, tuple[int, int]] = {}
                of, cols = [], [[] for _ in range(9)]
                for k, text in enumerate(texts.cast(pa.binary()).to_pylist()):
                    norm = (text or b"").translate(None, BLANKS)
                    sha, md5, n = hashlib.sha256(norm).hexdigest(), hashlib.md5(text or b"", usedforsecurity=False).hexdigest(), max(1, -(-len(norm) // block))
                    for pos in range(n):
                        part = norm[pos * block : (pos + 1) * block]
                        same = seen.setdefault(part, (rows[k], pos))
                        of.append(k)
                        for c, v in zip(cols, (rows[k], chars[k], sha, md5, n, pos, *same, part if same == (rows[k], pos) else None), strict=True):
                            c.append(v)
                ids = b.column(1).slice(lo, hi - lo).take(pa.array(of, pa.int64()))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 4, pa.binary()]
                first, *rest = (pa.array(c, t) for c, t in zip(cols, kinds, strict=True))
                yield pa.RecordBatch.from_arrays([first, ids, *rest], names=[f.name for f in schema])

    return src.mapInArrow(run, schema)


def named(df: DataFrame, key: str, keep: list[str]) -> DataFrame:
    """Columns ``keep`` and _name: equal keys, and only those, get equal names. ``key`` is dealt by hash and sorted."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    src = df.select(*keep, F.col(key).alias("_key")).repartition(n, "_key").sortWithinPartitions("_key")
    schema = T.StructType([*(src.schema[c] for c in keep), T.StructField("_name", T.LongType())])

    def run(chunks):
        name, last = (TaskContext.get().partitionId() << NAME_BITS) - 1, None
        for b in chunks:
            names = []
            for x in b.column(b.num_columns - 1).to_pylist():
                if x != last or last is None:
                    name, last = name + 1, x
                names.append(name)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(names, pa.int64())], names=[*keep, "_name"])

    return src.mapInArrow(run, schema)


def identities(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """A row per row of ``df``: _row, _id, _chars, _sha, _md5, and the identity (_n, _name)."""
    made = scratch.table(blocks(df, id_col, text_col, block), "blocks", "zstd")
    names = named(made.where(F.col("_block").isNotNull()), "_block", ["_same_row", "_same_pos"])
    occurrences = made.select("_row", "_n", "_pos", "_same_row", "_same_pos").join(names, ["_same_row", "_same_pos"]).select("_row", "_n", "_pos", "_name")
    whole = scratch.table(occurrences, "names")
    done, open_ = whole.where("_n = 1").select("_row", "_n", "_name"), whole.where("_n > 1")
    most = made.agg(F.max("_n")).first()[0] or 1
    while most > 1:
        pairs = open_.groupBy("_row", "_n", F.shiftright("_pos", 1).alias("_pos")).agg(F.max(F.when(F.col("_pos") % 2 == 0, F.col("_name"))).alias("_l"), F.coalesce(F.max(F.when(F.col("_pos") % 2 == 1, F.col("_name"))), F.lit(-1).cast("long")).alias("_r"))
        bucket = pairs.select("_l", "_r").distinct().withColumn("_b", F.pmod(F.xxhash64("_l", "_r"), F.lit(4096)))
        rank = F.dense_rank().over(Window.partitionBy("_b").orderBy("_l", "_r"))
        names = bucket.select("_l", "_r", (F.col("_b") * (1 << NAME_BITS) + rank).alias("_name"))
        open_ = scratch.table(pairs.join(names, ["_l", "_r"]).select("_row", "_n", "_pos", "_name"), "names")
        most = (most + 1) // 2
    last = open_.select("_row", "_n", "_name")
    return made.where("_pos = 0").select("_row", "_id", "_chars", "_sha", "_md5").join(done.unionByName(last), "_row")


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """A row per row of ``df``: the id column, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``
    (of the normalised text), ``text_md5`` (of the text as it is).

    Texts are equal when they are after deleting every character of [\\x20\\x09-\\x0D]; null counts as empty. Of equal
    texts the row with the most code points stays, then the smallest id (nulls last), then the first row, so repeated
    rows leave one. An empty table gives no rows; other columns don't matter.
    """
    every = identities(df, id_col, text_col, block)
    order = F.struct((-F.col("_chars")).alias("c"), F.col("_id").isNull().alias("z"), F.col("_id").alias("i"), F.col("_row").alias("r"))
    groups = every.groupBy("_n", "_name").agg(F.min(order).alias("_best"), F.count(F.lit(1)).alias("_size"))
    out = every.join(groups, ["_n", "_name"])
    return out.select(F.col("_id").alias(id_col), F.col("_best.i").alias("keep_id"), F.col("_size").alias("group_size"), (F.col("_row") == F.col("_best.r")).alias("kept"), F.col("_sha").alias("text_sha256"), F.col("_md5").alias("text_md5"))
