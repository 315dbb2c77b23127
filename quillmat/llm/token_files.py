"""Token ids in files of directly addressable codes.

Each id is split into 8-bit chunks, lowest first. Level 0 holds the first chunk of every id with a bitmap that says
which ids go on; level 1 holds the second chunk of those, and so on. A rank directory over each bitmap (set bits
before every block of 512) finds an id's place on the next level, so any token is read without decoding its
neighbours.

A file set is a folder of Parquet files that hold segments, one row each: the number of the file, the segment's first
token within that file, its documents' ids and lengths, and the code bytes. Spark's writer commits them, so retried
tasks leave no second copy, and any store that Spark reads will do. Codes are stored as they are, without compression,
in row groups of about a segment, so that :func:`token_at` fetches no more than the segments it needs and decodes no
token but those it was asked for.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe, scratch

BLOCK = 512
#: A segment is closed when it holds this many tokens; a longer document has a segment of its own.
SEGMENT_TOKENS = 1 << 18
#: So many files have their first tokens broadcast (16 bytes each); more are joined.
FILES = 1_000_000
#: Bytes of a row group, about one segment; segments that are fetched by number; positions of a bucket of the lookup.
ROW_GROUP, FEW, SPAN_BITS = 1 << 20, 1000, 18


class Codes:
    """Directly addressable codes of unsigned 32-bit integers."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.levels = levels

    def __len__(self) -> int:
        return len(self.levels[0][0]) if self.levels else 0

    @classmethod
    def build(cls, ids: np.ndarray) -> Codes:
        levels, rest = [], np.asarray(ids, np.uint32)
        while len(rest):
            more = rest > 0xFF
            bits = np.zeros(-(-len(rest) // BLOCK) * (BLOCK // 8), np.uint8)
            packed = np.packbits(more, bitorder="little")
            bits[: len(packed)] = packed
            ranks = np.bitwise_count(bits.view(np.uint64)).reshape(-1, BLOCK // 64).sum(axis=1)
            levels.append(((rest & 0xFF).astype(np.uint8), bits, np.concatenate([[0], np.cumsum(ranks)[:-1]]).astype("<u4")))
            rest = rest[more] >> np.uint32(8)
        return cls(levels)

    def to_bytes(self) -> bytes:
        head = struct.pack("<B", len(self.levels)) + b"".join(struct.pack("<Q", len(c)) for c, _, _ in self.levels)
        return head + b"".join(c.tobytes() + b.tobytes() + r.tobytes() for c, b, r in self.levels)

    @classmethod
    def from_bytes(cls, raw: bytes) -> Codes:
        n, at, levels = raw[0], 1 + 8 * raw[0], []
        for k in range(n):
            (size,) = struct.unpack_from("<Q", raw, 1 + 8 * k)
            blocks = -(-size // BLOCK)
            chunks = np.frombuffer(raw, np.uint8, size, at)
            bits = np.frombuffer(raw, np.uint8, blocks * (BLOCK // 8), at + size)
            ranks = np.frombuffer(raw, "<u4", blocks, at + size + len(bits))
            levels.append((chunks, bits, ranks))
            at += size + len(bits) + 4 * blocks
        return cls(levels)

    def at(self, places: np.ndarray) -> np.ndarray:
        """The ids at any places, in any order."""
        places = np.asarray(places, np.int64)
        if len(places) and (places.min() < 0 or places.max() >= len(self)):
            raise IndexError("place outside the codes")
        out, who = np.zeros(len(places), np.uint32), np.arange(len(places))
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            out[who] |= chunks[places].astype(np.uint32) << np.uint32(8 * k)
            more = (bits[places >> 3] >> (places & 7).astype(np.uint8)) & 1 == 1
            who, places = who[more], places[more]
            if not len(who):
                break
            block, inner = places // BLOCK, places % BLOCK
            words = bits.view("<u8").reshape(-1, BLOCK // 64)[block]
            word, bit = inner // 64, (inner % 64).astype(np.uint64)
            full = np.arange(BLOCK // 64) < word[:, None]
            before = np.where(full, np.bitwise_count(words), 0).sum(axis=1, dtype=np.int64)
            part = words[np.arange(len(words)), word] & ((np.uint64(1) << bit) - np.uint64(1))
            places = ranks[block].astype(np.int64) + before + np.bitwise_count(part).astype(np.int64)
        return out

    def run(self, lo: int, hi: int) -> np.ndarray:
        """The ids of places lo..hi-1: on each level they lie side by side."""
        out, who = np.zeros(hi - lo, np.uint32), np.arange(hi - lo)
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            if hi <= lo:
                break
            out[who] |= chunks[lo:hi].astype(np.uint32) << np.uint32(8 * k)
            first = lo // 8 * 8
            more = np.unpackbits(bits[first // 8 : -(-hi // 8)], bitorder="little")[lo - first : hi - first] == 1
            start = lo // BLOCK * BLOCK
            lo = int(ranks[lo // BLOCK]) + int(np.unpackbits(bits[start // 8 : -(-lo // 8)], bitorder="little")[: lo - start].sum())
            who = who[more]
            hi = lo + len(who)
        return out


def write(df: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, segment_tokens: int = SEGMENT_TOKENS) -> None:
    """Encode every whole text, append ``end_id`` and write the files, rows in ascending ``id_col`` order.

    Null texts count as empty (one end id). Null ids come first; rows with equal ids are ordered by a hash of the text,
    then by the text. An empty table writes a folder with no segment. Rows are dealt by ranges of the id, so no task
    holds more than its range; a range of equal ids is dealt further by the text's hash.
    """
    spark = df.sparkSession
    kind = df.schema[id_col].dataType
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    src = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).withColumn("_h", F.xxhash64("_text"))
    src = src.repartitionByRange(n, F.col("_id").asc_nulls_first(), F.col("_h")).sortWithinPartitions(F.col("_id").asc_nulls_first(), "_h", "_text").drop("_h")
    schema = T.StructType([T.StructField("file", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(kind)), T.StructField("lengths", T.ArrayType(T.LongType())), T.StructField("codes", T.BinaryType())])

    def run(chunks):
        coder, file = bpe.coder(tokenizer, "library"), TaskContext.get().partitionId()
        start, keys, lengths, parts, size = 0, [], [], [], 0

        def segment():
            codes = Codes.build(np.concatenate(parts)).to_bytes()
            return pa.RecordBatch.from_arrays(
                [pa.array([file], pa.int64()), pa.array([start], pa.int64()), pa.array([size], pa.int64()), pa.ListArray.from_arrays([0, sum(map(len, keys))], pa.concat_arrays(keys)), pa.array([np.concatenate(lengths)], pa.list_(pa.int64())), pa.array([codes], pa.binary())],
                names=["file", "start", "n_tokens", "ids", "lengths", "codes"],
            )

        for b in chunks:
            for lo, hi in bpe.batches(b.column(1)):
                flat, ends = bpe.ended(*coder.encode_array(b.column(1).slice(lo, hi - lo)), end_id)
                done = 0  # documents of this batch that are in a segment
                while done < hi - lo:
                    upto = min(hi - lo, int(np.searchsorted(ends, ends[done] + segment_tokens - size)))
                    keys.append(b.column(0).slice(lo + done, upto - done))
                    lengths.append(np.diff(ends[done : upto + 1]))
                    parts.append(flat[ends[done] : ends[upto]])
                    size, done = size + int(ends[upto] - ends[done]), upto
                    if size >= segment_tokens:
                        yield segment()
                        start, keys, lengths, parts, size = start + size, [], [], [], 0
        if parts:
            yield segment()

    made = src.mapInArrow(run, schema)
    made.write.mode("overwrite").option("compression", "none").option("parquet.block.size", ROW_GROUP).option("parquet.page.size.row.check.min", 1).parquet(folder)


def based(segments: DataFrame) -> DataFrame:
    """``segments`` with ``_base``: the tokens of the files before."""
    sizes = segments.groupBy("file").agg(F.sum("n_tokens").alias("_n"))  # one row for each file
    base = sizes.select("file", (F.sum("_n").over(Window.orderBy("file")) - F.col("_n")).alias("_base"))
    if sizes.count() <= FILES:
        base = F.broadcast(base)
    return segments.join(base, "file")


def token_at(spark: SparkSession, folder: str, positions: DataFrame, position_col: str = "position") -> DataFrame:
    """position, token_id: for each distinct position (from 0 over all files), one row; outside the files, or null: null.

    Only the segments that hold a position are fetched: a few by their numbers, which Parquet's row groups are skipped
    by, many by a semi-join. Of a segment only the asked tokens' chunks, bitmap words and ranks are looked at.
    """
    asked = positions.select(F.col(position_col).cast("long").alias("position")).distinct()
    segments = spark.read.parquet(folder)
    spans = based(segments.select("file", "start", "n_tokens")).withColumn("_first", F.col("_base") + F.col("start"))
    spans = spans.withColumn("_span", F.explode(F.sequence(F.shiftright("_first", SPAN_BITS), F.shiftright(F.col("_first") + F.col("n_tokens") - 1, SPAN_BITS))))
    inside = (F.col("position") >= F.col("_first")) & (F.col("position") < F.col("_first") + F.col("n_tokens"))
    met = asked.withColumn("_span", F.shiftright("position", SPAN_BITS)).join(spans, "_span").where(inside)
    met = scratch.table(met.select("position", "file", "start", (F.col("position") - F.col("_first")).alias("place")), "positions")
    wanted = met.select("file", "start").distinct()
    if wanted.count() <= FEW:
        rows = wanted.collect()
        held = segments.where(F.col("file").isin([r["file"] for r in rows]) & F.col("start").isin([r["start"] for r in rows]))
    else:
        held = segments
    held = held.select("file", "start", "codes").join(wanted, ["file", "start"], "left_semi")

    def pick(left: pa.Table, right: pa.Table) -> pa.Table:
        found = Codes.from_bytes(right["codes"][0].as_py()).at(left["place"].to_numpy())
        return pa.table({"position": left["position"], "token_id": pa.array(found.astype(np.int64))})

    # distinct positions of one segment are no more than its tokens
    found = met.groupBy("file", "start").cogroup(held.groupBy("file", "start")).applyInArrow(pick, "position long, token_id long")
    return asked.join(found, "position", "left")


def read(spark: SparkSession, folder: str, id_col: str = "doc_id") -> DataFrame:
    """Per document, from the files: the id, start (tokens of all documents before it), n_tokens, ids (binary, uint32)."""
    segments = spark.read.parquet(folder)
    src = based(segments).select((F.col("_base") + F.col("start")).alias("start"), "ids", "lengths", "codes")
    kind = segments.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(chunks):
        for b in chunks:
            for k in range(b.num_rows):
                codes = Codes.from_bytes(b.column(3)[k].as_py())
                keys, sizes = b.column(1)[k].values, b.column(2)[k].values.to_numpy()
                ends = np.cumsum(sizes)
                raw = [codes.run(int(e - s), int(e)).astype("<u4").tobytes() for s, e in zip(sizes, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([keys, pa.array(b.column(0)[k].as_py() + ends - sizes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(raw, pa.binary())], names=[id_col, "start", "n_tokens", "ids"])

    return src.mapInArrow(run, schema)


def digests(documents: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of :func:`read` with crc32 of the ids in place of the ids."""
    return documents.select(id_col, "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))

