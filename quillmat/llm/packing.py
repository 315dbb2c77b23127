"""Best-fit packing of token sequences after Martello and Toth's reduction.

What is packed is a count for each length, at most ``capacity`` numbers however many documents there are, so the
packing is decided once from the counts and carried out by joins. The reduction fixes sets of one to three lengths
that provably dominate every other way to fill a sequence that holds the first of them; what is left is placed best
fit, longest first, whole classes of equal sequences at a time.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe, scratch


def dominating(left: np.ndarray, w: int, capacity: int) -> tuple[int, ...] | None:
    """Lengths that, with ``w``, dominate each set that holds ``w``; None where none is proven. left[s]: count of s."""
    room = capacity - w
    left = left.copy()
    left[w] -= 1
    fits = np.flatnonzero(left[: room + 1])
    if not len(fits):
        return (w,)
    k = int(fits[-1])
    if k == room:  # fills it: whatever else goes with w can stand in k's place
        return (w, k)
    small = np.repeat(fits[:3], np.minimum(left[fits[:3]], 3))[:3].tolist()
    if len(small) < 2 or small[0] + small[1] > room:  # one more fits at most: the longest
        return (w, k)
    if len(small) == 3 and sum(small) <= room:
        return None
    left[k] -= 1
    second = np.flatnonzero(left[: room - k + 1])
    if not len(second):
        return None
    s = int(second[-1])
    left[k] += 1
    above = np.flatnonzero(left[s + 1 : room + 1])[:2] + s + 1  # two that both exceed s could not be exchanged
    pair = np.repeat(above, np.minimum(left[above], 2))[:2]
    return (w, k, s) if len(pair) < 2 or pair.sum() > room else None


def reduce(counts: np.ndarray, capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """(lengths, how many sequences hold just these) fixed by dominance, and the counts that are left."""
    left, fixed, changed = counts.copy(), [], True
    while changed:
        changed = False
        for w in np.flatnonzero(left)[::-1].tolist():
            while left[w] > 0 and (lengths := dominating(left, w, capacity)):
                need = Counter(lengths)
                times = min(int(left[s]) // n for s, n in need.items())
                for s, n in need.items():
                    left[s] -= n * times
                fixed.append((lengths, times))
                changed = True
    return fixed, left


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on counts: (lengths, how many sequences hold just these)."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for w in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[w])
        while left:
            room = min((r for r in open_ if r >= w), default=0)
            lengths, many = open_[room].pop() if room else ((), left)
            if room and not open_[room]:
                del open_[room]
            room = room or capacity
            each = min(room // w, left)
            used = min(many, left // each)
            if lengths and many > used:
                open_.setdefault(room, []).append((lengths, many - used))
            open_.setdefault(room - each * w, []).append((lengths + (w,) * each, used))
            left -= each * used
    return [x for group in open_.values() for x in group]


def plan(counts: np.ndarray, capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, rank after the last, first sequence, offset): where the r-th of a length goes."""
    fixed, left = reduce(counts, capacity)
    given, base, rows = np.zeros(capacity + 1, np.int64), 0, []
    for lengths, times in fixed + best_fit(left, capacity):
        offset = 0
        for s in lengths:
            rows.append((s, int(given[s]), int(given[s]) + times, base, offset))
            given[s] += times
            offset += s
        base += times
    return rows


def pieces(df: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str, text_col: str, kept: int = bpe.KEPT) -> DataFrame:
    """A row per piece, with its task and its rank among the task's pieces of that length."""
    kind = df.schema[id_col].dataType
    src = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    schema = T.StructType([T.StructField(id_col, kind), *(T.StructField(c, T.LongType()) for c in ("piece", "start", "length", "ids_crc32", "_task", "_rank"))])

    def run(chunks):
        coder, task = bpe.coder(tokenizer, "library"), TaskContext.get().partitionId()
        coder.kept.most = kept
        seen = np.zeros(capacity + 1, np.int64).tolist()
        for b in chunks:
            for lo, hi in bpe.batches(b.column(1)):
                of, cols = [], [[], [], [], [], []]
                flat, ends = bpe.ended(*coder.encode_array(b.column(1).slice(lo, hi - lo)), end_id)
                raw, ends = memoryview(flat.tobytes()), ends.tolist()
                for k, (first, last) in enumerate(zip(ends, ends[1:], strict=False)):
                    size = last - first
                    head = size if size <= capacity else size % capacity or capacity
                    cuts = [0, *range(head, size + 1, capacity)]
                    for i, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        of.append(k)
                        for c, v in zip(cols, (i, x, y - x, zlib.crc32(raw[4 * (first + x) : 4 * (first + y)]), seen[y - x]), strict=True):
                            c.append(v)
                        seen[y - x] += 1
                ids = b.column(0).slice(lo, hi - lo).take(pa.array(of, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in cols[:4]), pa.array([task] * len(of), pa.int64()), pa.array(cols[4], pa.int64())], names=[id_col, "piece", "start", "length", "ids_crc32", "_task", "_rank"])

    return src.mapInArrow(scratch.lean(run), schema)


def pack(df: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", kept: int = bpe.KEPT) -> DataFrame:
    """Pack every whole text, ``end_id`` appended, into sequences of at most ``capacity`` tokens.

    A longer document is cut: its first piece takes what the others, all of ``capacity``, leave. Returns a row per
    piece: the id, piece, start, length, ids_crc32, sequence_id, offset. Null and empty texts are one end id; repeated
    rows are packed each for itself, null ids stay null; an empty table gives no rows. Other columns don't matter.

    The driver holds one count per length (``capacity`` numbers). Ranks within a length are a task's own rank plus the
    counts of the tasks before it, so no task ever holds all pieces of one length.
    """
    spark = df.sparkSession
    made = scratch.table(pieces(df, tokenizer, capacity, end_id, id_col, text_col, kept), "pieces")
    sizes = made.groupBy("_task", "length").agg(F.count(F.lit(1)).alias("_n"))
    counts = np.zeros(capacity + 1, np.int64)
    for r in sizes.groupBy("length").agg(F.sum("_n").alias("n")).collect():
        counts[r["length"]] = r["n"]
    rows = plan(counts, capacity)
    before = sizes.select("_task", "length", (F.sum("_n").over(Window.partitionBy("length").orderBy("_task")) - F.col("_n")).alias("_before"))
    ranked = made.join(before, ["_task", "length"]).withColumn("_r", F.col("_before") + F.col("_rank"))
    # a few rows for each of the lengths, of which there are no more than ``capacity``
    places = spark.createDataFrame(rows, "_length long, _lo long, _hi long, _base long, offset long").coalesce(1)
    found = ranked.join(F.broadcast(places), (F.col("length") == F.col("_length")) & (F.col("_r") >= F.col("_lo")) & (F.col("_r") < F.col("_hi")))
    return found.select(id_col, "piece", "start", "length", "ids_crc32", (F.col("_base") + F.col("_r") - F.col("_lo")).alias("sequence_id"), "offset")
