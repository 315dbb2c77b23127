"""Periodic runs of words, found in every whole text, and texts with each run cut down to one period.

A run is a stretch of consecutive words in which words one period apart are identical, that no neighbouring word extends.
The words of a batch of texts become one sequence of symbols that no two texts share, with an enhanced suffix array: the
suffix array, its inverse, and the LCP of neighbours. An LCP interval is a range of the array whose suffixes share their
first ``depth`` words. Two suffixes that lie ``depth`` words apart in different children of the interval begin a square
that doesn't go on to the right: the branching tandem test looks, for the suffixes of the smaller child alone, whether
ISA[i + depth] or ISA[i - depth] falls into the other. Rotating the square to the left as long as the words agree gives
the run. Intervals are ranges of the array; there are no tree nodes.

The ranks of prefixes of 1, 2, 4 ... words, from which the suffix array comes, also say how far two places agree to the
right (LCP) and to the left (rotation) in logarithmic time.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bpe
from .token_counts import offsets_and_bytes

#: Characters of the texts whose words are one sequence, about; a longer text is alone, and takes some 150 bytes a word.
BATCH = 3_000_000
#: Fixed value: the blanks between words.
BLANKS = (32, *range(9, 14))


class Words(NamedTuple):
    """The words of texts: distinct ones, the number of each occurrence, and where each text's begin (and all end)."""

    names: pa.Array
    which: np.ndarray
    first: np.ndarray


def edges_of(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the stretches of bytes inside words; none reaches over one of ``offsets``, where texts begin."""
    edge = offsets[(offsets > 0) & (offsets < len(inside))]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[edge] = inside[edge]
    ends[:-1] &= ~inside[1:]
    ends[edge - 1] = inside[edge - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def words_of(texts: pa.Array) -> Words:
    """Words between blanks of an array of texts without nulls."""
    offsets, raw = offsets_and_bytes(texts)
    word = np.ones(256, bool)
    word[list(BLANKS)] = False
    begins, ends = edges_of(word[raw], offsets)
    if not len(begins):
        return Words(pa.array([], pa.large_binary()), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64))
    borders = np.stack([begins, ends], 1).ravel()
    parts = pa.Array.from_buffers(pa.large_binary(), len(borders) - 1, [None, pa.py_buffer(borders), pa.py_buffer(raw)]).dictionary_encode()
    return Words(parts.dictionary, parts.indices.to_numpy()[::2].astype(np.int64), np.searchsorted(begins, offsets))


class SuffixArray:
    """``sa``, its inverse ``isa``, and ``levels``: of each place, the number of suffixes with a smaller prefix of 1, 2, 4
    ... symbols (-1 past the end), up to the level on which all differ.
    """

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        order = np.argsort(symbols, kind="stable")
        group = symbols[order]
        new = np.ones(n, bool)
        new[1:] = group[1:] != group[:-1]
        rank = np.empty(n + 1, np.int32)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank[n] = -1
        self.levels, size = [rank.copy()], 1
        open_ = order[~new | ~np.append(new[1:], True)]  # in order, groups of one left out
        while len(open_):
            own, next_ = rank[open_].astype(np.int64), rank[np.minimum(open_ + size, n)]
            by = np.argsort((own << 32) + next_ + 1, kind="stable")
            open_, own, next_ = open_[by], own[by], next_[by]
            first = np.ones(len(open_), bool)
            first[1:] = own[1:] != own[:-1]
            new = first.copy()
            new[1:] |= next_[1:] != next_[:-1]
            at = np.arange(len(open_))
            place = own + at - np.maximum.accumulate(np.where(first, at, 0))  # in the suffix array
            rank[open_] = place[np.maximum.accumulate(np.where(new, at, 0))]
            open_ = open_[~new | ~np.append(new[1:], True)]
            size *= 2
            self.levels.append(rank.copy())
        self.isa = rank[:n]
        self.sa = np.empty(n, np.int32)
        self.sa[self.isa] = np.arange(n, dtype=np.int32)

    def lcp(self) -> tuple[np.ndarray, np.ndarray]:
        """Places p of the array whose suffix shares a symbol or more with the one before, and how many."""
        at = np.flatnonzero(self.levels[0][self.sa[1:]] == self.levels[0][self.sa[:-1]]) + 1
        left, right = self.sa[at - 1].astype(np.int64), self.sa[at].astype(np.int64)
        alike = [np.arange(len(at))]
        for level in self.levels[1:]:
            some = alike[-1]
            alike.append(some[level[left[some]] == level[right[some]]])
        size = np.zeros(len(at), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            some = alike[k]
            some = some[self.levels[k][left[some] + size[some]] == self.levels[k][right[some] + size[some]]]
            size[some] += 1 << k
        return at, size

    def common_before(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """How many symbols before two places (left < right) agree."""
        size = np.zeros(len(left), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            from_ = left - size - (1 << k)
            some = np.flatnonzero(from_ >= 0)
            some = some[self.levels[k][from_[some]] == self.levels[k][from_[some] + right[some] - left[some]]]
            size[some] += 1 << k
        return size


def splits(at: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place p with LCP h > 0: where the part before it begins that shares h symbols, where the part after it ends
    that shares more than h with p. Every two suffixes that share exactly h meet at one such p, from either side.
    """
    begins, ends = [0] * len(at), [0] * len(at)
    open_: list[tuple[int, int, int]] = []  # LCP, place, number
    last = -1
    for k, (p, h) in enumerate(zip(at.tolist(), lcp.tolist(), strict=True)):
        if p != last + 1:  # nothing shared between
            for _, _, j in open_:
                ends[j] = last + 1
            open_ = [(0, p - 1, -1)]
        while open_[-1][0] >= h:
            ends[open_.pop()[2]] = p
        begins[k] = open_[-1][1]
        open_.append((h, p, k))
        last = p
    for _, _, j in open_:
        if j >= 0:
            ends[j] = last + 1
    return np.array(begins, np.int64), np.array(ends, np.int64)


def branching_squares(array: SuffixArray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and periods of all squares whose next word would break the period (primitive or not)."""
    at, lcp = array.lcp()
    begins, ends = splits(at, lcp)
    before, after = at - begins, ends - at
    small = np.minimum(before, after)
    of = np.repeat(np.arange(len(at)), small)
    lower = before <= after
    member = np.where(lower, begins, at)[of] + np.arange(len(of)) - np.repeat(np.cumsum(small) - small, small)
    low, high = np.where(lower, at, begins)[of], np.where(lower, ends, at)[of]
    place, depth, n = array.sa[member].astype(np.int64), lcp[of], len(array.sa)
    found = []
    for other in (place + depth, place - depth):
        some = np.flatnonzero((other >= 0) & (other < n))
        there = array.isa[other[some]]
        some = some[(low[some] <= there) & (there < high[some])]
        found.append((np.minimum(place[some], other[some]), depth[some]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def runs_of(symbols: np.ndarray, times: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and smallest periods q of the runs of at least max(least, times * q) symbols, by start and period.

    ``times`` must be 2 or more.
    """
    if not len(symbols):
        return (np.zeros(0, np.int64),) * 3
    array = SuffixArray(symbols)
    start, period = branching_squares(array)
    turned = array.common_before(start, start + period)
    start, length = start - turned, 2 * period + turned
    some = np.flatnonzero(length >= np.maximum(least, times * period))
    start, length, period = start[some], length[some], period[some]
    by = np.lexsort((period, length, start))  # multiples of a period give the same run
    start, length, period = start[by], length[by], period[by]
    new = np.ones(len(by), bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[new], length[new], period[new]
    by = np.lexsort((period, start))
    return start[by], length[by], period[by]


def found(texts: pa.Array, times: int, least: int) -> tuple[pa.Array, pa.Array, pa.Array]:
    """For each text (null: empty) the number of its words, its runs, and its words without what runs repeat."""
    words = words_of(pc.fill_null(texts.cast(pa.large_string()), ""))
    n = np.diff(words.first)
    document = np.repeat(np.arange(len(n)), n)
    start, length, period = runs_of(document * len(words.names) + words.which, times, least)
    of = document[start]
    shape = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    rows = pa.StructArray.from_arrays([pa.array(x) for x in (start - words.first[of], length, period)], fields=list(shape))
    runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(n) + 1)), pa.int32()), rows)
    steps = np.zeros(len(document) + 1, np.int64)
    np.add.at(steps, start + period, 1)
    np.add.at(steps, start + length, -1)
    stay = np.cumsum(steps[:-1]) == 0
    ends = np.concatenate([[0], np.cumsum(stay)])[words.first]
    kept = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), words.names.cast(pa.large_string()).take(pa.array(words.which[stay])).cast(pa.string()))
    return pa.array(n, pa.int64()), runs, pc.binary_join(kept.cast(pa.list_(pa.string())), " ")


def find_runs(df: DataFrame, times: int = 4, least: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id column, ``n_words``, ``runs`` (structs of start, length and smallest period in words, by start and period) and
    ``collapsed`` (the words that stay, joined by one space) of every row of ``df``.

    Words are what stands between the blanks U+0020 and U+0009 to U+000D, numbered from 0. Runs have at least ``least``
    words and ``times`` (2 or more) periods. A word is dropped if a run holds it after that run's first period.

    One row per input row, repeated and null ids included; null, empty and blank texts have no words and no runs; very long
    texts are searched whole, alone in their batch; an empty table gives no rows; other columns don't matter.
    """
    if times < 2:
        raise ValueError("times must be 2 or more")
    src = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))

    def run(chunks):
        for b in chunks:
            for lo, hi in bpe.batches(b.column(1), BATCH):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *found(b.column(1).slice(lo, hi - lo), times, least)], names=[id_col, "n_words", "runs", "collapsed"])

    runs = F.array().cast("array<struct<start: long, length: long, period: long>>")
    schema = src.select(F.col("_id").alias(id_col), F.lit(0).cast("long").alias("n_words"), runs.alias("runs"), F.lit("").alias("collapsed")).schema
    return src.mapInArrow(run, schema)


def repeated_tails(text: Column, number: Column) -> Column:
    """``text``, where ``number`` % 10 is 0 with its words from some place on replaced by repetitions of the first of them.

    With n words and g = floor(number / 10) the place is a = g % n and the period 1 + floor((n - a) / (3 + g % 8)). A null
    number changes nothing.
    """
    words = F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    g = F.floor(number / 10)

    def turned(words: Column) -> Column:
        n = F.size(words)
        a = F.pmod(g, n).cast("int")
        p = (1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).cast("int")
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, F.when(i >= a, a + F.pmod(i - a, p)).otherwise(i)))

    changed = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, F.array_join(turned(w), " ")).otherwise(F.lit("")))  # the words are split once
    return F.when(F.pmod(number, F.lit(10)) == 0, F.get(changed, F.lit(0))).otherwise(text)


def strongest(runs: Column) -> Column:
    """Of runs by start and period the one with the greatest length / period, the first of equals; null without any."""
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    more = lambda best, x: best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"])
    return F.reduce(runs, none, lambda best, x: F.when(more(best, x), x).otherwise(best))


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The id column, n_runs, the strongest run (start, length, period, exponent_milli) and digests of runs and texts."""
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    best = found.withColumn("_best", strongest(F.col("runs")))
    return best.select(
        id_col,
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col("_best")[c].alias(c) for c in ("start", "length", "period")),
        F.floor(1000 * F.col("_best.length") / F.col("_best.period")).alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
