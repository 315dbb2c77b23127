"""Phrases whose words keep together, from FM-indexes of shards of the corpus.

Each task turns its texts into shards: word ids of a vocabulary of the shard's own, with a mark between pieces. Over a
shard lie two FM-indexes, of its sequence and of the reversed one, ordered by as many words as phrases need. A phrase is an
interval of rows in either; extending it by a word on one side is a step by the last-to-first mapping of one index, and
its interval in the other follows from the words that sort before (bidirectional extension). All intervals of a level are
extended at once, to the right and to the left in turn, which enumerates every phrase of the shard with its count.

Most phrases are rare everywhere, so before any phrase is written out the shards send, for each of theirs, 32 bits of a
hash and a count, packed by buckets of the hash's first bits. A bucket sums them up and answers with a bit for each phrase:
whether the corpus may have enough of it. Only phrases with that bit are sent as text and summed exactly. The bits spare
work and decide nothing: hashes that coincide let more phrases through, never fewer.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch
from .runs import edges_of
from .token_counts import offsets_and_bytes

#: Bytes of texts whose words are numbered together, and words of a shard, about; a longer piece is never cut.
TEXTS, WORDS = 1 << 23, 1 << 21
#: Phrases of shards, counted anew in each, that one bucket sums up, about.
BUCKET = 1 << 20
#: Ways that a language's candidates are dealt before its best are chosen.
DEALT = 64
#: Blanks between words, signs between pieces.
BLANKS, SIGNS = (32, 9), (*b".,;:!?", 10, 11, 12, 13)

U = np.uint64


class Sequence(NamedTuple):
    """Word ids from 1 with 0 between pieces and at the end; ``names`` and ``langs`` by id - 1."""

    ids: np.ndarray
    names: pa.Array
    langs: pa.Array


def sequence(texts: pa.Array, langs: pa.Array) -> Sequence:
    """All words of texts (null: empty) as one sequence; a language's words are its own."""
    offsets, raw = offsets_and_bytes(pc.fill_null(texts.cast(pa.large_string()), ""))
    lower, kind = np.arange(256, dtype=np.uint8), np.zeros(256, np.uint8)
    lower[65:91] += 32
    kind[list(BLANKS)], kind[list(SIGNS)] = 1, 2
    raw = lower[raw]
    kinds = kind[raw]
    begins, ends = edges_of(kinds == 0, offsets)
    if not len(begins):
        return Sequence(np.zeros(1, np.int32), pa.array([], pa.large_string()), pa.array([], pa.string()))
    signs = np.concatenate([[0], np.cumsum(kinds == 2)])
    first = np.searchsorted(begins, offsets)
    apart = np.zeros(len(begins), bool)
    apart[1:] = signs[begins[1:]] > signs[ends[:-1]]
    apart[first[:-1][first[:-1] < len(begins)]] = True
    borders = np.stack([begins, ends], 1).ravel()
    parts = pa.Array.from_buffers(pa.large_binary(), len(borders) - 1, [None, pa.py_buffer(borders), pa.py_buffer(raw)]).dictionary_encode()
    names = len(parts.dictionary)
    spoken = pc.fill_null(langs.cast(pa.string()), "und").dictionary_encode()
    of = np.repeat(spoken.indices.to_numpy().astype(np.int64), np.diff(first))
    distinct, ids = np.unique(of * names + parts.indices.to_numpy()[::2], return_inverse=True)
    ids = np.append(np.insert(ids.astype(np.int32) + 1, np.flatnonzero(apart[1:]) + 1, 0), np.int32(0))
    return Sequence(ids, parts.dictionary.cast(pa.large_string()).take(pa.array(distinct % names)), spoken.dictionary.take(pa.array(distinct // names)))


def cut(ids: np.ndarray, most: int) -> list[np.ndarray]:
    """Parts of a sequence that end with a mark, of at most ``most`` words where no piece is longer."""
    marks, parts, start = np.flatnonzero(ids == 0), [], 0
    while start < len(ids):
        k = int(np.searchsorted(marks, start + most, "right")) - 1
        end = int(marks[max(k, int(np.searchsorted(marks, start)))]) + 1
        parts.append(ids[start:end])
        start = end
    return parts


class FmIndex:
    """The Burrows-Wheeler transform of a sequence, by rows in the order of their first ``order`` symbols."""

    def __init__(self, ids: np.ndarray, order: int):
        n = len(ids)
        base, rank = np.int64(ids.max() + 1), ids.astype(np.int64)
        for k in range(1, order):
            rank = rank * base + np.roll(ids, -k)
            if k + 1 < order:
                rank = np.unique(rank, return_inverse=True)[1].astype(np.int64)
        self.bwt = ids[np.argsort(rank) - 1]
        del rank
        # row before the last-to-first mapping, by row after it
        self.row = np.argsort(self.bwt * np.int64(n) + np.arange(n)).astype(np.int32)
        self.symbol = self.bwt[self.row]
        self.first = np.searchsorted(self.symbol, np.arange(base + 1))

    def extend(self, low: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All extensions of disjoint intervals: the interval each is of, its symbol (not 0), its first row and size.

        Rows with one symbol before them stay in order under the last-to-first mapping, so those of one interval stay
        side by side.
        """
        of = np.full(len(self.bwt), -1, np.int32)
        of[np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())] = np.repeat(np.arange(len(low), dtype=np.int32), size)
        of = of[self.row]
        new = np.ones(len(of), bool)
        new[1:] = (of[1:] != of[:-1]) | (self.symbol[1:] != self.symbol[:-1])
        at = np.flatnonzero(new)
        sizes = np.diff(np.append(at, len(of)))
        some = (of[at] >= 0) & (self.symbol[at] > 0)
        return of[at[some]], self.symbol[at[some]], at[some], sizes[some]


def followed(low: np.ndarray, size: np.ndarray, of: np.ndarray, symbol: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """First rows in the other index of extensions of intervals (``low``, ``size`` there): after all lesser symbols."""
    by = np.lexsort((symbol, of))
    before = np.cumsum(sizes[by]) - sizes[by]
    inside = np.bincount(of, sizes, len(low)).astype(np.int64)
    out = np.empty(len(of), np.int64)
    # marks are the least symbols: what isn't in an extension comes first
    out[by] = low[of[by]] + (size - inside)[of[by]] + before - (np.cumsum(inside) - inside)[of[by]]
    return out


def phrases_of(ids: np.ndarray, most: int) -> list[tuple[list[np.ndarray], np.ndarray]]:
    """For each length from 1 to ``most`` the distinct phrases of a sequence, as a column of ids for each word, and counts."""
    if not ids.any():
        return [([np.zeros(0, np.int32)] * k, np.zeros(0, np.int64)) for k in range(1, most + 1)]
    ahead, back = (FmIndex(s, max(1, most - 1)) for s in (ids, ids[::-1]))
    word = np.flatnonzero(np.diff(ahead.first))[1:].astype(np.int32)  # without the mark
    size, low, other = np.diff(ahead.first)[word], ahead.first[word], back.first[word]
    levels = [([word], size)]
    for k in range(1, most):
        words, right = levels[-1][0], k % 2 == 1
        index, mine, its = (back, other, low) if right else (ahead, low, other)
        by = np.argsort(mine)
        of, symbol, mine_, sizes = index.extend(mine[by], size[by])
        of = by[of]
        its_ = followed(its, size, of, symbol, sizes) if k + 1 < most else its[:0]
        words = [w[of] for w in words]
        levels.append(([*words, symbol] if right else [symbol, *words], sizes))
        size, low, other = sizes, *((its_, mine_) if right else (mine_, its_))
    return levels


def hashed(words: list[np.ndarray], names: np.ndarray) -> np.ndarray:
    """64-bit hashes of phrases from those of their words (by id)."""
    out = np.full(len(words[0]), len(words), np.uint64)
    for w in words:
        out = (out ^ names[w]) * U(0x9E3779B97F4A7C15)
        out ^= out >> U(32)
    return out * U(0xD6E8FEB86659FD93)


class Shard(NamedTuple):
    """A shard as it is kept between jobs: words in one compressed text, one a line, language and sequence."""

    shard: int
    langs: list[str]
    totals: list[int]
    names: bytes
    lang_of: bytes
    ids: bytes

    @classmethod
    def of(cls, number: int, ids: np.ndarray, names: pa.Array, langs: pa.Array) -> Shard:
        used, inverse = np.unique(ids, return_inverse=True)  # the mark is among them
        spoken = langs.take(pa.array(used[1:] - 1)).dictionary_encode()
        lang_of = spoken.indices.to_numpy().astype("<i4")
        totals = np.bincount(lang_of, np.bincount(inverse)[1:], len(spoken.dictionary)).astype(np.int64)
        text = "\n".join(names.take(pa.array(used[1:] - 1)).to_pylist()).encode()
        pack = zstandard.ZstdCompressor(3).compress
        return cls(number, spoken.dictionary.to_pylist(), totals.tolist(), pack(text), pack(lang_of.tobytes()), pack(inverse.astype("<i4").tobytes()))

    def opened(self) -> tuple[np.ndarray, list[bytes], np.ndarray]:
        """Ids, words, and the number of each word's language."""
        open_ = zstandard.ZstdDecompressor().decompress
        text, lang_of = open_(self.names), np.frombuffer(open_(self.lang_of), "<i4")
        return np.frombuffer(open_(self.ids), "<i4"), text.split(b"\n") if len(lang_of) else [], lang_of

    def phrases(self, most: int) -> tuple[np.ndarray, np.ndarray, list, np.ndarray]:
        """Hashes of all phrases, their order by hash, the phrases by length, and their counts."""
        ids, names, lang_of = self.opened()
        own = [lang.encode() + b"\n" for lang in self.langs]
        values = np.fromiter((xxhash.xxh64_intdigest(own[k] + w) for w, k in zip(names, lang_of.tolist(), strict=True)), np.uint64, len(names))
        levels = phrases_of(ids, most)
        values = np.concatenate([np.zeros(1, np.uint64), values])
        hashes = np.concatenate([hashed(words, values) for words, _ in levels])
        return hashes, np.argsort(hashes), levels, np.concatenate([counts for _, counts in levels])


def shards(df: DataFrame, words: int = WORDS, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The shards of ``df``'s texts, written once to the shared folder."""
    src = df.select(F.col(lang_col).cast("string").alias("_lang"), F.col(text_col).cast("string").alias("_text"))

    def run(chunks):
        held: list[pa.RecordBatch] = []
        number, size = TaskContext.get().partitionId() << 32, 0

        def made():
            nonlocal number
            whole = pa.Table.from_batches(held).combine_chunks()
            seq = sequence(whole.column(1).combine_chunks(), whole.column(0).combine_chunks())
            for ids in cut(seq.ids, words) if len(seq.names) else []:
                number += 1
                yield pa.RecordBatch.from_pylist([Shard.of(number, ids, seq.names, seq.langs)._asdict()], schema)

        for b in chunks:
            ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy().astype(np.int64))
            start = 0
            while start < len(ends):
                base = ends[start - 1] if start else 0
                end = max(start + 1, int(np.searchsorted(ends, base + TEXTS - size, "right")))
                held.append(b.slice(start, end - start))
                size += ends[end - 1] - base
                start = end
                if size >= TEXTS or start < len(ends):
                    yield from made()
                    held, size = [], 0
        if held:
            yield from made()

    schema = pa.schema([("shard", pa.int64()), ("langs", pa.list_(pa.string())), ("totals", pa.list_(pa.int64())), ("names", pa.binary()), ("lang_of", pa.binary()), ("ids", pa.binary())])
    return scratch.table(src.mapInArrow(run, "shard long, langs array<string>, totals array<long>, names binary, lang_of binary, ids binary"), "shards")


def as_shard(row: dict) -> Shard:
    return Shard(*(row[c] for c in Shard._fields))


def promising(parts: DataFrame, most: int, least: int, buckets: int) -> DataFrame:
    """shard, bucket, bits: of each shard's phrases in the order of their hashes, which may occur ``least`` times in all."""
    bits = buckets.bit_length() - 1

    def send(chunks):
        for b in chunks:
            for row in (b.slice(i, 1).to_pylist()[0] for i in range(b.num_rows)):
                hashes, by, _, counts = as_shard(row).phrases(most)
                hashes, counts = hashes[by], np.minimum(counts[by], 255).astype(np.uint8)
                place = (hashes >> U(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)
                marks = (hashes >> U(32 - bits)).astype(np.uint32)
                which, at = np.unique(place, return_index=True)
                to = np.append(at[1:], len(place))
                for lo in range(0, len(which), 1024):
                    some = [(int(k), int(x), int(y)) for k, x, y in zip(which[lo : lo + 1024], at[lo : lo + 1024], to[lo : lo + 1024], strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in some], pa.int64()), pa.array([row["shard"]] * len(some), pa.int64()), pa.array([marks[x:y].tobytes() for _, x, y in some], pa.binary()), pa.array([counts[x:y].tobytes() for _, x, y in some], pa.binary())], names=["bucket", "shard", "marks", "counts"])

    def answer(table: pa.Table) -> pa.Table:
        raw = table.column("marks").to_pylist()
        marks = np.frombuffer(b"".join(raw), np.uint32)
        counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), np.uint8)
        by = np.argsort(marks)
        ordered = marks[by]
        new = np.ones(len(by), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        enough = np.add.reduceat(counts[by], np.flatnonzero(new), dtype=np.int64) >= least
        passed = np.empty(len(by), bool)
        passed[by] = enough[np.cumsum(new) - 1]
        ends = np.cumsum([len(x) // 4 for x in raw])[:-1]
        return pa.table({"shard": table.column("shard"), "bucket": table.column("bucket"), "bits": pa.array([np.packbits(x).tobytes() for x in np.split(passed, ends)], pa.binary())})

    sent = parts.mapInArrow(send, "bucket long, shard long, marks binary, counts binary")
    return sent.groupBy("bucket").applyInArrow(answer, "shard long, bucket long, bits binary")


def phrases(df: DataFrame, most: int = 3, least: int = 10, words: int = WORDS, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Phrases of up to ``most`` words that occur ``least`` times or more in their language, and the languages' sizes.

    The first has lang, k (words), phrase (space-joined) and a (occurrences); the second lang and n (words in all).
    """
    if least > 255:
        raise ValueError("least must be 255 or less")  # counts are sent in a byte
    parts = shards(df, words, lang_col, text_col)
    sizes = parts.select(F.explode(F.arrays_zip("langs", "totals")).alias("t")).groupBy(F.col("t.langs").alias("lang")).agg(F.sum("t.totals").alias("n"))
    total = (sizes.agg(F.sum("n")).first()[0] or 0) * most
    buckets = 1 << max(0, int(total // BUCKET).bit_length())
    bits_of = buckets.bit_length() - 1

    def tell(left: pa.Table, right: pa.Table) -> pa.Table:
        shard = as_shard(left.to_pylist()[0])
        hashes, by, levels, counts = shard.phrases(most)
        place = (hashes[by] >> U(64 - bits_of)).astype(np.int64) if bits_of else np.zeros(len(by), np.int64)
        stay = np.zeros(len(by), bool)
        answers = right.select(["bucket", "bits"]).to_pydict()
        for k, bits in zip(answers["bucket"], answers["bits"], strict=True):
            lo, hi = np.searchsorted(place, [k, k + 1])
            stay[by[lo:hi]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=hi - lo)
        _, names, lang_of = shard.opened()
        names, langs, spoken, made, start = pa.array([b"", *names], pa.binary()).cast(pa.string()), pa.array(shard.langs, pa.string()), np.append(0, lang_of), [], 0
        for k, (ws, n) in enumerate(levels, 1):
            some = np.flatnonzero(stay[start : start + len(n)])
            start += len(n)
            text = pc.binary_join_element_wise(*(names.take(pa.array(w[some])) for w in ws), " ")
            made.append(pa.table({"lang": langs.take(pa.array(spoken[ws[0][some]])), "k": pa.array(np.full(len(some), k), pa.int32()), "phrase": text, "n": pa.array(n[some], pa.int64())}))
        return pa.concat_tables(made)

    bits = promising(parts, most, least, buckets)
    told = parts.groupBy("shard").cogroup(bits.groupBy("shard")).applyInArrow(tell, "lang string, k int, phrase string, n long")
    held = told.groupBy("lang", "k", "phrase").agg(F.sum("n").alias("a")).where(F.col("a") >= least)
    return scratch.table(held, "phrases"), sizes


def collocations(df: DataFrame, least_words: int = 2, most: int = 3, least: int = 10, share: tuple[int, int] = (50, 100), top: int = 2000, words: int = WORDS, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The ``top`` phrases of each language: lang, rank (from 1), phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), cut into pieces at the signs .,;:!? and U+000A to U+000D, and these into words at spaces and
    tabs. A candidate has ``least_words`` to ``most`` words and occurs a >= ``least`` times within pieces, overlaps included.
    Cut into two parts with l and r occurrences it scores floor(10**6 * a * a / (l * r)), and the lowest-scoring cut counts,
    of equals the first. Candidates go that lie within a longer candidate with share[1] * f >= share[0] * a. n: all words
    of the language. Order: score and a descending, then phrase by its bytes. Products are decimals, exact up to 10**15
    occurrences.

    A null language is ``und``; null and empty texts have no words; repeated rows count each; very long texts are cut into
    shards between pieces; an empty table gives no rows; other columns don't matter. ``words`` bounds a shard and
    changes no result.
    """
    held, sizes = phrases(df, most, least, words, lang_col, text_col)
    part = lambda n: F.call_function("substring_index", F.col("phrase"), F.lit(" "), n)
    longer = held.where(F.col("k") > least_words)
    ends = [longer.select("lang", part(n).alias("phrase"), F.col("a").alias("_a")) for n in (F.col("k") - 1, 1 - F.col("k"))]
    # a longer phrase than by one word has one of these within it, which occurs as often at least
    ends = ends[0].unionByName(ends[1]).groupBy("lang", "phrase").agg(F.max("_a").alias("_longer"))
    wide = lambda c: F.col(c).cast("decimal(15,0)")
    cuts = held.where(F.col("k") >= least_words).join(ends, ["lang", "phrase"], "left").where(F.coalesce(F.col("_longer") * share[1] < F.col("a") * share[0], F.lit(True)))
    cuts = cuts.select("lang", "phrase", "k", "a", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("_cut"))
    cuts = cuts.select("lang", "phrase", "a", "_cut", part(F.col("_cut")).alias("_left"), part(F.col("_cut") - F.col("k")).alias("_right"))
    for side, name in (("_left", "l"), ("_right", "r")):
        cuts = cuts.join(held.select("lang", F.col("phrase").alias(side), F.col("a").alias(name)), ["lang", side])
    exact = cuts.withColumn("_top", F.lit(1_000_000).cast("decimal(7,0)") * (wide("a") * wide("a")).cast("decimal(31,0)")).withColumn("_low", wide("l") * wide("r"))
    best = exact.select("lang", "phrase", "a", F.struct(F.expr("_top div _low").alias("score"), "_cut", "l", "r").alias("_best")).groupBy("lang", "phrase", "a").agg(F.min("_best").alias("_best"))
    rows = best.select("lang", "phrase", "a", "_best.l", "_best.r", "_best.score")
    order = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    # first the best of each of DEALT parts of a language, so that no task orders all of one
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(DEALT))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return rows.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
