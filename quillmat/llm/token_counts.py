"""Token counts of whole texts by a two-tier lookup in the tasks that read them.

A text is cut into pre-tokens at borders that no token of the vocabulary crosses, so its count is the sum of theirs. The
first tier is a compact table of frequent pre-tokens' lengths in tokens, sent to every task: 16-byte keys (15 bytes and
their number) in open addressing, looked up in numpy for all pre-tokens of a batch at once. What it lacks goes to the
second tier, a bounded table of each worker, and only what that lacks as well is encoded by the library. Pre-tokens are
never shuffled: each task sums up its own in one bounded summary, and only summaries meet.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, scratch

#: Pre-tokens of the first tier, and of each summary, at most. Each that has more than one in FREQUENT of all is there.
FREQUENT = 1 << 15
#: Summaries that are merged at once.
MERGED = 16
#: Pre-tokens that a worker keeps in each of two generations of the second tier.
KEPT = 500_000
#: Characters of the texts that are cut at once, about; a longer text is alone.
BATCH = 2_000_000
#: Bytes of a key, the last of which is their number.
WIDTH = 16
#: Fixed value: the letter that stands for a space in the pieces of a vocabulary.
SPACE = "▁"

U = np.uint64
MASKS = np.array([[(1 << 8 * min(n, 8)) - 1, (1 << 8 * max(n - 8, 0)) - 1] for n in range(WIDTH)], np.uint64)


def offsets_and_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each text of an array without nulls ends among the bytes of all (from 0 on), and the bytes."""
    if not len(texts):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return offsets - offsets[0], np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]


class Pieces:
    """A sentencepiece vocabulary. Where it falls back to bytes, texts are cut between bytes that no piece has side by side.

    A merge needs a piece that holds both sides, so none crosses such a border and each stretch is encoded alone: after
    a letter that no piece has, which keeps the library's leading space apart. Other vocabularies get whole texts.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(self.library.get_piece_size())
        plain = [self.library.id_to_piece(i) for i in ids if not (self.library.is_byte(i) or self.library.is_control(i) or self.library.is_unknown(i))]
        seen = set("".join(plain))
        self.fence = next(c for c in map(chr, [10, *range(0xE000, 0xF8FF)]) if c not in seen)
        self.base = len(self.library.encode(self.fence))
        probe = f"  a {self.fence} ﬁ  "
        self.cuts = any(map(self.library.is_byte, ids)) and not any(map(self.library.is_unused, ids)) and self.library.normalize(probe) == SPACE + probe.replace(" ", SPACE)
        apart = np.ones((256, 256), bool)
        apart[:, 0x80:0xC0] = False  # within a letter
        for p in plain:
            raw = np.frombuffer(p.replace(SPACE, " ").encode(), np.uint8)
            apart[raw[:-1], raw[1:]] = False
        self.apart = apart.ravel()

    def prepared(self, texts: pa.Array) -> pa.Array:
        """Each text as it is cut: with the space that the library puts before it, and spaces for the letter of a space."""
        if not self.cuts:
            return texts
        texts = pc.replace_substring(texts, SPACE, " ")
        return pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string())))

    def borders(self, raw: np.ndarray, first: np.ndarray) -> np.ndarray:
        """For each byte whether a pre-token surely begins there; ``first``: where texts begin."""
        cut = np.zeros(len(raw), bool)
        if self.cuts:
            cut[1:] = self.apart[raw[:-1].astype(np.uint16) * np.uint16(256) + raw[1:]]
        return cut

    def lengths(self, parts: list[bytes]) -> list[int]:
        texts = [p.decode() for p in parts]
        if not self.cuts:
            return list(map(len, self.library.encode(texts, num_threads=1)))
        return [len(x) - self.base for x in self.library.encode([self.fence + t for t in texts], num_threads=1)]

    def odd(self, texts: pa.Array) -> np.ndarray:
        return np.zeros(0, np.int64)


class ByteLevel:
    """A byte-level vocabulary of the tokenizers library, cut where its split pattern always cuts."""

    def __init__(self, path: str):
        self.coder = bpe.Bpe(path, "library")

    def prepared(self, texts: pa.Array) -> pa.Array:
        return texts

    def borders(self, raw: np.ndarray, first: np.ndarray) -> np.ndarray:
        kinds = bpe.KIND[raw]
        pair = kinds[:-1] * np.uint8(8) + kinds[1:]
        pair[first[first > 0] - 1] = 63  # two texts: says nothing
        cut = np.zeros(len(raw), bool)
        cut[1:] = bpe.BETWEEN[pair]
        cut[:-1] |= bpe.BEFORE[pair]
        return cut

    def lengths(self, parts: list[bytes]) -> list[int]:
        return [len(x) // 4 for x in self.coder.encode_batch([p.decode() for p in parts])]

    def odd(self, texts: pa.Array) -> np.ndarray:
        """Texts whose borders depend on more than two neighbouring bytes; they are encoded whole."""
        odd = pc.match_substring_regex(texts, bpe.WIDE_BLANKS)
        for token in self.coder.special:
            odd = pc.or_(odd, pc.match_substring(texts, token))
        return np.flatnonzero(odd.to_numpy(zero_copy_only=False))


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Pieces | ByteLevel:
    """One reader for each worker and file: ``.model`` by sentencepiece, byte-level ``.json`` by tokenizers."""
    if path.endswith(".model"):
        return Pieces(path)
    if path.endswith(".json"):
        return ByteLevel(path)
    raise ValueError(f"neither a .model nor a .json file: {path}")


def pre_tokens(words: Pieces | ByteLevel, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of prepared texts, starts of the pre-tokens with the last one's end, and of each text its first pre-token's
    number (and the number of all).
    """
    offsets, raw = offsets_and_bytes(texts)
    if not len(raw):
        return raw, np.zeros(1, np.int64), np.zeros(len(offsets), np.int64)
    begin = offsets[:-1][offsets[:-1] < len(raw)]
    cut = words.borders(raw, begin)
    cut[begin] = True
    starts = np.append(np.flatnonzero(cut), len(raw))
    return raw, starts, np.searchsorted(starts, offsets)


def keys_of(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A key of 16 bytes for each stretch of fewer: its bytes, zeros, and their number."""
    padded = np.concatenate([raw, np.zeros(WIDTH, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
    out = np.empty((len(starts), 2), np.uint64)
    out[:, 0] = eight[starts] & MASKS[sizes, 0]
    out[:, 1] = (eight[starts + 8] & MASKS[sizes, 1]) | (sizes.astype(np.uint64) << U(56))
    return out


class Table:
    """Lengths in tokens by key, in open addressing."""

    def __init__(self, keys: np.ndarray, lengths: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(4 * len(keys) + 1))))
        self.shift, self.mask = U(64 - bits), (1 << bits) - 1
        self.keys, self.lengths = np.zeros((1 << bits, 2), np.uint64), np.zeros(1 << bits, np.uint8)  # no key is all zeros
        todo, at = np.arange(len(keys)), self.slot(keys)
        while len(todo):
            free = self.keys[at, 1] == 0
            won = np.flatnonzero(free)[np.unique(at[free], return_index=True)[1]]
            self.keys[at[won]], self.lengths[at[won]] = keys[todo[won]], lengths[todo[won]]
            rest = np.ones(len(todo), bool)
            rest[won] = False
            todo, at = todo[rest], (at[rest] + 1) & self.mask

    def slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = (keys[:, 0] ^ (keys[:, 1] * U(0xD6E8FEB86659FD93))) * U(0x9E3779B97F4A7C15)
        return (mixed >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Lengths, 0 for keys that aren't there."""
        out, todo, at = np.zeros(len(keys), np.int64), np.arange(len(keys)), self.slot(keys)
        while len(todo):
            seen = self.keys[at]
            hit = (seen == keys[todo]).all(axis=1)
            out[todo[hit]] = self.lengths[at[hit]]
            on = ~hit & (seen[:, 1] != 0)
            todo, at = todo[on], (at[on] + 1) & self.mask
        return out


class Counter:
    """Counts the tokens of batches of texts: the sent table first, then the worker's own, then the library."""

    def __init__(self, path: str, table: Table):
        self.words, self.table, self.kept = vocabulary(path), table, bpe.Kept(KEPT)

    def count(self, texts: pa.Array) -> np.ndarray:
        """Tokens of every whole text (null: empty)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = self.words.odd(texts)
        plain = texts
        if len(odd):
            mask = np.zeros(len(texts), bool)
            mask[odd] = True
            plain = pc.if_else(pa.array(mask), "", texts)
        raw, starts, first = pre_tokens(self.words, self.words.prepared(plain))
        sizes = np.diff(starts)
        found = np.zeros(len(sizes), np.int64)
        short = np.flatnonzero(sizes < WIDTH)
        found[short] = self.table.find(keys_of(raw, starts[short], sizes[short]))
        missed = np.flatnonzero(found == 0)
        if len(missed):
            whole = raw.tobytes()
            parts = [whole[a:b] for a, b in zip(starts[missed].tolist(), starts[missed + 1].tolist(), strict=True)]
            got = self.kept.find(parts)
            new = list(dict.fromkeys(p for p, n in zip(parts, got, strict=True) if n is None))
            if new:
                made = dict(zip(new, self.words.lengths(new), strict=True))
                got = [made[p] if n is None else n for p, n in zip(parts, got, strict=True)]
                self.kept.add(new, list(made.values()))
            found[missed] = got
        total = np.concatenate([[0], np.cumsum(found)])
        counts = np.diff(total[first])
        if len(odd):
            counts[odd] = self.words.lengths([t.encode() for t in texts.take(pa.array(odd)).to_pylist()])
        return counts


class Summary:
    """Numbers of keys in bounded space: when too many are held, the count of the first one too many is taken from all.

    A key that has more than one in ``most`` of all occurrences is never lost.
    """

    def __init__(self, most: int):
        self.keys, self.counts, self.most = np.zeros(0, f"V{WIDTH}"), np.zeros(0, np.int64), most

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        both = np.concatenate([self.keys, keys])
        names = pa.FixedSizeBinaryArray.from_buffers(pa.binary(WIDTH), len(both), [None, pa.py_buffer(both.tobytes())]).dictionary_encode()
        sums = np.bincount(names.indices.to_numpy(), np.concatenate([self.counts, counts]), len(names.dictionary)).astype(np.int64)
        held = np.frombuffer(names.dictionary.buffers()[1], f"V{WIDTH}")[: len(sums)]
        if len(sums) > self.most:
            sums -= np.partition(sums, len(sums) - self.most - 1)[len(sums) - self.most - 1]
        self.keys, self.counts = held[sums > 0], sums[sums > 0]

    def row(self, group: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([group], pa.int64()), pa.array([self.keys.tobytes()], pa.binary()), pa.array([self.counts.tobytes()], pa.binary())], names=["_group", "_keys", "_counts"])


def frequent(texts: DataFrame, path: str, most: int) -> np.ndarray:
    """Keys of the frequent pre-tokens of ``texts`` (one column), at most ``most``, as rows of two unsigned integers.

    Every text counts. A task leaves one summary of at most ``most`` keys, and summaries are merged MERGED at a time.
    """

    def run(chunks):
        words, seen = vocabulary(path), Summary(most)
        for b in chunks:
            for lo, hi in bpe.batches(b.column(0), BATCH):
                part = pc.fill_null(b.column(0).slice(lo, hi - lo).cast(pa.large_string()), "")
                raw, starts, _ = pre_tokens(words, words.prepared(part))
                sizes = np.diff(starts)
                short = np.flatnonzero(sizes < WIDTH)
                seen.add(keys_of(raw, starts[short], sizes[short]).view(f"V{WIDTH}").ravel(), np.ones(len(short), np.int64))
        yield seen.row(TaskContext.get().partitionId())

    def merge(table: pa.Table) -> pa.Table:
        seen = Summary(most)
        for keys, counts in zip(table.column("_keys").to_pylist(), table.column("_counts").to_pylist(), strict=True):
            seen.add(np.frombuffer(keys, f"V{WIDTH}"), np.frombuffer(counts, np.int64))
        return pa.Table.from_batches([seen.row(table.column("_group")[0].as_py())])

    schema = "_group long, _keys binary, _counts binary"
    parts = scratch.table(texts.mapInArrow(run, schema), "summaries")
    groups = (parts.agg(F.max("_group")).first()[0] or 0) + 1
    while groups > 1:
        groups = -(-groups // MERGED)
        parts = parts.withColumn("_group", F.floor(F.col("_group") / MERGED)).groupBy("_group").applyInArrow(merge, schema)
    last = parts.collect()  # one row, of at most 24 bytes a key
    return np.frombuffer(last[0]["_keys"] if last else b"", "<u8").reshape(-1, 2)


def table_of(keys: np.ndarray, path: str) -> Table:
    """The first tier for these keys."""
    parts = [k[: k[WIDTH - 1]] for k in (x.tobytes() for x in keys)]
    lengths = np.array(vocabulary(path).lengths(parts) if parts else [], np.uint8)
    return Table(keys, lengths)


def count_tokens(df: DataFrame, path: str, limit: int = 4096, most: int = FREQUENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id column, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (n_tokens > limit) of every row of ``df``.

    ``path``: a sentencepiece ``.model`` or a byte-level ``.json`` of the tokenizers library. Counts are those of the
    library without begin, end or added special tokens; strings of special tokens inside texts are handled as the library
    does by default. ``most`` bounds the table that is sent to every task; it changes no count.

    One row per input row, repeated and null ids included; null and empty texts have 0 bytes and tokens; very long texts
    are counted whole, in time and memory in proportion to their length; an empty table gives no rows; other columns
    don't matter.
    """
    src = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    sent = src.sparkSession.sparkContext.broadcast(table_of(frequent(src.select("_text"), path, most), path))

    def run(chunks):
        counter = Counter(path, sent.value)
        for b in chunks:
            for lo, hi in bpe.batches(b.column(1), BATCH):
                texts = b.column(1).slice(lo, hi - lo)
                tokens = counter.count(texts)
                size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), size, pa.array(tokens, pa.int64()), pa.array(tokens > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    zero = F.lit(0).cast("long")
    schema = src.select(F.col("_id").alias(id_col), zero.alias("n_bytes"), zero.alias("n_tokens"), F.lit(True).alias("over_limit")).schema
    return src.mapInArrow(run, schema)
