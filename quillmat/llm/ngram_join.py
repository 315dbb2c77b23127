"""N-gram Jaccard join with adaptive multi-match prefixes.

Words are hashed to 64 bits, and so are shingles of ``n`` words; a document is the set of its shingles.

1. Documents with equal sets are one class. Only the first document of each class is compared.
2. A document's long prefix is its first shingles in hash order. Two linked documents share at least
   min(reach(x), reach(y)) shingles of their long prefixes.
3. Document frequencies of the long prefixes' shingles are counted over the classes, pre-aggregated for groups of rows;
   only shingles that occur more than once come back.
4. Of its long prefix a document indexes the rarest shingles. How many is decided by the estimated cost of its
   candidates: a prefix longer by l - 1 shingles asks for l shared shingles before a pair is verified. An entry holds
   the shingle, numbers, and a parity bitmap of at most SIGN_BYTES, whatever the document's length.
5. Documents that index a shingle meet; very common shingles in blocks of bounded size. Pairs must differ little
   enough by size and by the bitmaps, whose distance never exceeds the sets' difference. A rare shingle (FEW documents
   at most) gives its pairs, and those of a pair are counted against what it is asked for; a common one gives a spanning
   forest of its block's graph, since its documents are mostly copies of each other. Pairs that pass are held against
   the whole bitmaps and then verified exactly, on the whole sets. Where that splits a forest, all remaining pairs
   between the parts are verified too, so no link between different components is lost.
6. Links give components, by stars.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bitmap, bpe, components, scratch

#: Neighbouring rows of a group at most, and bytes of their long prefixes, where it has more than one row.
GROUP_ROWS, GROUP_BYTES = 4096, 1 << 24
#: Documents of a block; prefix shingles of a counting bucket.
MEET, BUCKET = 512, 500_000
#: Documents of a rare shingle; bytes of an entry's bitmap at most.
FEW, SIGN_BYTES = 8, 64
#: Bytes of an entry's bitmap where all pairs between parts are looked at; longer bitmaps stay at SIGN_BYTES.
WIDE_BYTES = 1024
#: There, the least shingles that an entry carries of its document: a pair is given at the least one that both carry.
CARRIED = 32
#: Characters of the texts that are hashed at once, about; a longer text is alone.
BATCH = 500_000
#: Cost of a verification in list entries; the longest lengthening of a prefix.
VERIFY, MOST_MATCHES = 8.0, 3

U = np.uint64
SPREAD, SPREAD2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
STEP = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * SPREAD
    x = (x ^ (x >> U(27))) * SPREAD2
    return x ^ (x >> U(31))


@lru_cache(maxsize=1)
def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64 and of its inverse."""
    base = STEP
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        p = np.full(size, U(b))
        p[0] = U(1)
        out.append(np.cumprod(p))
    return out[0], out[1]


BYTE = mix(np.arange(1, 257, dtype=np.uint64) * U(STEP))


def shingles(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Distinct shingle hashes of each text, ascending. A-Z count as a-z; words are what blanks part."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends_of_text = np.cumsum([len(t) + 1 for t in texts])
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    low = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)
    edge = np.flatnonzero(np.diff(blank.astype(np.int8), prepend=1))
    starts, ends = edge[0::2], edge[1::2]  # the last byte is blank, so there is an end to each start
    up, down = powers(1 << max(BATCH.bit_length(), len(raw).bit_length()))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(BYTE[low] * up[: len(raw)], out=sums[1:])
    word = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * U(STEP))
    last = np.searchsorted(starts, ends_of_text)
    full = np.zeros(max(0, len(word) - n + 1), np.uint64)
    for k in range(n if len(full) else 0):
        full = (full + word[k : k + len(full)]) * U(STEP | 1) ^ (full >> U(29))
    full = mix(full + U(n))
    out, first = [], 0
    for end in last.tolist():
        if end - first >= n:
            out.append(np.unique(full[first : end - n + 1]))
        elif end > first:
            x = np.zeros(1, np.uint64)
            for k in range(first, end):
                x = (x + word[k : k + 1]) * U(STEP | 1) ^ (x >> U(29))
            out.append(mix(x + U((1 << 32) + end - first)))
        else:
            out.append(np.zeros(0, np.uint64))
        first = end
    return out


class Bounds:
    """Lengths and limits for similarity of at least num / den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def least(self, size: int) -> int:
        """Shingles that a set of this size shares with any set it links with, at least."""
        return -(-self.num * size // self.den)

    def reach(self, size: int) -> int:
        """How far the long prefix exceeds the shortest one."""
        return min(size - self.least(size) + 1, self.least(size))

    def long(self, size: int) -> int:
        return size - self.least(size) + self.reach(size)

    def sure(self, size: int) -> int:
        """Shared long-prefix shingles with any linked set, at least: sizes differ by the similarity at most."""
        return min(self.reach(size), self.reach(self.least(size)))

    def differ(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Largest symmetric difference of linked sets of these sizes."""
        return (a + b) * (self.den - self.num) // (self.den + self.num)

    def linked(self, shared: int, a: int, b: int) -> bool:
        return self.den * shared >= self.num * (a + b - shared)


def parity(x: np.ndarray) -> bytes:
    """Bitmap of at least as many bits as shingles: for each place, whether an odd number of them fall there."""
    bits = max(6, int(len(x) - 1).bit_length())
    return np.packbits(np.bincount((x >> U(64 - bits)).astype(np.int64), minlength=1 << bits) & 1, bitorder="little").tobytes()


def fold(bitmap: np.ndarray, size: int) -> np.ndarray:
    """The bitmap of the same set with ``size`` bytes: neighbouring places together."""
    bits = np.unpackbits(bitmap, bitorder="little")
    return np.packbits(np.bitwise_xor.reduce(bits.reshape(size * 8, -1), axis=1), bitorder="little")


def described(df: DataFrame, n: int, bounds: Bounds, id_col: str, text_col: str) -> DataFrame:
    """row, id, size, key (of the set), text (its digest), long (the long prefix), bits, sign (bits of bounded size), grp.

    A group (``grp``, its first row) has neighbouring rows whose long prefixes are few bytes together.
    """
    src = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("_text"))
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("id", df.schema[id_col].dataType), T.StructField("size", T.LongType()), *(T.StructField(c, T.BinaryType()) for c in ("key", "text", "long", "bits", "sign")), T.StructField("grp", T.LongType())])

    def run(chunks):
        group, rows, held = -1, GROUP_ROWS, 0
        for b in chunks:
            for lo, hi in bpe.batches(b.column(2), BATCH):
                part = b.slice(lo, hi - lo)
                texts = [t or b"" for t in part.column(2).cast(pa.binary()).to_pylist()]
                sets = shingles(texts, n)
                bits = [parity(x) if len(x) else b"" for x in sets]
                groups = []
                for row, x in zip(part.column(0).to_pylist(), sets, strict=True):
                    size = 8 * bounds.long(len(x))
                    if rows == GROUP_ROWS or held + size > GROUP_BYTES:
                        group, rows, held = row, 0, 0
                    groups.append(group)
                    rows, held = rows + 1, held + size
                cols = [
                    pa.array([len(x) for x in sets], pa.int64()),
                    pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in sets], pa.binary()),
                    pa.array([hashlib.md5(t, usedforsecurity=False).digest() for t in texts], pa.binary()),
                    pa.array([x[: bounds.long(len(x))].tobytes() for x in sets], pa.binary()),
                    pa.array(bits, pa.binary()),
                    pa.array([x if len(x) <= SIGN_BYTES else fold(np.frombuffer(x, np.uint8), SIGN_BYTES).tobytes() for x in bits], pa.binary()),
                    pa.array(groups, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *cols], names=[f.name for f in schema])

    return src.mapInArrow(scratch.lean(run), schema)


def frequencies(docs: DataFrame, buckets: int) -> DataFrame:
    """grp, tokens, counts: for each group of rows its long-prefix shingles that more than one of ``docs`` hold."""

    def gather(chunks):
        for b in chunks:
            group = b.column(0).to_numpy()
            for g in np.unique(group).tolist():
                rows = np.flatnonzero(group == g)
                token, count = np.unique(np.frombuffer(b"".join(b.column(1).take(pa.array(rows)).to_pylist()), np.uint64), return_counts=True)
                where = (token % U(buckets)).astype(np.int64)
                order = np.argsort(where, kind="stable")
                full, cuts = np.unique(where[order], return_index=True)
                parts = np.split(order, cuts[1:]) if len(full) else []
                yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int64)), pa.array([g] * len(full), pa.int64()), pa.array([token[p].tobytes() for p in parts], pa.binary()), pa.array([count[p].astype("<u4").tobytes() for p in parts], pa.binary())], names=["bucket", "grp", "tokens", "counts"])

    def count(group: pa.Table) -> pa.Table:
        tokens = [np.frombuffer(x, np.uint64) for x in group["tokens"].to_pylist()]
        every, at = np.unique(np.concatenate(tokens), return_inverse=True)
        total = np.bincount(at, np.frombuffer(b"".join(group["counts"].to_pylist()), "<u4")).astype(np.int64)
        out, start = [], 0
        for x in tokens:
            n = total[at[start : start + len(x)]]
            start += len(x)
            out.append((x[n > 1].tobytes(), np.minimum(n[n > 1], 0xFFFFFFFF).astype("<u4").tobytes()))
        return pa.table({"grp": group["grp"], "tokens": pa.array([a for a, _ in out], pa.binary()), "counts": pa.array([b for _, b in out], pa.binary())})

    parts = docs.select("grp", "long").mapInArrow(scratch.lean(gather), "bucket long, grp long, tokens binary, counts binary")
    return parts.groupBy("bucket").applyInArrow(count, "grp long, tokens binary, counts binary")


def choose(frequency: np.ndarray, token: np.ndarray, size: int, bounds: Bounds) -> tuple[np.ndarray, int]:
    """Places in the long prefix that a document indexes, rarest first, and the shared shingles it asks for."""
    order = np.lexsort((token, frequency))
    short = len(token) - bounds.sure(size) + 1
    others = np.cumsum(frequency[order] - 1)
    most = min(MOST_MATCHES, bounds.sure(size))
    costs = [float(others[min(short + m - 1, len(token)) - 1]) * (1 + VERIFY / m) for m in range(1, most + 1)]
    matches = 1 + int(np.argmin(costs))
    return order[: min(short + matches - 1, len(token))], matches


ENTRY = "token long, row long, size int, held long, matches int, common int, sign binary"


def entries(docs: DataFrame, counts: DataFrame, bounds: Bounds) -> DataFrame:
    """Index entries of ``docs`` (the first of each class): only shingles that another of them holds.

    ``held``: the documents that hold the shingle; ``common``: how many of the document's entries more than FEW hold.
    """
    names = [x.split()[0] for x in ENTRY.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        token = np.frombuffer(b"".join(right["tokens"].to_pylist()), np.uint64)
        n = np.frombuffer(b"".join(right["counts"].to_pylist()), "<u4").astype(np.int64)
        order = np.argsort(token)
        token, n = token[order], n[order]
        cols: list[list] = [[np.zeros(0, np.int64)] for _ in kinds]
        which: list[int] = []
        for k, (row, size, raw) in enumerate(zip(left["row"].to_pylist(), left["size"].to_pylist(), left["long"].to_pylist(), strict=True)):
            if not len(token):
                break
            x = np.frombuffer(raw, np.uint64)
            at = np.minimum(np.searchsorted(token, x), len(token) - 1)
            held = np.where(token[at] == x, n[at], 1)
            places, matches = choose(held, x, size, bounds)
            places = places[held[places] > 1]
            same = np.ones(len(places), np.int64)
            for c, v in zip(cols, (x[places].view(np.int64), row * same, size * same, held[places], matches * same, (held[places] > FEW).sum() * same), strict=True):
                c.append(v)
            which += [k] * len(places)
        signs = left["sign"].combine_chunks().take(pa.array(which, pa.int64()))
        return pa.table({**{name: pa.array(np.concatenate(c)).cast(k) for name, c, k in zip(names, cols, kinds, strict=False)}, "sign": signs})

    grouped = docs.select("row", "size", "long", "sign", "grp").groupBy("grp")
    return grouped.cogroup(counts.groupBy("grp")).applyInArrow(run, ENTRY)


def meeting(found: DataFrame) -> DataFrame:
    """Entries dealt to the blocks in which they meet, and sorted; a common shingle's entries go to pairs of blocks."""
    parts = F.ceil(F.col("held") / MEET).cast("long")
    own = F.pmod(F.xxhash64("row"), parts)
    dealt = found.withColumn("side", own).withColumn("_j", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    dealt = dealt.withColumn("lo", F.least("side", "_j")).withColumn("hi", F.greatest("side", "_j")).drop("_j")
    return sorted_blocks(dealt)


def sorted_blocks(dealt: DataFrame) -> DataFrame:
    n = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "token", "lo", "hi").sortWithinPartitions("token", "lo", "hi", "row")


def parting(found: DataFrame) -> DataFrame:
    """As :func:`meeting`, for entries with a ``part``, of which only different ones meet.

    The largest part of a shingle stays in blocks of its own, each entry once; the others come to each of these and meet
    each other as before. So what is sent grows with those outside the largest part, not with the square of all.
    """
    sizes = found.groupBy("token", "part").agg(F.count(F.lit(1)).alias("_n"))
    main = sizes.groupBy("token").agg(F.max(F.struct("_n", "part")).alias("_main"), F.sum("_n").alias("_all"))
    main = main.where("_all > _main._n").select("token", F.col("_main.part").alias("_part"), F.ceil(F.col("_main._n") / MEET).cast("long").alias("_blocks"), F.ceil((F.col("_all") - F.col("_main._n")) / MEET).cast("long").alias("_rest"))
    put = found.join(main, "token")
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    # blocks of the largest part have lo < 0, and all sides there are different
    own = put.where("part = _part").withColumn("lo", -one - F.pmod(F.xxhash64("row"), F.col("_blocks"))).withColumn("hi", zero).withColumn("side", zero)
    rest = put.where("part <> _part")
    over = rest.withColumn("lo", F.explode(F.sequence(-F.col("_blocks"), -one))).withColumn("hi", zero).withColumn("side", one)
    many = rest.withColumn("side", F.pmod(F.xxhash64("row"), F.col("_rest"))).withColumn("_j", F.explode(F.sequence(zero, F.col("_rest") - 1)))
    many = many.withColumn("lo", F.least("side", "_j")).withColumn("hi", F.greatest("side", "_j"))
    dealt = own.unionByName(over).unionByName(many.drop("_j"))
    return sorted_blocks(dealt.drop("_part", "_blocks", "_rest"))


def aligned(signs: list[bytes], least: int) -> np.ndarray:
    """Bitmaps folded to ``least`` bytes, a row each."""
    rows = np.stack([np.frombuffer(s, np.uint8) if len(s) == least else fold(np.frombuffer(s, np.uint8), least) for s in signs])
    return rows.view(np.uint64) if least % 8 == 0 else rows


def close(size: np.ndarray, signs: list[bytes], apart: np.ndarray | None, bounds: Bounds) -> np.ndarray:
    """Which documents of a block may be linked: a symmetric matrix. ``apart``: sides; only different ones meet."""
    folded = aligned(signs, min(map(len, signs)))
    out = np.zeros((len(size), len(size)), bool)
    for i in range(len(size)):
        differ = np.bitwise_count(folded[i + 1 :] ^ folded[i]).sum(axis=1, dtype=np.int64)
        out[i, i + 1 :] = differ <= bounds.differ(size[i + 1 :], size[i])
    if apart is not None:
        out &= apart[:, None] != apart
    return out | out.T


def forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric matrix, from documents with many neighbours on."""
    made, todo = [], np.ones(len(near), bool)
    for i in np.argsort(-near.sum(axis=1), kind="stable").tolist():
        if not todo[i]:
            continue
        todo[i], edge = False, [i]
        while edge:
            new = near[edge] & todo
            to = np.flatnonzero(new.any(axis=0))
            made += [(edge[int(np.argmax(new[:, k]))], k) for k in to.tolist()]
            todo[to], edge = False, to.tolist()
    return made


def rare_pairs(token: np.ndarray, row: np.ndarray, size: np.ndarray, matches: np.ndarray, common: np.ndarray, signs: list[bytes], bounds: Bounds) -> list[np.ndarray]:
    """a, b, need of the pairs of sorted entries with equal tokens that may be linked; FEW entries a token at most."""
    first, second = [], []
    for d in range(1, FEW):
        i = np.flatnonzero(token[d:] == token[:-d])
        if not len(i):
            break
        low, high = np.minimum(size[i], size[i + d]), np.maximum(size[i], size[i + d])
        i = i[bounds.den * low >= bounds.num * high]
        first.append(i)
        second.append(i + d)
    i, j = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (first, second))
    long = np.array([len(s) for s in signs], np.int64)
    least = np.minimum(long[i], long[j])
    near = np.zeros(len(i), bool)
    for width in np.unique(least).tolist():
        at = np.flatnonzero(least == width)
        used, back = np.unique(np.concatenate([i[at], j[at]]), return_inverse=True)
        folded = aligned([signs[k] for k in used.tolist()], width)
        differ = np.bitwise_count(folded[back[: len(at)]] ^ folded[back[len(at) :]]).reshape(len(at), -1).sum(axis=1, dtype=np.int64)
        near[at] = differ <= bounds.differ(size[i[at]], size[j[at]])
    i, j = i[near], j[near]
    need = np.maximum(1, np.minimum(matches[i], matches[j]) - np.minimum(common[i], common[j]))
    return [np.minimum(row[i], row[j]), np.maximum(row[i], row[j]), need]


def carrying(parted: DataFrame) -> DataFrame:
    """``parted`` with ``carried``: the least of its row's shingles there, CARRIED at most."""
    least = parted.groupBy("row").agg(F.slice(F.array_sort(F.collect_set("token")), 1, CARRIED).alias("carried"))
    return parted.join(least, "row")


def given_before(token: int, carried: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of pairs of rows (places in ``carried``) that meet at a shingle: which both carry a lesser one, where they meet too."""
    row = np.repeat(np.arange(len(carried)), [len(c) for c in carried])
    every = np.concatenate([np.zeros(0, np.int64), *carried])
    below = every < token
    names, at = np.unique(every[below], return_inverse=True)
    held = np.zeros((len(carried), len(names) // 8 + 1), np.uint8)
    np.bitwise_or.at(held, (row[below], at // 8), (1 << (at % 8)).astype(np.uint8))
    out, step = np.zeros(len(x), bool), max(1, (1 << 26) // held.shape[1])
    for s in range(0, len(x), step):
        out[s : s + step] = (held[x[s : s + step]] & held[y[s : s + step]]).any(axis=1)
    return out


def candidates(found: DataFrame, bounds: Bounds, all_between: bool) -> DataFrame:
    """a < b, need, token: pairs of rare shingles, which ``need`` of them must give; pairs of common ones, with a token.

    Those of a common shingle are a spanning forest of each block's graph, or (``all_between``) all of its pairs of
    different parts, but for those that an earlier shingle gives.
    """
    src = (parting if all_between else meeting)(found).select("token", "lo", "hi", "row", "held", "size", "matches", "common", "side", "sign", *(["part", "carried"] if all_between else []))

    def block(b: pa.Table, cross: bool) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of rows of a common shingle's block."""
        row, size, side = (b[c].to_numpy() for c in ("row", "size", "side"))
        part = b["part"].to_numpy() if all_between else None
        first, second = [row[:0]], [row[:0]]
        if len(row) > 1 and not (all_between and len(np.unique(part)) < 2):
            signs, order = b["sign"].to_pylist(), np.argsort(size, kind="stable")
            carried = b["carried"].to_pylist() if all_between else None
            sorted_ = size[order].astype(np.int64)
            gaps = np.flatnonzero(bounds.den * sorted_[:-1] < bounds.num * sorted_[1:]) + 1  # only like sizes can link
            for g in np.split(order, gaps):
                if len(g) < 2:
                    continue
                near = close(size[g].astype(np.int64), [signs[k] for k in g.tolist()], side[g] if cross else None, bounds)
                if all_between:
                    x, y = np.nonzero(np.triu(near & (part[g][:, None] != part[g])))
                    if len(x):
                        new = ~given_before(b["token"][0].as_py(), [np.array(carried[k], np.int64) for k in g.tolist()], x, y)
                        x, y = x[new], y[new]
                else:
                    x, y = np.array(forest(near), np.int64).reshape(-1, 2).T
                first.append(row[g[x]])
                second.append(row[g[y]])
        x, y = np.concatenate(first), np.concatenate(second)
        return np.minimum(x, y), np.maximum(x, y)

    def batch(a: np.ndarray, b: np.ndarray, need: np.ndarray, token: int | None) -> pa.RecordBatch:
        of = pa.nulls(len(a), pa.int64()) if token is None else pa.array(np.full(len(a), token), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(need, pa.int64()), of], names=["a", "b", "need", "token"])

    def pairs(b: pa.Table):
        """Of whole blocks, in order; those of one common shingle's block at a time."""
        token, lo, hi, held = (b[c].to_numpy() for c in ("token", "lo", "hi", "held"))
        rare, much = np.flatnonzero(held <= FEW), np.flatnonzero(held > FEW)
        if len(rare) and not all_between:
            some = b.take(pa.array(rare))
            yield batch(*rare_pairs(*(some[x].to_numpy() for x in ("token", "row", "size", "matches", "common")), some["sign"].to_pylist(), bounds), None)
        new = (np.diff(token[much]) != 0) | (np.diff(lo[much]) != 0) | (np.diff(hi[much]) != 0)
        for g in np.split(much, np.flatnonzero(new) + 1) if len(much) else []:
            x, y = block(b.slice(g[0], len(g)), lo[g[0]] != hi[g[0]])
            yield batch(x, y, np.zeros(len(x), np.int64), int(token[g[0]]))

    def run(chunks):
        kept = None  # the last block of a batch may go on in the next one
        for b in chunks:
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([kept, t]).combine_chunks() if kept is not None else t
            keys = [t[c].to_numpy() for c in ("token", "lo", "hi")]
            last = np.flatnonzero(np.logical_or.reduce([np.diff(k) != 0 for k in keys]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield from pairs(t.slice(0, cut).combine_chunks())
            kept = t.slice(cut)
        if kept is not None and len(kept):
            yield from pairs(kept.combine_chunks())

    return src.mapInArrow(scratch.lean(run), "a long, b long, need long, token long")


def near(pairs: DataFrame, docs: DataFrame, bounds: Bounds) -> DataFrame:
    """``pairs`` (a, b) whose whole bitmaps differ little enough."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct()
    held = docs.select("row", "size", "bits").join(ends, "row", "left_semi")
    met = pairs.join(held.select(F.col("row").alias("b"), F.col("size").alias("_m"), F.col("bits").alias("_y")), "b").join(held.select(F.col("row").alias("a"), F.col("size").alias("_n"), F.col("bits").alias("_x")), "a")

    def run(chunks):
        for c in chunks:
            keep = []
            for n, m, x, y in zip(*(c.column(k).to_pylist() for k in range(2, 6)), strict=True):
                both = aligned([x, y], min(len(x), len(y)))
                keep.append(int(np.bitwise_count(both[0] ^ both[1]).sum()) <= bounds.differ(n, m))
            yield c.filter(pa.array(keep, pa.bool_())).select([0, 1])

    return met.select("a", "b", "_n", "_m", "_x", "_y").mapInArrow(scratch.lean(run), "a long, b long")


def sets_of(df: DataFrame, wanted: DataFrame, n: int, text_col: str, bits: int = bitmap.BITS) -> DataFrame:
    """row, shingles: the sets of the documents in ``wanted`` (row, text digest), from their texts."""
    docs = df.select(F.col(text_col).cast("string").alias("_text")).where("_text IS NOT NULL").select(F.unhex(F.md5("_text")).alias("text"), "_text")
    docs = bitmap.thinned(docs, F.xxhash64("text"), wanted.select(F.xxhash64("text").alias("_hash")), bits)

    def run(chunks):
        seen: set[bytes] = set()
        for b in chunks:
            for lo, hi in bpe.batches(b.column(1), BATCH):
                keys, texts = b.column(0).slice(lo, hi - lo).to_pylist(), b.column(1).slice(lo, hi - lo).cast(pa.binary()).to_pylist()
                if len(seen) > 500_000:
                    seen.clear()
                new = {k: t for k, t in zip(keys, texts, strict=True) if k not in seen}
                seen.update(new)
                sets = shingles(list(new.values()), n) if new else []
                yield pa.RecordBatch.from_arrays([pa.array(list(new), pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["text", "shingles"])

    made = docs.mapInArrow(scratch.lean(run), "text binary, shingles binary")
    return made.join(wanted, "text").groupBy("row").agg(F.first("shingles").alias("shingles"))


def verified(pairs: DataFrame, docs: DataFrame, df: DataFrame, n: int, bounds: Bounds, text_col: str) -> DataFrame:
    """``pairs`` (a, b) with linked: whether the whole sets are."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct()
    sets = scratch.table(sets_of(df, docs.select("row", "text").join(ends, "row"), n, text_col, bitmap.sized(2 * pairs.count())), "sets")
    met = pairs.join(sets.select(F.col("row").alias("b"), F.col("shingles").alias("_y")), "b").join(sets.select(F.col("row").alias("a"), F.col("shingles").alias("_x")), "a")

    def run(chunks):
        for c in chunks:
            out = []
            for x, y in zip(c.column(2).to_pylist(), c.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                shared = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                out.append(bounds.linked(shared, len(x), len(y)))
            yield pa.RecordBatch.from_arrays([c.column(0), c.column(1), pa.array(out, pa.bool_())], names=["a", "b", "linked"])

    return met.select("a", "b", "_x", "_y").mapInArrow(scratch.lean(run), "a long, b long, linked boolean")


def link(df: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of ``df``: the id column, ``n_shingles``, ``component_id``, ``kept`` and ``text_md5``.

    Two documents are linked when den * |intersection| >= num * |union| of their sets of distinct shingles of ``n``
    words; ``component_id`` is the smallest id that links reach, its own included, and ``kept`` holds for one row of
    each component, the first with that id. A text of fewer words has one shingle, the whole sequence; null, empty and
    blank texts have none, link with nothing, and are all kept. Null ids are passed over where another id is reachable,
    else the component id is null. Repeated rows are copies of each other; an empty table gives no rows; other columns
    don't matter. Index entries of very long texts are as small as those of others. Sizes and overlaps are of 64-bit
    hashes of shingles.
    """
    if not 0 < num <= den or 2 * num < den:
        raise ValueError("the similarity must be from 1/2 to 1")
    bounds = Bounds(num, den)
    docs = scratch.table(described(df, n, bounds, id_col, text_col), "described")
    some = docs.where("size > 0")
    best = F.min(F.struct(F.col("id").isNull().alias("z"), F.col("id").alias("i"), F.col("row").alias("r"))).alias("best")
    classes = scratch.table(some.groupBy("key").agg(F.min("row").alias("row"), best, F.count(F.lit(1)).alias("copies")), "classes")
    copied = classes.where("copies > 1").select(F.xxhash64("key").alias("_hash"))
    firsts = classes.select(F.col("row").alias("_first"))
    reps = bitmap.within(some, F.xxhash64("key"), copied, firsts, F.col("row") == F.col("_first"), bits=bitmap.sized(copied.count()))
    total = docs.agg(F.sum(F.length("long") / 8)).first()[0] or 0
    counts = frequencies(reps, max(8, int(total // BUCKET) + 1))
    found = scratch.table(entries(reps, counts, bounds), "entries")
    met = scratch.table(candidates(found, bounds, False), "pairs")
    asked = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min("need").alias("need")).where("n >= need").select("a", "b")
    tried = scratch.table(near(asked, docs, bounds), "near")
    links = scratch.table(verified(tried, docs, df, n, bounds, text_col).where("linked").select("a", "b"), "linked")
    parts = components.labels(links)
    failed = met.where("token IS NOT NULL").join(links, ["a", "b"], "left_anti")
    at = lambda c: parts.select(F.col("node").alias(c), F.col("label").alias(f"_{c}"))
    failed = failed.join(at("a"), "a", "left").join(at("b"), "b", "left").select("token", F.coalesce("_a", "a").alias("_a"), F.coalesce("_b", "b").alias("_b")).where("_a <> _b")
    split = scratch.table(failed.select("token", F.col("_a").alias("part")).unionByName(failed.select("token", F.col("_b").alias("part"))).distinct(), "split")
    if not split.isEmpty():
        # two documents of a block that are near but in different parts had a failed pair between them in that block, and
        # so had each one's part
        marks = split.select(F.xxhash64("token").alias("_hash")).distinct()
        parted = bitmap.thinned(found, F.xxhash64("token"), marks).join(parts.select(F.col("node").alias("row"), "label"), "row", "left").withColumn("part", F.coalesce("label", "row")).drop("label")
        parted = parted.join(split, ["token", "part"], "left_semi")
        wide = docs.select("row", F.when(F.length("bits") <= WIDE_BYTES, F.col("bits")).alias("_wide")).join(parted.select("row").distinct(), "row", "left_semi")
        parted = scratch.table(parted.join(wide, "row").withColumn("sign", F.coalesce("_wide", "sign")).drop("_wide"), "parted")
        rest = candidates(carrying(parted), bounds, True).select("a", "b").distinct().join(tried, ["a", "b"], "left_anti")
        more = verified(scratch.table(near(scratch.table(rest, "pairs"), docs, bounds), "near"), docs, df, n, bounds, text_col)
        parts = components.labels(links.unionByName(scratch.table(more.where("linked").select("a", "b"), "linked")))
    named = classes.join(parts.select(F.col("node").alias("row"), "label"), "row", "left").select("key", "best", F.coalesce("label", "row").alias("label"))
    least = named.groupBy("label").agg(F.min("best").alias("component"))
    named = named.select("key", "label").join(least, "label").select("key", F.col("component.i").alias("component"), F.col("component.r").alias("_stays"))
    out = docs.select("row", "id", "size", "key", "text").join(named, "key", "left")
    return out.select(
        F.col("id").alias(id_col), F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("component")).otherwise(F.col("id")).alias("component_id"),
        F.coalesce(F.col("row") == F.col("_stays"), F.lit(True)).alias("kept"), F.lower(F.hex("text")).alias("text_md5"),
    )
