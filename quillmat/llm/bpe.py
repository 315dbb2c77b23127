"""BPE encoding and decoding of whole texts.

``Bpe`` reads a byte-level BPE vocabulary file and encodes with a segment tree over adjacent pair ranks: the root holds
the lowest rank and its leftmost place, a merge updates three leaves and their ancestors, and encoding ends when the
root holds no mergeable pair. Many pieces are encoded side by side, one row of a matrix each, so the tree's point
updates are numpy operations over all pieces that still merge.

A batch of texts is cut at places that are always piece borders of the vocabulary's split pattern: around blanks and
between letters, digits and other ASCII signs. Arrow finds the distinct stretches of the batch, only those that a bounded
table of the worker lacks are encoded, and numpy gathers the ids of all stretches.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the split pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Stretches whose ids a worker keeps in each of two generations of a table.
KEPT = 300_000
#: Fixed value: blanks beyond ASCII. The runs they are in may reach over a cut, so texts that hold one are split whole.
WIDE_BLANKS = "[\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
NO_PAIR = np.int64(1) << 62
SPACE, BLANK, LETTER, DIGIT, SIGN, APOSTROPHE, WIDE = range(7)


def byte_kinds() -> np.ndarray:
    kinds = np.full(256, SIGN, np.uint8)
    kinds[128:] = WIDE
    for kind, chars in ((SPACE, b" "), (BLANK, bytes(range(9, 14))), (LETTER, bytes([*range(65, 91), *range(97, 123)])), (DIGIT, bytes(range(48, 58))), (APOSTROPHE, b"'")):
        kinds[list(chars)] = kind
    return kinds


def sure_borders() -> tuple[np.ndarray, np.ndarray]:
    """For each two kinds of neighbouring bytes (8 * first + second): a border between them; a border before the first.

    A run of blanks begins a piece, and so does its last blank where more text follows; only a space goes on with it.
    After an apostrophe may come the rest of a contraction, and beside bytes beyond ASCII nothing is known.
    """
    between, before = np.zeros(64, bool), np.zeros(64, bool)
    for a in range(7):
        for b in range(7):
            if b <= BLANK:
                between[8 * a + b] = a > BLANK
            elif a <= BLANK:
                between[8 * a + b], before[8 * a + b] = a == BLANK, True
            elif a in (LETTER, DIGIT, SIGN) and b != WIDE:
                between[8 * a + b] = min(a, SIGN) != min(b, SIGN)
    return between, before


KIND = byte_kinds()
BETWEEN, BEFORE = sure_borders()


def byte_letters() -> dict[int, str]:
    """Byte to printable letter, as byte-level vocabularies write them: printable Latin-1 as is, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Kept:
    """A bounded table in two generations: when the new one is full it becomes the old one, whose hits are carried over."""

    def __init__(self, most: int):
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.most = most

    def find(self, keys: list[bytes]) -> list[bytes | None]:
        found = list(map(self.new.get, keys))
        if self.old and None in found:
            for i, x in enumerate(found):
                if x is None and (x := self.old.get(keys[i])) is not None:
                    found[i] = self.new[keys[i]] = x
        return found

    def add(self, keys: list[bytes], values: list[bytes]) -> None:
        if len(self.new) > self.most:
            self.new, self.old = {}, self.new
        self.new.update(zip(keys, values, strict=True))


def as_bytes(values: pa.LargeBinaryArray) -> list[bytes]:
    """The values of an array without nulls, faster than to_pylist()."""
    cuts = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1].tolist()
    raw = (values.buffers()[2] or b"") and values.buffers()[2].to_pybytes()
    return [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def gathered(values: list[bytes], which: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """values[w] for each w one after another as unsigned integers of ``width`` bytes, and the ends (from 0 on)."""
    flat = np.frombuffer(b"".join(values), f"<u{width}")
    sizes = np.fromiter(map(len, values), np.int64, len(values)) // width
    starts = np.cumsum(sizes) - sizes
    ends = np.zeros(len(which) + 1, np.int64)
    np.cumsum(sizes[which], out=ends[1:])
    at = np.repeat(starts[which] - ends[:-1], sizes[which])
    at += np.arange(len(at))
    return flat[at], ends


class Bpe:
    """``engine``: "tree" merges with the segment tree; "library" lets the tokenizers library encode the parts."""

    def __init__(self, path: str, engine: str = "tree"):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = {c: b for b, c in byte_letters().items()}
        vocab = spec["model"]["vocab"]
        self.bytes_of: dict[int, bytes] = {}
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(letters[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, i in self.special.items():
            self.bytes_of[i] = content.encode()
        self.by_byte = np.zeros(256, np.int64)
        for b, c in byte_letters().items():
            self.by_byte[b] = vocab[c]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.base = np.int64(max(vocab.values()) + 1)
        keys = np.array([vocab[a] * int(self.base) + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        # an open-addressed table: pair -> rank of the merge
        size = 1 << int(np.ceil(np.log2(max(2, 4 * len(keys)))))
        self.mask, self.slots, self.ranks = size - 1, np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        todo, at = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.slots[at] == -1
            first = np.unique(at[free], return_index=True)[1]
            won = np.flatnonzero(free)[first]
            self.slots[at[won]], self.ranks[at[won]] = keys[todo[won]], todo[won]
            rest = np.ones(len(todo), bool)
            rest[won] = False
            todo, at = todo[rest], (at[rest] + 1) & self.mask
        self.made = made
        self.split = regex.compile(PATTERN)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.engine = engine
        self.kept = Kept(KEPT)
        if engine == "library":
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(path)
            self.library.no_truncation()
            self.library.no_padding()

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * 0x9E3779B1) >> 7) & self.mask

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NO_PAIR where it never merges."""
        keys = left * self.base + right
        keys[(left < 0) | (right < 0)] = -2
        at = self._slot(keys)
        out = np.full(len(keys), NO_PAIR)
        todo = np.arange(len(keys))
        while len(todo):
            seen = self.slots[at[todo]]
            hit = seen == keys[todo]
            out[todo[hit]] = self.ranks[at[todo[hit]]]
            todo = todo[~hit & (seen != -1)]
            at[todo] = (at[todo] + 1) & self.mask
        return out

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        sizes = np.array([len(p) for p in pieces], np.int64)
        width = 2
        todo = np.arange(len(pieces))
        while len(todo):
            here = todo[sizes[todo] <= width]
            todo = todo[sizes[todo] > width]
            rows = max(1, 2_000_000 // width)
            for k in range(0, len(here), rows):
                group = here[k : k + rows]
                for i, ids in zip(group.tolist(), self._merge_group([pieces[i] for i in group.tolist()], width), strict=True):
                    out[i] = ids
            width *= 2
        return out

    def _merge_group(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Pieces of at most ``width`` bytes (a power of two), one row each.

        Row r's tree is tree[r]: leaves width..2*width-1 hold rank * width + place of the pair that starts at the
        place, inner nodes the minimum below; tree[r, 1] is the root: lowest rank, then leftmost.
        """
        n = len(pieces)
        flat = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        size = np.array([len(p) for p in pieces], np.int64)
        token = np.where(np.arange(width) < size[:, None], self.by_byte[flat], -1)
        after = np.tile(np.arange(1, width + 1), (n, 1))
        before = np.tile(np.arange(-1, width - 1), (n, 1))
        rank = np.full((n, width), NO_PAIR)
        rank[:, :-1] = self._rank(token[:, :-1].ravel(), token[:, 1:].ravel()).reshape(n, width - 1)
        tree = np.full((n, 2 * width), NO_PAIR)
        tree[:, width:] = np.where(rank < NO_PAIR, rank * width + np.arange(width), NO_PAIR)
        level = width
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        rows = np.flatnonzero(tree[:, 1] < NO_PAIR)
        while len(rows):
            root = tree[rows, 1]
            at, best = root % width, root // width
            right = after[rows, at]
            beyond = after[rows, right]
            token[rows, at] = self.made[best]
            token[rows, right] = -1
            after[rows, at] = beyond
            inside = beyond < width
            before[rows[inside], beyond[inside]] = at[inside]
            prior = before[rows, at]
            following = np.where(inside, token[rows, np.minimum(beyond, width - 1)], -1)
            leading = np.where(prior >= 0, token[rows, np.maximum(prior, 0)], -1)
            mine = token[rows, at]
            places = np.stack([at, right, np.where(prior >= 0, prior, at)])
            r_next = self._rank(mine, following)
            r_prev = self._rank(leading, mine)
            ranks = np.stack([r_next, np.full(len(rows), NO_PAIR), np.where(prior >= 0, r_prev, r_next)])
            values = np.where(ranks < NO_PAIR, ranks * width + places, NO_PAIR)
            three, node = np.broadcast_to(rows, places.shape), places + width
            tree[three, node] = values
            while node[0, 0] > 1:
                node = node >> 1
                tree[three, node] = np.minimum(tree[three, 2 * node], tree[three, 2 * node + 1])
            rows = rows[tree[rows, 1] < NO_PAIR]
        keep = token >= 0
        ids = token[keep].astype("<u4")
        ends = np.cumsum(keep.sum(axis=1)) * 4
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def _encoded(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces of the split pattern."""
        if self.engine == "tree" or not pieces:
            return self.merge(pieces)
        made = self.library.encode([p.decode("utf-8", "replace") for p in pieces], is_pretokenized=True, add_special_tokens=False)
        cuts = (np.searchsorted(np.array(made.word_ids, np.int64), np.arange(len(pieces) + 1)) * 4).tolist()
        raw = np.array(made.ids, "<u4").tobytes()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _stretches(self, stretches: list[bytes]) -> list[bytes]:
        """Ids of distinct stretches that begin and end at piece borders. A piece is a stretch of its own."""
        got = self.kept.find(stretches)
        missing = [i for i, x in enumerate(got) if x is None]
        if not missing:
            return got
        new = [stretches[i] for i in missing]
        split = {}
        for s in new:
            if not s.isascii() or b"'" in s:
                ps = self.split.findall(s.decode("utf-8", "replace"))
                if len(ps) > 1 or ps[0].encode() != s:
                    split[s] = [p.encode() for p in ps]
        pieces = list(dict.fromkeys([*(s for s in new if s not in split), *(p for ps in split.values() for p in ps)]))
        made = dict(zip(pieces, self._encoded(pieces), strict=True))
        values = [made[s] if s not in split else b"".join([made[p] for p in split[s]]) for s in new]
        for i, x in zip(missing, values, strict=True):
            got[i] = x
        self.kept.add(new, values)
        return got

    def _odd(self, text: str) -> np.ndarray:
        """Ids of a text that may hold special tokens or blanks beyond ASCII."""
        out = []
        for k, run in enumerate(self.cut.split(text) if self.cut else [text]):
            if k % 2:
                out.append(np.array([self.special[run]], "<u4").tobytes())
                continue
            pieces = [p.encode() for p in self.split.findall(run)]
            names = list(dict.fromkeys(pieces))
            known = dict(zip(names, self._stretches(names), strict=True))
            out += [known[p] for p in pieces]
        return np.frombuffer(b"".join(out), "<u4")

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of every whole text (null: empty), one after another, and the ends of the texts among them (from 0 on)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.match_substring_regex(texts, WIDE_BLANKS)
        for token in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, token))
        which = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        plain = pc.if_else(odd, "", texts) if len(which) else texts
        offsets = np.frombuffer(plain.buffers()[1], np.int64)[plain.offset : plain.offset + len(plain) + 1]
        raw = np.frombuffer(plain.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(offsets) else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)
        if not len(raw):
            ids, ends = np.zeros(0, "<u4"), np.zeros(len(texts) + 1, np.int64)
        else:
            kinds = KIND[raw]
            pair = kinds[:-1] * np.uint8(8) + kinds[1:]
            first = offsets[:-1][offsets[:-1] < len(raw)]
            pair[first[first > 0] - 1] = 63
            cut = np.zeros(len(raw), bool)
            cut[1:], cut[first] = BETWEEN[pair], True
            cut[:-1] |= BEFORE[pair]
            borders = np.append(np.flatnonzero(cut), len(raw))
            parts = pa.Array.from_buffers(pa.large_binary(), len(borders) - 1, [None, pa.py_buffer(borders), pa.py_buffer(raw)]).dictionary_encode()
            ids, at = gathered(self._stretches(as_bytes(parts.dictionary)), parts.indices.to_numpy(), 4)
            ends = at[np.searchsorted(borders, offsets)]
        if len(which):
            more = [self._odd(texts[int(i)].as_py()) for i in which]
            ids = np.concatenate([x for pair in zip(np.split(ids, ends[which]), [*more, more[0][:0]], strict=True) for x in pair])
            ends = ends.copy()
            ends[1:] += np.cumsum(np.bincount(which, [len(x) for x in more], len(texts)).astype(np.int64))
        return ids, ends

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of every whole text (null: empty) as little-endian unsigned 32-bit integers."""
        ids, ends = self.encode_array(pa.array(texts, pa.string()))
        raw, cuts = ids.tobytes(), (4 * ends).tolist()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def decode(self, ids: bytes) -> bytes:
        """The text of little-endian 32-bit ids, in UTF-8; byte sequences that are none become U+FFFD."""
        raw = b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        try:
            raw.decode()
            return raw
        except UnicodeDecodeError:
            return raw.decode("utf-8", "replace").encode()


@lru_cache(maxsize=4)
def coder(path: str, engine: str = "tree") -> Bpe:
    """One coder for each worker, file and engine."""
    return Bpe(path, engine)


def batches(texts: pa.Array, most: int = 4_000_000) -> list[tuple[int, int]]:
    """Ranges of rows that hold about ``most`` characters each, so that a batch of long texts stays small."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts, start = [], 0
    while start < len(sizes):
        base = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, base + most, "right")))
        cuts.append((start, end))
        start = end
    return cuts


def as_binary(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((4 * ends).astype(np.int32)), pa.py_buffer(ids)])


def ended(ids: np.ndarray, ends: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """``end_id`` after each text's ids."""
    return np.insert(ids, ends[1:], end_id), ends + np.arange(len(ends))


def encode(df: DataFrame, path: str, text_col: str = "text", out_col: str = "ids", engine: str = "tree") -> DataFrame:
    """``df`` with ``out_col``: ids of the whole text as little-endian unsigned 32-bit integers (binary).

    Null texts count as empty and give no ids. Every other column stays as it is; a column named ``out_col`` is
    replaced. Rows are neither joined nor shuffled, so repeated rows and repeated keys stay as they are.
    """
    schema = df.drop(out_col).schema.add(out_col, "binary")
    names = [f.name for f in schema if f.name != out_col]

    def run(chunks):
        bpe = coder(path, engine)
        for b in chunks:
            texts = b.column(b.schema.get_field_index(text_col))
            for lo, hi in batches(texts):
                ids, ends = bpe.encode_array(texts.slice(lo, hi - lo))
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(n)) for n in names), as_binary(ids, ends)], names=[*names, out_col])

    return df.drop(out_col).mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``df`` with ``out_col``: the text of the ids in ``ids_col`` (null: null)."""
    schema = df.drop(out_col).schema.add(out_col, "string")
    names = [f.name for f in schema if f.name != out_col]

    def run(chunks):
        bpe = coder(path)
        for b in chunks:
            texts = [None if x is None else bpe.decode(x).decode() for x in b.column(b.schema.get_field_index(ids_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(n)) for n in names), pa.array(texts, pa.string())], names=[*names, out_col])

    return df.drop(out_col).mapInArrow(run, schema)


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode, and return digests of both in one pass: the id column, n_tokens, ids_sha256, decoded_sha256.

    One row per input row, repeated or null ids included; null and empty texts have 0 tokens and the digests of
    nothing; very long texts are encoded whole, alone in their batch; an empty table gives no rows. Other columns of
    ``df`` don't matter.
    """
    kind = df.schema[id_col].dataType
    src = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))

    def run(chunks):
        bpe = coder(path)
        for b in chunks:
            for lo, hi in batches(b.column(1)):
                flat, ends = bpe.encode_array(b.column(1).slice(lo, hi - lo))
                ids = as_binary(flat, ends).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(lo, hi - lo),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                        pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids], pa.string()),
                    ],
                    names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    schema = src.select(F.col("_id").cast(kind).alias(id_col), F.lit(0).cast("long").alias("n_tokens"), F.lit("").alias("ids_sha256"), F.lit("").alias("decoded_sha256")).schema
    return src.mapInArrow(run, schema)
