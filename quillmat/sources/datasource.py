"""Matrix Market files as a data source: ``spark.read.format("mtx").load(path)``, ``df.write.format("mtx")``.

Reading takes one pass. The driver reads the header alone, files are split by bytes, and each split parses its lines in
Arrow batches; an entry that can't be read or lies outside the matrix ends the job with its place. Writing takes one
pass too: each task writes its lines beside a count, and the commit puts the header, with the total, before the parts.
Nothing is visible before the commit, and an aborted job leaves nothing.

Paths are opened with pyarrow's file systems (local files, hdfs, s3, gs).
"""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: The words of a banner.
BANNER, FIELDS, SCHEMES = "%%MatrixMarket", ("real", "complex", "pattern", "integer"), ("general", "symmetric", "hermitian", "skew-symmetric")
#: Bytes of a split, of what it parses at once, and of a header at most.
SPLIT, STEP, HEAD = 1 << 26, 1 << 22, 1 << 20
#: A place among files: their number, then the byte in the file, below 2**40.
FILE_BITS = 40


def banner(line: str) -> tuple[str, str]:
    """field and scheme; case counts only in the first word. Dense arrays are refused."""
    words = line.split()
    if len(words) < 5 or words[0] != BANNER:
        raise ValueError("no Matrix Market banner")
    thing, form, kind, scheme = (w.lower() for w in words[1:5])
    if thing != "matrix" or form not in ("coordinate", "array") or kind not in FIELDS or scheme not in SCHEMES:
        raise ValueError(f"unsupported Matrix Market type: {line}")
    if form == "array" or kind == "real" and scheme == "hermitian" or kind == "pattern" and scheme in ("hermitian", "skew-symmetric"):
        raise ValueError(f"invalid Matrix Market type: {line}")
    return kind, scheme


@dataclass(frozen=True)
class Header:
    field: str
    scheme: str
    m: int
    n: int
    entries: int


def opened(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def reachable(path: str) -> bool:
    """Whether pyarrow has a file system for the path."""
    try:
        opened(path)
        return True
    except (pa.ArrowInvalid, OSError):
        return False


def files_of(path: str) -> list[tuple[str, int]]:
    """Paths and sizes of a file, or of a folder's files in the order of their names."""
    store, where = opened(path)
    info = store.get_file_info(where)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [(info.path, info.size)]
    found = store.get_file_info(fs.FileSelector(where))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._")


def header_of(path: str) -> tuple[Header, int, int]:
    """The header, the number of the file in which it ends, and the byte after it."""
    store, first, at = opened(path)[0], None, 0
    for number, (file, _) in enumerate(files_of(path)):
        with store.open_input_stream(file) as f:
            raw = f.read(HEAD)
        at = 0
        while at < len(raw):
            end = raw.find(b"\n", at)
            end = len(raw) if end < 0 else end
            line, at = raw[at:end].decode("utf-8", "replace"), end + 1
            if first is None:
                first = banner(line)
            elif line.strip() and not line.startswith("%"):
                words = line.split()
                if len(words) < 3 or not all(w.isdigit() for w in words[:3]):
                    raise ValueError("no size line")
                return Header(*first, *map(int, words[:3])), number, at
        if first is None and raw:
            raise ValueError("no Matrix Market banner")
    raise ValueError("no size line" if first else "no Matrix Market banner")


@dataclass
class Split(InputPartition):
    number: int
    file: str
    start: int
    end: int
    #: Where the file's entries begin.
    origin: int


def parsed(raw: bytes, width: int, place: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """i, k (from 1), v and places of the entries in whole lines; ``width``: numbers that a line has at least."""
    data = np.frombuffer(raw, np.uint8)
    ends = np.flatnonzero(data == 10)
    if not len(ends) or ends[-1] != len(raw) - 1:
        ends = np.append(ends, len(raw))
    starts = np.append(0, ends[:-1] + 1)
    if b"%" not in raw and raw.isascii() and (words_in(data, starts) == width).all():
        with warnings.catch_warnings():
            warnings.simplefilter("ignore", DeprecationWarning)  # numpy's word for a number that it can't read
            values = np.fromstring(raw.decode(), sep=" ")
        if len(values) == width * len(starts):
            table = values.reshape(len(starts), width)
            spots = table[:, :2]
            if (spots == np.floor(spots)).all() and (np.abs(spots) < 2**53).all():
                return spots[:, 0].astype(np.int64), spots[:, 1].astype(np.int64), table[:, 2] if width > 2 else np.ones(len(table)), place + starts
    rows = []
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        line = raw[a:b]
        if line.startswith(b"%") or not line.strip():
            continue
        words = line.split()
        try:
            rows.append((int(words[0]), int(words[1]), float(words[2]) if width > 2 else 1.0, place + a))
        except (ValueError, IndexError):
            raise ValueError(f"unreadable entry at byte {(place + a) & ((1 << FILE_BITS) - 1)}: {line[:80]!r}") from None
    cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
    return tuple(np.array(c, t) for c, t in zip(cols, (np.int64, np.int64, np.float64, np.int64), strict=True))


def words_in(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many words each line has."""
    word = data > 32
    word[1:] &= data[:-1] <= 32  # where one begins
    return np.add.reduceat(word.astype(np.int64), starts)


def lines_of(f, start: int, end: int, origin: int) -> Iterator[tuple[int, bytes]]:
    """Stretches of whole lines, with their places: the lines that begin in a split."""
    at = start
    if start > origin:  # the line that reaches in belongs to the split before
        f.seek(start - 1)
        at -= 1
        while True:
            more = f.read(STEP)
            cut = more.find(b"\n")
            at += cut + 1 if cut >= 0 else len(more)
            if cut >= 0:
                break
            if not more or at >= end:
                return
    f.seek(at)
    held = b""
    while at < end:
        more = f.read(STEP)
        held += more
        if at + len(held) >= end:
            cut = held.find(b"\n", max(0, end - 1 - at))
            if cut >= 0:
                yield at, held[: cut + 1]
                return
        if not more:
            if held:
                yield at, held
            return
        cut = held.rfind(b"\n", 0, max(0, end - 1 - at)) + 1
        if cut:
            yield at, held[:cut]
        at, held = at + cut, held[cut:]


class MtxReader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split
        self.header, self.first, self.origin = header_of(path)

    def partitions(self) -> list[Split]:
        out = []
        for number, (file, size) in enumerate(files_of(self.path)):
            begin = 0 if number > self.first else self.origin if number == self.first else size
            out += [Split(number, file, at, min(at + self.split, size), begin) for at in range(begin, size, self.split)]
        return out or [Split(0, "", 0, 0, 0)]

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        """The entries of the lines that begin in the split."""
        if split.start == split.end:
            return
        head, store = self.header, opened(self.path)[0]
        width = {"pattern": 2, "complex": 4}.get(head.field, 3)
        with store.open_input_file(split.file) as f:
            for at, raw in lines_of(f, split.start, split.end, split.origin):
                i, k, v, place = parsed(raw, width, (split.number << FILE_BITS) + at)
                bad = np.flatnonzero((i < 1) | (i > head.m) | (k < 1) | (k > head.n))
                if len(bad):
                    raise ValueError(f"entry outside {head.m} x {head.n} at byte {int(place[bad[0]]) & ((1 << FILE_BITS) - 1)}: {i[bad[0]]} {k[bad[0]]}")
                yield pa.RecordBatch.from_arrays([pa.array(i - 1), pa.array(k - 1), pa.array(v), pa.array(place)], names=["i", "k", "v", "entry_id"])


@dataclass
class Part(WriterCommitMessage):
    number: int
    file: str
    entries: int


class MtxWriter(DataSourceArrowWriter):
    """Lines of i, k, v (from 0) under options m and n; ``pattern`` leaves values out."""

    def __init__(self, path: str, m: int, n: int, pattern: bool, overwrite: bool):
        self.path, self.m, self.n, self.pattern, self.overwrite = path, m, n, pattern, overwrite
        self.run = uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Part:
        store, where = opened(self.path)
        number = TaskContext.get().partitionId()
        file, count = f"{where}/_{self.run}/{number:06d}-{uuid.uuid4().hex}", 0
        store.create_dir(f"{where}/_{self.run}", recursive=True)
        with store.open_output_stream(file) as out:
            for b in batches:
                i, k = b.column(0).to_numpy() + 1, b.column(1).to_numpy() + 1
                count += len(i)
                if self.pattern:
                    lines = map("%d %d\n".__mod__, zip(i.tolist(), k.tolist(), strict=True))
                else:
                    lines = map("%d %d %.16g\n".__mod__, zip(i.tolist(), k.tolist(), b.column(2).to_pylist(), strict=True))
                out.write("".join(lines).encode())
        return Part(number, file, count)

    def commit(self, messages: list[Part | None]) -> None:
        store, where = opened(self.path)
        parts = sorted((m for m in messages if m), key=lambda m: m.number)
        if self.overwrite:
            for f in store.get_file_info(fs.FileSelector(where, allow_not_found=True)):
                if f.type == fs.FileType.File:
                    store.delete_file(f.path)
        elif store.get_file_info(f"{where}/part-000000").type != fs.FileType.NotFound:
            self.abort(messages)
            raise FileExistsError(self.path)
        store.create_dir(where, recursive=True)
        full = [p for p in parts if p.entries]
        for at, p in enumerate(full, 1):
            store.move(p.file, f"{where}/part-{at:06d}")
        with store.open_output_stream(f"{where}/part-000000") as out:
            out.write(f"{BANNER} matrix coordinate {'pattern' if self.pattern else 'real'} general\n{self.m} {self.n} {sum(p.entries for p in parts)}\n".encode())
        self.abort(messages)  # what failed or repeated tasks left
        store.open_output_stream(f"{where}/_SUCCESS").close()

    def abort(self, messages: list[Part | None]) -> None:
        store, where = opened(self.path)
        if store.get_file_info(f"{where}/_{self.run}").type != fs.FileType.NotFound:
            store.delete_dir(f"{where}/_{self.run}")


class MtxSource(DataSource):
    """Options: path; to read, ``split`` bytes; to write, ``m``, ``n`` and ``pattern``."""

    @classmethod
    def name(cls) -> str:
        return "mtx"

    def schema(self) -> str:
        return "i long, k long, v double, entry_id long"

    def reader(self, schema: StructType) -> MtxReader:
        return MtxReader(self.options["path"], int(self.options.get("split", SPLIT)))

    def writer(self, schema: StructType, overwrite: bool) -> MtxWriter:
        if schema.names[:3] != ["i", "k", "v"]:
            raise ValueError("columns i, k, v are needed")
        return MtxWriter(self.options["path"], int(self.options["m"]), int(self.options["n"]), self.options.get("pattern", "false").lower() == "true", overwrite)


def register(spark: SparkSession) -> None:
    """Make ``format("mtx")`` known to a session."""
    spark.dataSource.register(MtxSource)
