import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quillmat.llm import queries, scratch, token_counts
from tests.llm.test_llm import TEXTS, none, odd  # noqa: F401

PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
LETTERS = [*"ab1 \n\t'.,<>", "é", "　", "𝔸", "²", "́", "‍", "\x1c", "\x85", "</s>", "<s>", "<unk>", "▁", "  ", "\r\n", "<0x0A>", "\0", "<|endoftext|>"]


def library(path):
    if path.endswith(".model"):
        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda t: len(pieces.encode(t or ""))
    coder = Tokenizer.from_file(path)
    return lambda t: len(coder.encode(t or "", add_special_tokens=False).ids)


@pytest.mark.parametrize("path", [PIECES, BYTES])
@pytest.mark.parametrize("kept", [100, 500_000])
def test_counts_are_the_librarys(path, kept, monkeypatch):
    monkeypatch.setattr(token_counts, "KEPT", kept)
    rng = random.Random(3)
    texts = ["".join(rng.choice(LETTERS) for _ in range(rng.randrange(40))) for _ in range(3000)] + TEXTS
    texts += ["a" + chr(c) + "b " + chr(c) + " " + chr(c) + "1" for c in range(0x3000)]
    keys = np.frombuffer(b"".join(w.ljust(15, b"\0") + bytes([len(w)]) for w in (b" a", b" ab", b"\n", b"b")), "<u8").reshape(-1, 2)
    counter = token_counts.Counter(path, token_counts.table_of(keys, path))
    want = list(map(library(path), texts))
    for _ in range(2):  # from the library, then from the worker's table
        assert counter.count(pa.array(texts, pa.string())).tolist() == want


def test_borders_fall_where_no_piece_reaches():
    words = token_counts.vocabulary(PIECES)
    assert words.cuts
    for p in (words.library.id_to_piece(i) for i in range(3, words.library.get_piece_size()) if not words.library.is_byte(i)):
        raw = np.frombuffer(p.replace("▁", " ").encode(), np.uint8)
        assert not words.borders(raw, np.zeros(1, np.int64)).any()


def test_summaries_keep_what_is_frequent():
    rng, seen = np.random.default_rng(1), token_counts.Summary(50)
    every = rng.zipf(1.3, 20_000) % 5000
    for part in np.array_split(every, 17):
        seen.add(np.stack([part.astype(np.uint64), np.full(len(part), 2**56, np.uint64)], 1).view("V16").ravel(), np.ones(len(part), np.int64))
    held = set(np.frombuffer(seen.keys.tobytes(), np.uint64)[::2].tolist())
    values, counts = np.unique(every, return_counts=True)
    assert len(held) <= 50 and held >= set(values[counts > len(every) / 50].tolist())


def test_table_has_what_was_put_in():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(1, 1 << 60, (3000, 2)).astype(np.uint64), axis=0)
    table = token_counts.Table(keys[:2000], rng.integers(1, 16, 2000).astype(np.uint8))
    assert (table.find(keys[:2000]) > 0).all() and not table.find(keys[2000:]).any()
    assert not token_counts.Table(keys[:0], np.zeros(0, np.uint8)).find(keys[:5]).any()


@pytest.mark.parametrize("path", [PIECES, BYTES])
@pytest.mark.parametrize("most", [1, 40, token_counts.FREQUENT])
def test_rows(odd, none, path, most, monkeypatch):  # noqa: F811
    monkeypatch.setattr(token_counts, "MERGED", 2)
    size = library(path)
    got = token_counts.count_tokens(odd, path, limit=20, most=most).collect()
    want = [(r["doc_id"], len((r["text"] or "").encode()), size(r["text"]), size(r["text"]) > 20) for r in odd.collect()]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert token_counts.count_tokens(none, path).count() == 0


def test_summaries_take_every_text(spark):
    with scratch.noted():
        keys = token_counts.frequent(spark.createDataFrame([(f"w{i % 3} rare{i}",) for i in range(400)], "text string").repartition(7), PIECES, 12)
    held = {x.tobytes()[: x.tobytes()[15]] for x in keys}
    assert {b" w"} <= held and len(held) <= 12


def test_only_known_files():
    with pytest.raises(ValueError):
        token_counts.vocabulary("x.tiktoken")


def test_registered_query(spark, small):
    size = library(PIECES)
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op13_token_counts(spark, small).collect()}
    want = {r["doc_id"]: (len((r["text"] or "").encode()), size(r["text"]), size(r["text"]) > 4096) for r in queries.table(spark, small, "documents").collect()}
    assert got == want
