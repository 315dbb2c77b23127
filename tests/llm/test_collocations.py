import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quillmat.llm import collocations, queries
from tests.llm.test_llm import TEXTS, none, odd  # noqa: F401
from tests.oracle import same


def counted(texts, langs, most):
    out = Counter()
    for text, lang in zip(texts, langs, strict=True):
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            w = [x for x in re.split("[ \t]+", piece) if x]
            for k in range(1, most + 1):
                for i in range(len(w) - k + 1):
                    out["und" if lang is None else lang, tuple(w[i : i + k])] += 1
    return out


def brute(texts, langs, least_words=2, most=3, least=10, share=(50, 100), top=2000):
    f, rows = counted(texts, langs, most), {}
    total = Counter()
    for (lang, w), a in f.items():
        total[lang] += a * (len(w) == 1)
    held = [(lang, w, a) for (lang, w), a in f.items() if len(w) >= least_words and a >= least]
    inside = {}
    for lang, w, a in held:
        for k in range(least_words, len(w)):
            for i in range(len(w) - k + 1):
                key = lang, w[i : i + k]
                inside[key] = max(inside.get(key, 0), a)
    for lang, w, a in held:
        if share[1] * inside.get((lang, w), -1) >= share[0] * a:
            continue
        cuts = [(10**6 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w))]
        score, _, left, right = min(cuts)
        rows.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return {(lang, k, p.decode(), -a, x, y, total[lang], -s) for lang, found in rows.items() for k, (s, a, p, x, y) in enumerate(sorted(found)[:top], 1)}


def made(n, seed):
    rng = random.Random(seed)
    texts = [None if rng.random() < 0.05 else "".join(rng.choice(["a", "A", "b", "é", "cd", " ", " ", " ", "\t", ".", "\n", ";x"]) for _ in range(rng.randrange(60))) for _ in range(n)]
    return texts, [rng.choice(["en", "de", "", None]) for _ in range(n)]


@pytest.mark.parametrize("most", [1, 2, 3, 4, 5])
@pytest.mark.parametrize("words", [5, 1000])
def test_phrases_of_shards(most, words):
    for seed in range(20):
        texts, langs = made(8, seed)
        seq = collocations.sequence(pa.array(texts, pa.string()), pa.array(langs, pa.string()))
        got = Counter()
        for ids in collocations.cut(seq.ids, words):
            shard = collocations.Shard.of(1, ids, seq.names, seq.langs)
            _, names, lang_of = shard.opened()
            hashes, by, levels, counts = shard.phrases(most)
            assert len(hashes) == len(by) == len(counts) and (np.diff(hashes[by].astype(object)) > 0).all()
            for columns, n in levels:
                for row in zip(*(c.tolist() for c in columns), n.tolist(), strict=True):
                    got[shard.langs[lang_of[row[0] - 1]], tuple(names[x - 1].decode() for x in row[:-1])] += row[-1]
        assert got == counted(texts, langs, most)


def test_shards_end_between_pieces():
    rng = np.random.default_rng(1)
    ids = np.append(rng.integers(0, 4, 500), 0)
    for most in (1, 7, 100, 10_000):
        parts = collocations.cut(ids, most)
        assert np.concatenate(parts).tolist() == ids.tolist() and all(p[-1] == 0 for p in parts)
        assert all(len(p) <= most + 1 or not (p[:-1] == 0).any() for p in parts)


@pytest.mark.parametrize("words, bucket, texts_at_once", [(3, 1, 20), (50, 100, 1 << 24), (1 << 21, 1 << 20, 1 << 24)])
def test_collocations(spark, monkeypatch, words, bucket, texts_at_once):
    monkeypatch.setattr(collocations, "BUCKET", bucket)
    monkeypatch.setattr(collocations, "TEXTS", texts_at_once)
    texts, langs = made(150, 99)
    docs = spark.createDataFrame(list(zip(texts, langs, strict=True)), "text string, lang string").repartition(3)
    for options in ({"least": 4, "top": 25}, {"least": 2, "most": 4, "least_words": 3, "share": (80, 100)}, {"least": 3, "most": 2}):
        got = collocations.collocations(docs, words=words, **options).collect()
        assert len(got) == len(set(got)) and {tuple(r) for r in got} == brute(texts, langs, **options)


def test_large_counts_are_exact(spark, monkeypatch):
    """Scores of counts whose products pass 64 bits."""
    n = 3_000_000_017
    held = spark.createDataFrame([("en", 1, "a", n + 5), ("en", 1, "b", n + 9), ("en", 2, "a b", n)], "lang string, k int, phrase string, a long")
    monkeypatch.setattr(collocations, "phrases", lambda *a: (held, spark.createDataFrame([("en", 2 * n)], "lang string, n long")))
    assert [tuple(r) for r in collocations.collocations(held).collect()] == [("en", 1, "a b", n, n + 5, n + 9, 2 * n, 10**6 * n * n // ((n + 5) * (n + 9)))]


def test_rows(odd, none):  # noqa: F811
    rows = [(r["text"], r["ids"]) for r in odd.collect()]
    got = collocations.collocations(odd, lang_col="ids").collect()
    assert {tuple(r) for r in got} == brute(*zip(*rows, strict=True)) and got
    assert collocations.collocations(none, lang_col="ids").count() == 0
    with pytest.raises(ValueError):
        collocations.collocations(none, least=256, lang_col="ids")


def test_registered_query(spark, small):
    got = queries.op12_collocations(spark, small)
    docs = queries.table(spark, small, "documents").collect()
    assert {tuple(r) for r in got.collect()} == brute([r["text"] for r in docs], [r["lang"] for r in docs])
    same(got, queries.ORACLES["op12_collocations"], small)
