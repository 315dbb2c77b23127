import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillmat.llm import queries, runs
from tests.llm.test_llm import TEXTS, none, odd  # noqa: F401
from tests.oracle import same


def words(text):
    return [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]


def brute(w, times=4, least=6):
    """Every stretch with every period; the first period that gives it is the smallest."""
    out = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                out.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in out.items())


def collapsed(w, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def cases(n=800):
    rng = random.Random(1)
    for _ in range(n):
        k, size = rng.choice([1, 2, 3, 5]), rng.randrange(60)
        w = [f"w{rng.randrange(k)}" for _ in range(size)]
        if w and rng.random() < 0.5:
            a = rng.randrange(size)
            p = 1 + (size - a) // rng.randrange(3, 11)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(size)]
        yield w


@pytest.mark.parametrize("times, least", [(4, 6), (2, 2), (3, 10)])
def test_runs_of_many_texts_at_once(times, least):
    every = list(cases())
    n, found, kept = runs.found(pa.array([" \t".join(w) for w in every]), times, least)
    for w, size, got, text in zip(every, n.to_pylist(), found.to_pylist(), kept.to_pylist(), strict=True):
        want = brute(w, times, least)
        assert size == len(w) and [(r["start"], r["length"], r["period"]) for r in got] == want
        assert text == collapsed(w, want)


def test_suffix_array():
    rng = np.random.default_rng(1)
    for k in (1, 2, 50):
        s = rng.integers(0, k, 200)
        array = runs.SuffixArray(s)
        want = sorted(range(200), key=lambda i: s[i:].tolist())
        assert array.sa.tolist() == want
        at, lcp = array.lcp()
        common = [next((j for j in range(200) if max(a, b) + j >= 200 or s[a + j] != s[b + j]), 200) for a, b in zip(want, want[1:], strict=False)]
        assert dict(zip(at.tolist(), lcp.tolist(), strict=True)) == {p + 1: h for p, h in enumerate(common) if h}


def test_smaller_children_are_few():
    """The suffixes that are looked at grow as n log n at most, in one long run as well."""
    for s in (np.zeros(20_000, np.int64), np.arange(20_000) % 7, np.random.default_rng(1).integers(0, 2, 20_000)):
        array = runs.SuffixArray(s)
        at, lcp = array.lcp()
        begins, ends = runs.splits(at, lcp)
        assert np.minimum(at - begins, ends - at).sum() <= 20_000 * 15
    assert np.stack(runs.runs_of(np.zeros(20_000, np.int64), 4, 6)).T.tolist() == [[0, 20_000, 1]]


def test_rows(odd, none):  # noqa: F811
    got = [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in runs.find_runs(odd).collect()]
    want = [(r["doc_id"], len(words(r["text"])), brute(words(r["text"])), collapsed(words(r["text"]), brute(words(r["text"])))) for r in odd.where("length(text) IS NULL OR length(text) < 100000").collect()]
    assert sorted((g for g in got if g[1] < 30_000), key=repr) == sorted(want, key=repr)
    assert [(g[2][0][1:], len(words(g[3]))) for g in got if g[1] == 30_000] == [((30_000, 700), 700)]
    assert runs.find_runs(none).count() == 0
    with pytest.raises(ValueError):
        runs.find_runs(none, times=1)


def digest(doc_id, text):
    w, h = words(text), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and w and doc_id is not None:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    found = brute(w)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None,) * 3
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(collapsed(w, found)))


def test_digests_by_brute_force(spark):
    rows = [(i, " ".join(w)) for i, w in enumerate(cases(400))] + [(1000, None), (1001, ""), (None, "a a a a a a"), (5, "b\nb b b b b b c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    planted = docs.withColumn("text", runs.repeated_tails(F.col("text"), F.crc32(F.col("doc_id").cast("string"))))
    got = [tuple(r) for r in runs.digests(runs.find_runs(planted)).collect()]
    assert sorted(got, key=repr) == sorted((digest(*r) for r in rows), key=repr)


def test_registered_query(spark, small):
    got = queries.op11_periodic_runs(spark, small)
    assert {r["doc_id"]: tuple(r) for r in got.collect()} == {r["doc_id"]: digest(r["doc_id"], r["text"]) for r in queries.table(spark, small, "documents").collect()}
    same(got, queries.ORACLES["op11_periodic_runs"], small)
