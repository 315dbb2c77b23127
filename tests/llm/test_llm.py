import collections
import datetime
import hashlib
import random
import re
import tempfile
import time
import unicodedata
import zlib
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quillmat.llm import bitmap, bpe, components, exact_dedup, line_dedup, ngram_join, packing, pii, queries, scratch, token_files, toxicity, url_filter, vptree
from tests.oracle import same

PATH = queries.tokenizer()
BLANKS = " \t\n\x0b\x0c\r"
#: Nulls, empty and blank texts, ties, repeated rows, odd characters; the last two are long.
TEXTS = [None, "", " \n\t", "a", "A b", "a  b\n", "a b c d e f g h", "a b c d e f g h", "A B C D E F G H", "\u00e9t\u00e9 \u3000 x\x85y <|endoftext|> 12\u00b2", "line\nLINE \n\nother\r\nline", "same line\nsame line", "x" * 3000 + " y", " ".join(f"w{i % 700}" for i in range(30000))]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "clash", 7) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], None, None), (None, "null id", "x", 1), (None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int").repartition(3)


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def packed(ids):
    return np.array(ids, "<u4").tobytes()


# BPE


@pytest.mark.parametrize("engine", ["tree", "library"])
def test_encoding_is_the_librarys(engine, library):
    rng = random.Random(1)
    letters = [*"ab1 \n\t'.,", "\u00e9", "\u3000", "\U0001d538", "\u00b2", "\u0663", "\u0301", "\u200d", "\x1c", "\x85", "<|endoftext|>", "  ", "'re"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(3000)]
    texts += ["a" + chr(c) + "b " + chr(c) + " " + chr(c) + "1" for c in range(0x3000) if unicodedata.category(chr(c)) != "Cs"] + [t or "" for t in TEXTS]
    coder = bpe.Bpe(PATH, engine)
    assert coder.encode_batch(texts) == [packed(library(t)) for t in texts]
    assert coder.encode_batch(texts) == [packed(library(t)) for t in texts]  # from the tables


def test_generations_keep_results(library, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 50)
    coder, rng = bpe.Bpe(PATH), random.Random(2)
    for _ in range(30):
        texts = [" ".join(f"w{rng.randrange(300)}" for _ in range(40)) for _ in range(5)]
        assert coder.encode_batch(texts) == [packed(library(t)) for t in texts]


def test_decoding(library):
    coder = bpe.coder(PATH)
    for t in TEXTS:
        assert coder.decode(packed(library(t))).decode() == (t or "")
    assert coder.decode(packed([coder.by_byte[0xC3]])).decode() == "\ufffd"


def test_round_trip(spark, odd, none, library):
    got = sorted(map(tuple, bpe.round_trip(odd, PATH).collect()), key=repr)
    want = [(r["doc_id"], len(library(r["text"])), hashlib.sha256(packed(library(r["text"]))).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in odd.collect()]
    assert got == sorted(want, key=repr)
    assert bpe.round_trip(none, PATH).count() == 0
    both = bpe.decode(bpe.encode(odd, PATH), PATH)  # the column ids is replaced
    assert {(r["text"] or "", r["decoded"]) for r in both.collect()} == {(t or "", t or "") for t in [*TEXTS, "null id"]}


# exact dedup


def brute_dedup(rows):
    groups = collections.defaultdict(list)
    for r in rows:
        t = r["text"] or ""
        groups[t.translate({ord(c): None for c in BLANKS})].append((-len(t), r["doc_id"] is None, r["doc_id"] or 0, r["doc_id"]))
    return {k: (min(v)[3], len(v)) for k, v in groups.items()}


@pytest.mark.parametrize("block", [8, 8192])
def test_exact_dedup(odd, none, block):
    want = brute_dedup(odd.collect())
    got = exact_dedup.dedup(odd, block=block).join(odd.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("m"), "text").distinct().withColumnRenamed("doc_id", "d"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("m") == F.col("text_md5"))).collect()
    assert len(got) >= odd.count()
    for r in got:
        norm = (r["text"] or "").translate({ord(c): None for c in BLANKS})
        assert (r["keep_id"], r["group_size"]) == want[norm] and r["text_sha256"] == hashlib.sha256(norm.encode()).hexdigest()
    assert exact_dedup.dedup(odd, block=block).where("kept").count() == len(want)
    assert exact_dedup.dedup(none, block=block).count() == 0


def test_exact_dedup_names_differ_at_one_byte(spark):
    texts = ["ab" * 50, "ab" * 49 + "aB", "ab" * 50 + "a", "ab" * 25, "ab" * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.dedup(df, block=7).collect()}
    assert got == {0: (0, 2), 1: (1, 1), 2: (2, 1), 3: (3, 1), 4: (0, 2)}


# nearest neighbours


def brute_nearest(x, ids, k):
    out = {}
    for i in range(len(ids)):
        if ids[i] % 20 == 0:
            s = [(-(x[i] * x[j]).sum(), ids[j]) for j in range(len(ids)) if ids[j] != ids[i]]
            out[ids[i]] = [j for _, j in sorted(s)[:k]]
    return out


def test_exact_search_with_ties(spark, monkeypatch):
    monkeypatch.setattr(vptree, "SHARD", 150)
    monkeypatch.setattr(vptree, "LEAF", 16)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 6)).round(1)
    x[100:180] = x[100]  # a common vector
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(400, None, 0), (440, [0.0] * 6, 0), (460, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (480, [float("nan")] * 6, 0), (500, [float("inf")] * 6, 0), (None, [1.0] * 6, 0), (520, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = collections.defaultdict(list)
    for r in vptree.nearest(df, df.where("vec_id % 20 = 0"), k=20).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    assert dict(got) == brute_nearest(x.astype(np.float32).astype(float), list(range(400)), 20)
    assert vptree.nearest(df.limit(0), df.limit(0)).count() == 0


def test_relaxed_search_visits_less_and_finds_most():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 3))
    x /= np.linalg.norm(x, axis=1)[:, None]
    order, ends, nodes = vptree.build(x, 1.0)
    ids, q = order.astype(np.int64), x[:100]
    exact = vptree.search(x[order], ids, ends, nodes, 1.0, q, np.full(100, -1), 20, 1.0)
    loose = vptree.search(x[order], ids, ends, nodes, 1.0, q, np.full(100, -1), 20, 2.0)
    want = np.argsort(-(q @ x.T), axis=1)[:, :20]
    recall = lambda r: np.mean([len(set(a) & set(b)) / 20 for a, b in zip(r[1].tolist(), want.tolist(), strict=True)])
    assert recall(exact) == 1 and recall(loose) >= 0.9
    assert loose[2] < exact[2] < 100 * len(ends) / 2


# URL filters


def brute_url(url, rules, otherwise="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    path = rest[len(host) :].split("?")[0].split("#")[0]
    host = "".join(c.lower() if c in ascii_uppercase else c for c in host)
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.key), len(r.host), r.action == "block"), default=None)
    return host, path, best.key if best else None, best.action if best else otherwise


def test_url_rules(spark):
    rng = random.Random(4)
    hosts = ["example.org", "a.example.org", "EXAMPLE.com", "x.com", "org", "com", "xorg", "b.net", "example.org:80", ".org", "a..com", ""]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12?x=/de/", "/fr/#top", "/de/x", "?q=/fr/", "#/de/"]
    urls = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "", "no scheme", "://", "x://y://z/fr/", "http://org/\u00e9"]
    urls += [rng.choice(urls) for _ in range(50)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(df, url_filter.rules_table(spark, queries.RULES)).collect()}
    assert got == {i: brute_url(u, queries.RULES) for i, u in enumerate(urls)}
    assert url_filter.judge(df.limit(0), url_filter.rules_table(spark, queries.RULES)).count() == 0
    assert {r["verdict"] for r in url_filter.judge(df, url_filter.rules_table(spark, []), otherwise="block").collect()} == {"block"}


@pytest.mark.parametrize("most", [0, 24])
def test_url_rules_of_many_shapes(spark, monkeypatch, most):
    monkeypatch.setattr(url_filter, "MOST_SHAPES", most)
    rng = random.Random(11)
    rules = [url_filter.Rule(rng.choice(["allow", "block"]), ".".join(["a"] * n), "/" + "p" * m) for n in (1, 2, 3) for m in range(0, 60 if not most else 3, 2)]
    rules = list({r.key: r for r in rules}.values())
    urls = [f"http://{'.'.join(['a'] * rng.randint(1, 5))}/{'p' * rng.randint(0, 70)}{rng.choice(['', 'q', '?p', '#'])}" for _ in range(120)] + [None, "", "x://b/", "http://a.a/" + "p" * 100_000]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(df, url_filter.rules_table(spark, rules)).collect()}
    assert got == {i: brute_url(u, rules) for i, u in enumerate(urls)}


def test_rule_hosts_beyond_ascii(spark):
    """Only A-Z are lower-cased, in rules as in urls."""
    pages = spark.createDataFrame([(1, "http://\u00c4.EXAMPLE.org/x"), (2, "http://\u00e4.example.org/x")], "page_id long, url string")
    got = url_filter.judge(pages, url_filter.rules_table(spark, [url_filter.Rule("block", "\u00c4.Example.org", "/")]))
    assert {r["page_id"]: r["verdict"] for r in got.collect()} == {1: "block", 2: "allow"}


def test_bitmaps_grow_with_their_keys(spark):
    assert bitmap.sized(0) == bitmap.sized(1000) == bitmap.BITS and bitmap.sized(1 << 40) == bitmap.MOST_BITS
    assert 16 * 10**7 <= bitmap.sized(10**7) <= 32 * 10**7
    rows, wanted = spark.range(3000).select(F.xxhash64("id").alias("h")), spark.range(0, 3000, 7).select(F.xxhash64("id").alias("_hash"))
    for bits in (bitmap.BITS, bitmap.sized(2 * 10**6)):
        got = {r["h"] for r in bitmap.thinned(rows, F.col("h"), wanted, bits).collect()}
        assert got >= {r["_hash"] for r in wanted.collect()} and len(got) < 500


def test_url_list_by_join(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "MOST_BITS", 1)
    df = spark.createDataFrame([(1, "http://a.example.org/es/x"), (2, "http://q.net/"), (3, None)], "page_id long, url string")
    got = {r["page_id"]: r["rule"] for r in url_filter.judge(df, url_filter.rules_table(spark, queries.RULES)).collect()}
    assert got == {1: "example.org/es/", 2: None, 3: None}


def test_cascade_is_exact(spark):
    universe = spark.range(3000).select(F.col("id").cast("string").alias("key"))
    listed = universe.where("cast(key as int) % 7 = 0")
    levels = url_filter.cascade(listed, universe)
    assert len(levels) > 1
    assert universe.where(url_filter.member(levels, F.col("key")) != (F.col("key").cast("int") % 7 == 0)).count() == 0


# n-gram join


def brute_link(rows, n, num, den):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    held = collections.defaultdict(list)
    for i, s in sets.items():
        for j, shared in collections.Counter(j for g in s for j in held[g]).items():
            if den * shared >= num * (len(s) + len(sets[j]) - shared):
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
        for g in s:
            held[g].append(i)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def near_copies():
    rng, rows = random.Random(5), []
    for g in range(6):
        base = [f"g{g}w{rng.randrange(400)}" for _ in range(rng.choice([8, 60, 150]))]
        for _ in range(40):
            w = list(base)
            for _ in range(rng.randrange(7)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            rows.append(" ".join(w))
    passage = " ".join(f"p{i}" for i in range(30))
    rows += [passage + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(200)) for _ in range(60)] + rows[:20]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("n,num", [(3, 90), (5, 80), (2, 50)])
@pytest.mark.parametrize("meet", [8, 1024])
def test_ngram_join(spark, monkeypatch, n, num, meet):
    monkeypatch.setattr(ngram_join, "MEET", meet)
    rows = near_copies()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = ngram_join.link(df, n, num, 100).collect()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out}
    assert got == brute_link(rows, n, num, 100)
    assert {r["doc_id"] for r in out if r["kept"]} == {c for _, c in got.values()}


def indexed(df, n, num):
    """The index entries of ``df``."""
    made, keep = [], ngram_join.entries
    try:
        ngram_join.entries = lambda *a: made.append(keep(*a)) or made[-1]
        out = ngram_join.link(df, n, num, 100).collect()
    finally:
        ngram_join.entries = keep
    return made[0], out


def test_ngram_index_of_long_near_copies(spark):
    """Entries stay in proportion to the text, however long it is."""
    base = [f"w{i}" for i in range(20_000)]
    other = [w if i % 2000 else f"x{i}" for i, w in enumerate(base)]
    texts = [" ".join(base), " ".join(other), " ".join(base[::-1]), " ".join(base[:12_000] + other[1::2])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    entries, out = indexed(df, 3, 90)
    r = entries.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("sign") + 40).alias("bytes")).first()
    assert 0 < r["bytes"] < 4 * sum(map(len, texts)) and r["bytes"] <= r["n"] * (40 + ngram_join.SIGN_BYTES)
    assert {r["doc_id"]: r["component_id"] for r in out} == {i: c for i, (_, c) in brute_link(list(enumerate(texts)), 3, 90, 100).items()} == {0: 0, 1: 0, 2: 2, 3: 3}


def test_ngram_index_ignores_copies(spark):
    """10,000 copies of one text index no more than one of them does."""
    text = " ".join(f"c{i}" for i in range(60))
    near = " ".join(f"c{i}" for i in range(59)) + " d"
    few = [(0, text), (1, near), (2, "a b c d e")]
    entries, _ = indexed(spark.createDataFrame(few, "doc_id long, text string"), 3, 90)
    want = {r["token"]: r["count"] for r in entries.groupBy("token").count().collect()}
    many = spark.createDataFrame(few, "doc_id long, text string").unionByName(spark.range(10, 10_010).select(F.col("id").alias("doc_id"), F.lit(text).alias("text")))
    entries, out = indexed(many, 3, 90)
    assert {r["token"]: r["count"] for r in entries.groupBy("token").count().collect()} == want
    assert {r["component_id"] for r in out if r["doc_id"] != 2} == {0} and sum(r["kept"] for r in out) == 2


def test_ngram_join_odd_rows(odd, none):
    got = collections.defaultdict(set)
    for r in ngram_join.link(odd, 3, 90, 100).collect():
        got[r["doc_id"]].add((r["n_shingles"], r["component_id"]))
    assert got[0] == {(0, 0)} and got[1] == {(0, 1)} and got[2] == {(0, 2)}
    assert got[3] == {(1, 3)} and got[4] == {(1, 4)} and got[5] == {(1, 4)}
    assert {*got[6], *got[7], *got[8]} == {(6, 6)}
    assert got[None] == {(1, None), (0, None)}
    assert ngram_join.link(none).count() == 0


def test_prefix_choice():
    bounds = ngram_join.Bounds(90, 100)
    token, frequency = np.arange(30, dtype=np.uint64), np.full(30, 5)
    places, matches = ngram_join.choose(frequency, token, 150, bounds)
    assert 1 <= matches <= ngram_join.MOST_MATCHES
    assert len(places) == len(token) - bounds.sure(150) + matches
    assert ngram_join.choose(np.ones(30, np.int64), token, 150, bounds)[1] == 1


def test_parity_distance_is_a_lower_bound():
    rng = np.random.default_rng(3)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 2**64, rng.integers(1, 300), dtype=np.uint64)) for _ in "ab")
        b = np.unique(np.concatenate([b, a[: len(a) // 2]]))
        x, y = (np.frombuffer(ngram_join.parity(s), np.uint8) for s in (a, b))
        least = min(len(x), len(y))
        x, y = (z if len(z) == least else ngram_join.fold(z, least) for z in (x, y))
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_components(spark):
    rng = random.Random(6)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 420)] + [(500, 500)]
    top = {x: x for p in links for x in p}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        top[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["node"]: r["label"] for r in components.labels(spark.createDataFrame(links, "a long, b long")).collect()}
    linked = {x for a, b in links for x in (a, b) if a != b}
    assert got == {x: find(x) for x in linked}
    assert components.labels(spark.createDataFrame([], "a long, b long")).count() == 0


# token files


@pytest.mark.parametrize("segment", [5, 1 << 18])
def test_token_files(spark, odd, none, library, segment):
    with tempfile.TemporaryDirectory() as d:
        token_files.write(odd, f"{d}/t", PATH, segment_tokens=segment)
        got = token_files.read(spark, f"{d}/t").orderBy("start").collect()
        want = {(r["doc_id"], packed([*library(r["text"]), 0])) for r in odd.collect()}
        assert {(r["doc_id"], bytes(r["ids"])) for r in got} == want and len(got) == odd.count()
        keys = [(-1 if r["doc_id"] is None else r["doc_id"]) for r in got]
        assert keys == sorted(keys)
        assert [r["start"] for r in got] == np.cumsum([0] + [r["n_tokens"] for r in got])[:-1].tolist()
        assert {r["ids_crc32"] for r in token_files.digests(token_files.read(spark, f"{d}/t")).collect()} == {zlib.crc32(i) for _, i in want}
        token_files.write(none, f"{d}/n", PATH)
        assert token_files.read(spark, f"{d}/n").count() == 0


@pytest.mark.parametrize("few", [0, 1000])
def test_tokens_at_random_positions(spark, odd, none, library, monkeypatch, few):
    monkeypatch.setattr(token_files, "FEW", few)
    monkeypatch.setattr(token_files, "SPAN_BITS", 10)
    monkeypatch.setattr(token_files.Codes, "run", None)  # no token but those asked for is decoded
    with tempfile.TemporaryDirectory() as d:
        docs = odd.where("doc_id <> 3 AND doc_id IS NOT NULL")
        token_files.write(docs, f"{d}/t", PATH, segment_tokens=700)
        ids = [x for r in docs.orderBy("doc_id").collect() for x in [*library(r["text"]), 0]]
        rng = random.Random(5)
        asked = [rng.randrange(len(ids)) for _ in range(300)] + [0, 0, len(ids) - 1, len(ids), -1, None]
        got = token_files.token_at(spark, f"{d}/t", spark.createDataFrame([(p,) for p in asked], "position long")).collect()
        assert {r["position"]: r["token_id"] for r in got} == {p: ids[p] if p is not None and 0 <= p < len(ids) else None for p in asked}
        assert len(got) == len(set(asked))
        token_files.write(none, f"{d}/n", PATH)
        assert [tuple(r) for r in token_files.token_at(spark, f"{d}/n", spark.range(1).toDF("position")).collect()] == [(0, None)]


def test_codes_are_addressable():
    rng = np.random.default_rng(2)
    for top in (200, 60000, 2**24, 2**32):
        ids = rng.integers(0, top, 5000, dtype=np.uint64).astype(np.uint32)
        codes = token_files.Codes.from_bytes(token_files.Codes.build(ids).to_bytes())
        at = rng.integers(0, 5000, 700)
        assert (codes.at(at) == ids[at]).all()
        for lo, hi in ((0, 5000), (0, 0), (511, 513), (4999, 5000), (100, 3000)):
            assert (codes.run(lo, hi) == ids[lo:hi]).all()
    assert len(token_files.Codes.from_bytes(token_files.Codes.build(np.zeros(0, np.uint32)).to_bytes())) == 0


# line dedup


def brute_lines(rows, least, chars=1):
    key = lambda s: "".join(c.lower() if c in ascii_uppercase else c for c in s.strip(BLANKS))
    seen = collections.Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")})
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < chars or seen[key(x)] < least]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot", [0, 2, 100])
@pytest.mark.parametrize("least,chars", [(2, 1), (3, 5), (1, 1)])
def test_line_dedup(odd, none, monkeypatch, least, chars, hot):
    monkeypatch.setattr(line_dedup, "HOT_KEYS", hot)
    got = sorted((tuple(r) for r in line_dedup.dedup_lines(odd, least, chars).collect()), key=repr)
    assert got == brute_lines([(r["doc_id"], r["text"]) for r in odd.collect()], least, chars)
    assert line_dedup.dedup_lines(none).count() == 0


# pseudonyms


def test_feistel_permutes_without_fixed_points():
    for n in (1, 2, 3, 10, 97, 1000):
        f = pii.Feistel(b"k", "x", n)
        there = [f.apply(i) for i in range(n)]
        assert sorted(there) == list(range(n)) and all(f.apply(y, True) == i for i, y in enumerate(there))
        assert n == 1 or all(i != y for i, y in enumerate(there))


def test_pseudonyms():
    text = 'mail eau.42@mail9.example.com, +1 (599) 555-3756 x 78.24.37.177 4111 1111 1111 1111 4111-1111-1111-1111$$$ 2021-02-28 31/12/1999 GB82 WEST 1234 5698 7654 32 123-45-6789 555-123-4567 token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" THE!! 1.1.1.1!!'
    stay = "4111111111111112 2021-02-29 1.2.3.400 666-12-1234 01.02.2500 1234567 v1.2.3"
    counts = collections.Counter()
    new = pii.Pseudonyms(b"k").text(f"{text} | {stay}", counts)
    head, _, tail = new.partition(" | ")
    assert tail == stay and counts.total() == 12
    assert [c if not c.isalnum() else 0 for c in head if c not in ascii_lowercase + ascii_uppercase] and len(head.split()) == len(text.split())
    for old in ("eau.42", "599", "78.24.37.177", "4111", "2021-02-28", "31/12/1999", "1234 5698", "123-45-6789", "04dbebab"):
        assert old not in head
    cards = [x for x in pii.PATTERN.finditer(head) if x.lastgroup == "card"]
    assert len(cards) == 2 and all(pii.luhn("".join(c for c in m.group() if c.isdigit())) == 0 for m in cards)
    assert len({"".join(c for c in m.group() if c.isdigit()) for m in cards}) == 1  # equal numbers stay linked
    assert pii.Pseudonyms(b"k", undo=True).text(new, collections.Counter()) == f"{text} | {stay}"
    assert pii.Pseudonyms(b"other").text(text, collections.Counter()) != head


NEIGHBOURS = {
    "at 4111 1111 1111 1111 12 times": "4111 1111 1111 1111",
    "12 4111 1111 1111 1111": "4111 1111 1111 1111",
    "9999 4111-1111-1111-1111 x": "4111-1111-1111-1111",
    "to 3782 822463 10005 77 units": "3782 822463 10005",
    "ES91 2100 0418 4502 0005 1332 EUR": "ES91 2100 0418 4502 0005 1332",
    "GB82 WEST 1234 5698 7654 32 ABCD": "GB82 WEST 1234 5698 7654 32",
    "on 2020-05-06T10:00:00Z": "2020-05-06",
    "born 12/25/1990.": "12/25/1990",
    "call +44 20 7946 0958 now": "+44 20 7946 0958",
    "call +4915112345678": "+4915112345678",
    "555 123 4567": "555 123 4567",
    "x\n555 123 4567 y": "555 123 4567",
    "ring 020 7946 0958, please": "020 7946 0958",
    "no 123 45 6789.": "123 45 6789",
    "since 2020/05/06 only": "2020/05/06",
    "(05-06-1990)": "05-06-1990",
    "token=04dbebab91ab85687d33eeaaf9ac6991 set": "04dbebab91ab85687d33eeaaf9ac6991",
    "to ann.e@exämple.com": "ann.e",
}
DATES = ["3 May 1990", "03 May 1990", "31 December 1999", "May 3, 1990", "May 03 1990", "12 Jan 2001", "1 Jun 2024", "09 Sep 1950", "Feb 29, 2024"]
#: Numbers and words that are no personal data.
CLEAN = ["see /2020/05/06/ and v1.2.3", "31 February 2001", "May 1990 was warm", "30 Mayors in 1990", "sha 04dbebab91ab85687d33eeaaf9ac6991", "0123 45678", "1 May 90", "3 may 1990", "12-34-56", "x=04dbebab91ab85687d33eeaaf9ac69919z"]


@pytest.mark.parametrize("text", list(NEIGHBOURS))
@pytest.mark.parametrize("key", [b"k", b"l", b"m", b"n", b"o", b"p", b"q", b"r"])
def test_pseudonyms_beside_other_tokens(text, key):
    value, counts = NEIGHBOURS[text], collections.Counter()
    before, _, after = text.partition(value)
    new = pii.Pseudonyms(key).text(text, counts)
    assert new != text and counts.total() == 1 and new.startswith(before) and new.endswith(after) and len(new) == len(text)
    assert pii.Pseudonyms(key, undo=True).text(new, collections.Counter()) == text


@pytest.mark.parametrize("text", DATES)
def test_dates_in_words_keep_their_form(text):
    form = lambda t: [re.sub(r"[1-9]", "1", w) if len(w) < 4 and w[0].isdigit() else "year" if w.isdigit() else "," in w for w in t.split()]
    seen = set()
    for key in (b"k", b"l", b"m", b"n"):
        counts = collections.Counter()
        new = pii.Pseudonyms(key).text(f"on {text}.", counts)
        assert counts.total() == 1 and new != f"on {text}." and [len(x) if x.isdigit() else x for x in re.findall(r"[0-9]+|[ ,.]", new)] == [len(x) if x.isdigit() else x for x in re.findall(r"[0-9]+|[ ,.]", f"on {text}.")]
        assert form(new[3:-1]) is not None and pii.Pseudonyms(key, undo=True).text(new, collections.Counter()) == f"on {text}."
        seen.add(new)
    assert len(seen) == 4


@pytest.mark.parametrize("text", CLEAN)
def test_clean_texts_stay(text):
    assert pii.Pseudonyms(b"k").text(text, collections.Counter()) == text


def test_cost_of_digits_grows_with_their_number():
    """Under five seconds a MB on texts of nothing but groups of digits, were they ten times as long."""
    for group in ("12-34-", "1 ", "1234 5678 "):
        took = []
        for n in (20_000, 80_000):
            t0 = time.process_time()
            pii.Pseudonyms(b"k").text(group * (n // len(group)), collections.Counter())
            took.append(time.process_time() - t0)
        assert took[1] < 8 * max(took[0], 0.05) and took[1] < 4


def test_check_digits():
    rng = random.Random(2)
    for n in range(1, 20):
        t = "".join(rng.choice("0123456789") for _ in range(n))
        by_hand = sum(d if i % 2 == 0 else sum(map(int, str(2 * d))) for i, d in enumerate(map(int, reversed(t))))
        assert pii.luhn(t) == -by_hand % 10


def test_pseudonyms_of_digit_groups_can_be_undone():
    rng = random.Random(4)
    for i in range(300):
        text = "".join("".join(rng.choice("0123456789") for _ in range(rng.choice([1, 2, 3, 4, 4, 4, 10]))) + rng.choice("  -/.") for _ in range(40))
        assert pii.Pseudonyms(b"k", undo=True).text(pii.Pseudonyms(b"k").text(text, collections.Counter()), collections.Counter()) == text, i


def test_pii_rows(odd, none):
    df = odd.withColumn("text", F.concat("text", F.lit(" a.b@c.org")))
    got = {(r["doc_id"], r["text"]): r["n_replaced"] for r in pii.pseudonymise(df, b"k").collect()}
    assert all(n == (t is not None) for (_, t), n in got.items()) and not any("a.b@" in (t or "") for _, t in got)
    assert pii.pseudonymise(odd, b"k").drop("n_replaced").exceptAll(odd).count() == 0
    assert pii.pseudonymise(none, b"k").count() == 0


# packing


def check_packing(rows, capacity):
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing(spark, odd, none, library):
    rows = packing.pack(odd, PATH, capacity=64).collect()
    check_packing(rows, 64)
    want = collections.Counter()
    for r in odd.collect():
        ids = [*library(r["text"]), 2]
        head = len(ids) if len(ids) <= 64 else len(ids) % 64 or 64
        cuts = [0, *range(head, len(ids) + 1, 64)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[r["doc_id"], k, a, b - a, zlib.crc32(packed(ids[a:b]))] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    assert packing.pack(none, PATH).count() == 0


def best(counts, capacity):
    """Fewest sequences, by trying everything."""
    from functools import lru_cache

    @lru_cache(None)
    def go(left, room):
        if not left:
            return 0
        out = 10**9
        for i, s in enumerate(left):
            if i and left[i - 1] == s:
                continue
            rest = left[:i] + left[i + 1 :]
            if s <= room:
                out = min(out, go(rest, room - s))
        return min(out, 1 + go(left[1:], capacity - left[0]))

    return go(tuple(sorted((s for s, n in enumerate(counts) for _ in range(n)), reverse=True)), 0)


def test_reduction_keeps_the_optimum():
    rng = random.Random(8)
    for _ in range(150):
        capacity = rng.choice([10, 13, 20])
        counts = np.zeros(capacity + 1, np.int64)
        for _ in range(rng.randrange(1, 9)):
            counts[rng.randint(1, capacity)] += 1
        fixed, left = packing.reduce(counts, capacity)
        used = left.copy()
        for lengths, times in fixed:
            assert sum(lengths) <= capacity
            for s in lengths:
                used[s] += times
        assert (used == counts).all()
        assert sum(t for _, t in fixed) + best(left, capacity) == best(counts, capacity)
        plan = packing.plan(counts, capacity)
        for s in range(capacity + 1):
            spans = sorted((lo, hi) for w, lo, hi, _, _ in plan if w == s)
            assert sum(hi - lo for lo, hi in spans) == counts[s]


# toxicity


def test_toxicity(spark, small):
    rng = random.Random(9)
    plain = ["".join(rng.choice(["an", "er", "on", "th", "re", "in"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    rows, marks = [], []
    for i in range(900):
        w = [rng.choice(plain) for _ in range(rng.randint(5, 200))]
        bad = i % 6 == 0
        if bad:
            for _ in range(max(1, len(w) // 30)):
                w[rng.randrange(len(w))] = "zub" + rng.choice(["an", "er", "on", "th"])
        rows.append((i, " ".join(w), "x"))
        marks.append((i, int(bad), None))
    rows += [(900, None, "x"), (901, "", "x"), (None, "anon", "x"), (5, rows[5][1], "x")]
    marks += [(5, 0, 1), (None, 1, 1), (7, None, 0), (8, 9, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame(marks, "doc_id long, toxic int, quality int")
    got = toxicity.score(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"] if r["doc_id"] is not None else "").encode()) % 5 == 0) for r in got)
    held = [(r["doc_id"] % 6 == 0, r["predicted"]) for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 900]
    assert np.mean([a == b for a, b in held]) >= 0.95
    assert toxicity.score(docs.limit(0), labels).count() == 0
    assert {round(r["score"], 6) for r in toxicity.score(docs, labels.limit(0)).collect()} == {0.25}


def brute_models(rows, order=toxicity.ORDER, strength=toxicity.STRENGTH, discount=0.75):
    """Log-likelihood ratio of a letter after a context, by the textbook."""
    count = {c: collections.Counter() for c in (0, 1)}
    for text, toxic in rows:
        for w in toxicity.words((text or "").lower()):
            s = f"^{w}$"
            count[toxic].update((s[max(0, j - order + 1) : j], s[j]) for j in range(1, len(s)))
    types = {h + c for k in (0, 1) for h, c in count[k]}
    levels = [types]
    for _ in range(order - 1):
        levels.append(collections.Counter(g[1:] for g in levels[-1] if len(g) > 1))
    cut = {k: (lambda v: v.count(1) / max(1, v.count(1) + 2 * v.count(2)) or 0.5)(list(count[k].values())) for k in (0, 1)}

    def below(g, k=1):
        if k >= order or g not in levels[k]:
            return 1e-4
        held = [n for x, n in levels[k].items() if x[:-1] == g[:-1]]
        low = below(g[1:], k + 1) if k + 1 < order and any(levels[k + 1:]) and len(g) > 1 else 1e-4
        return max(levels[k][g] - discount, 0) / sum(held) + discount * len(held) / sum(held) * low

    def ratio(h, c):
        p = below((h + c)[1:]) if len(h) else 1e-4
        out = []
        for k in (1, 0):
            after = {x: n for (a, x), n in count[k].items() if a == h}
            n, d = sum(after.values()), cut[k]
            out.append((max(after.get(c, 0) - d, 0) + (strength + d * len(after)) * p) / (strength + n))
        return np.log(out[0] / out[1])

    return types, ratio


def test_toxicity_models_are_kneser_ney(spark):
    rng = random.Random(12)
    rows = [(" ".join("".join(rng.choice("abc\u00e9") for _ in range(rng.randint(1, 9))) for _ in range(12)), int(i % 4 == 0)) for i in range(24)] + [(None, 0), ("", 1)]
    model = toxicity.models(spark.createDataFrame(rows, "_text string, _toxic int"))
    types, ratio = brute_models(rows)
    names = sorted(types)
    found, hit = model.find(toxicity.hashes(names, toxicity.ORDER))
    assert hit.all() and len(model.keys) == len(types) + len({g[:-1] for g in types})
    assert np.allclose(found, [ratio(g[:-1], g[-1]) for g in names])
    text = [" ".join(r[0].split()[:5]) for r in rows[:3]] + ["", None]
    import pyarrow as pa

    made = toxicity.Scorer(model, margin=0.5).measured(pa.array(text))
    for k, t in enumerate(text):
        each = [[(g[:-1], g[-1]) for g in toxicity.grams(w)] for w in toxicity.words((t or "").lower())]
        sums = [sum(ratio(*g) for g in gs) for gs in each]
        assert np.isclose(made["_all"][k].as_py(), sum(sums)) and np.isclose(made["_sum"][k].as_py(), sum(max(0, x - 0.5) for x in sums))
        assert (made["_words"][k].as_py(), made["_events"][k].as_py()) == (len(each), sum(map(len, each)))


def test_toxicity_keeps_rare_events_of_large_corpora(spark):
    """The whole counted model stays: an event seen twice among 4.5 million."""
    rows = [("anerothi " * 50_000, 0)] * 10 + [("zubana " * 40 + "zubaqa zubaqa", 1)]
    model = toxicity.models(spark.createDataFrame(rows, "_text string, _toxic int"))
    assert model.contexts is None and model.find(toxicity.hashes(["^zubaq", "^zuba\0", "^zubax"], toxicity.ORDER))[1].tolist() == [True, True, False]


def test_toxicity_of_very_long_texts(spark):
    """A text of 300,000 words is read whole: what is toxic in it stands at its end."""
    rng = random.Random(10)
    plain = ["".join(rng.choice(["an", "er", "on", "th"]) for _ in range(3)) for _ in range(50)]
    rows = [(i, " ".join(rng.choices(plain, k=60) + ["zubqa zubqo"] * (i % 3 == 0))) for i in range(300)]
    long = " ".join(rng.choices(plain, k=300_000))
    rows += [(1000, long), (1001, long + " zubqa zubqo" * 12_000), (1002, "x" * 1_000_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, labels).where("doc_id >= 1000").collect()}
    assert got[1000] == 0 and got[1001] == 1 and len(got) == 3


@pytest.mark.parametrize("most", [0, 60, 400])
def test_toxicity_by_join_is_the_same(spark, monkeypatch, most):
    rng = random.Random(3)
    plain = ["".join(rng.choice(["an", "er", "on", "th", "re", "in"]) for _ in range(rng.randint(1, 4))) for _ in range(60)]
    rows = [(i, " ".join([rng.choice(plain) for _ in range(30)] + ["zubon zubth"] * (i % 5 == 0))) for i in range(200)]
    rows += [(900, None), (901, ""), (None, "anon zubon"), (5, rows[5][1]), (5, "zubon"), (902, "zubon qqq")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("predicted", F.lit("m"))
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(200)], "doc_id long, toxic int")
    got = []
    for n in (toxicity.MODEL_ROWS, most):
        monkeypatch.setattr(toxicity, "MODEL_ROWS", n)
        got.append(sorted((str(r["doc_id"]), round(r["score"], 9), r["predicted"]) for r in toxicity.score(docs, labels).collect()))
    assert len(got[0]) == len(rows) and got[0] == got[1] and len({r[2] for r in got[0]}) == 2


def test_toxicity_of_ordinary_words(spark):
    """Words of which none is strong tell the classes apart together."""
    rng = random.Random(5)
    plain = ["".join(rng.choice(["an", "er", "on", "th", "re", "in"]) for _ in range(rng.randint(2, 4))) for _ in range(40)]
    rows = [(i, " ".join(rng.choices(plain, [3 if (n < 20) == (i % 3 == 0) else 1 for n in range(40)], k=120)), int(i % 3 == 0)) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    held = toxicity.score(docs.drop("toxic"), docs.drop("text")).where("held_out").collect()
    assert np.mean([(r["doc_id"] % 3 == 0) == r["predicted"] for r in held]) >= 0.9


# registered queries that SQL can't express


@pytest.fixture(scope="module")
def texts(spark, small):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}


def test_registered_bpe(spark, small, texts, library):
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries.QUERIES["op1_bpe"](spark, small).collect()}
    assert got == {i: (len(library(t)), hashlib.sha256(packed(library(t))).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t in texts.items()}


def test_registered_token_files(spark, small, texts, library):
    at, want = 0, {}
    for i in sorted(texts):
        ids = [*library(texts[i]), 0]
        want[i] = (at, len(ids), zlib.crc32(packed(ids)))
        at += len(ids)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in queries.QUERIES["op6_token_files"](spark, small).collect()} == want


def test_registered_packing(spark, small, texts, library):
    rows = queries.QUERIES["op9_best_fit"](spark, small).collect()
    used = check_packing(rows, 1024)
    by = collections.defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    total = 0
    for i, t in texts.items():
        ids = [*library(t), 2]
        total += len(ids)
        at = 0
        for k, (piece, start, length, crc) in enumerate(sorted(by[i])):
            assert (piece, start, crc) == (k, at, zlib.crc32(packed(ids[at : at + length]))) and (length == 1024 or k == 0)
            at += length
        assert at == len(ids)
    assert len(by) == len(texts) and used <= 1.02 * -(-total // 1024) + 1


def test_registered_toxicity(spark, small, texts):
    got = queries.QUERIES["op10_toxicity"](spark, small).collect()
    assert {r["doc_id"] for r in got} == set(texts) and len(got) == len(texts)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)


def check_luhn(digits):
    return sum(sum(divmod(int(c) * (2 if k % 2 else 1), 10)) for k, c in enumerate(digits[::-1])) % 10 == 0


def test_registered_pseudonyms(spark, small, texts):
    """Words stay words of the same format, but for parts of network addresses, which have one to three digits."""
    got = {r["doc_id"]: r["text"] for r in queries.QUERIES["op8_pii"](spark, small).collect()}
    assert got.keys() == texts.keys()
    other = {r["doc_id"]: r["text"] for r in pii.pseudonymise(spark.read.parquet(f"{small}/documents.parquet"), b"another").collect()}
    for i, t in texts.items():
        a, b, c = (re.split(r"[^0-9A-Za-z]+", x or "") for x in (t, got[i], other[i]))
        assert len(a) == len(b) == len(c)
        for x, y, z in zip(a, b, c, strict=True):
            if x != y:  # only words with digits, hexadecimal ones or names of mail addresses
                if all(v.isdigit() and len(v) <= 3 and int(v) <= 255 for v in (x, y, z)):
                    continue
                assert len(x) == len(y) == len(z) and [ch.isdigit() for ch in x if not ch.isalpha()] == [ch.isdigit() for ch in y if not ch.isalpha()]


def test_planted_values_by_independent_rules(spark):
    """Values of each kind between plain words: found, replaced by valid ones of the same format, linked, undone."""
    rng, rows, places = random.Random(21), [], []
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card():
        body = "4" + digits(14)
        return body + next(d for d in "0123456789" if check_luhn(body + d))

    def day():
        return f"{rng.randint(1950, 2050)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}"

    kinds = {"card": card, "date": day, "address": lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)), "security": lambda: f"{rng.randint(100, 665)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}"}
    valid = {"card": lambda x: len(x) == 16 and check_luhn(x), "date": lambda x: bool(datetime.date.fromisoformat(x)), "address": lambda x: all(0 <= int(p) <= 255 for p in x.split(".")) and x.count(".") == 3, "security": lambda x: re.fullmatch(r"\d{3}-\d{2}-\d{4}", x) and x[:3] not in ("000", "666") and x[:3] < "900"}
    pool = {k: [make() for _ in range(12)] for k, make in kinds.items()}
    for i in range(150):
        kind = rng.choice(list(kinds))
        value = rng.choice(pool[kind])
        words = [["lorem", "ipsum", "dolor", "sit", "amet"][rng.randrange(5)] for _ in range(8)]
        at = rng.randrange(8)
        rows.append((i, " ".join([*words[:at], value, *words[at:]])))
        places.append((kind, value, at, words))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    made = pii.pseudonymise(df, b"secret")
    new = {r["doc_id"]: (r["text"].split(" "), r["n_replaced"]) for r in made.collect()}
    named = {}
    for i, (kind, value, at, words) in enumerate(places):
        out, n = new[i]
        assert n == 1 and out[:at] == words[:at] and out[at + 1 :] == words[at:]
        assert out[at] != value and valid[kind](out[at]) and named.setdefault((kind, value), out[at]) == out[at]
    assert len(set(named.values())) == len(named)
    assert {tuple(r) for r in pii.pseudonymise(made.drop("n_replaced"), b"secret", undo=True).select("doc_id", "text").collect()} == set(rows)
    counted = spark.createDataFrame([(1, ("lorem " * 50_000) + pool["card"][0]), (2, pool["card"][0])], "doc_id long, text string")
    assert len({r["text"].split(" ")[-1] for r in pii.pseudonymise(counted, b"secret").collect()}) == 1


def test_recall_of_a_relaxed_search_over_shards(spark, monkeypatch):
    monkeypatch.setattr(vptree, "SHARD", 500)
    monkeypatch.setattr(vptree, "LEAF", 16)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2000, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    want = {i: set(np.argsort(-np.where(np.arange(2000) == i, -np.inf, x @ x[i]), kind="stable")[:20].tolist()) for i in range(0, 2000, 20)}
    for relax, least in ((1.0, 1.0), (1.5, 0.9)):
        got = collections.defaultdict(set)
        for r in vptree.nearest(df, df.where("vec_id % 20 = 0"), k=20, relax=relax).collect():
            got[r["query_id"]].add(r["vec_id"])
        assert np.mean([len(got[q] & w) / 20 for q, w in want.items()]) >= least


# pipeline and SQL


def test_pipeline(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "n-gram Jaccard join", "PII", "best-fit packing"]
    steps = [docs]
    for name, step in corpus_pipeline.STAGES[:-1]:
        steps.append(scratch.table(step(spark, steps[-1], small), "stage"))
        assert steps[-1].columns == docs.columns
    ids = [{r["doc_id"] for r in d.collect()} for d in steps]
    bad = {r["doc_id"] for r in toxicity.score(docs, spark.read.parquet(f"{small}/labels.parquet")).where("predicted = 1").collect()}
    assert ids[1] == ids[0] - bad
    assert ids[2] == {v[0] for v in brute_dedup(steps[1].collect()).values()}
    assert ids[3] == {i for i, (_, c) in brute_link([(r["doc_id"], r["text"]) for r in steps[2].collect()], 5, 80, 100).items() if i == c}
    names = pii.Pseudonyms(queries.pii_key(spark))
    assert {(r["doc_id"], r["text"]) for r in steps[4].collect()} == {(r["doc_id"], names.text(r["text"] or "", collections.Counter())) for r in steps[3].collect()}
    rows = corpus_pipeline.run(spark, small).collect()
    assert {r["doc_id"] for r in rows} == ids[4]
    check_packing(rows, 1024)


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_against_sql(spark, small, name):
    same(queries.QUERIES[name](spark, small), queries.ORACLES[name], small)


@pytest.mark.parametrize("rows", [[(1, None), (2, "")], [(1, None), (2, ""), (3, " \n"), (4, "a b"), (None, None), (4, "a b")]])
def test_toxicity_of_batches_without_words(spark, rows):
    """Every partition holds nulls and empty texts alone, or beside others."""
    labels = spark.createDataFrame([(1, 0), (2, 1), (4, 1)], "doc_id long, toxic int")
    for parts in (1, 4):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        got = toxicity.score(docs, labels).collect()
        assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in rows)
        assert all(0 <= r["score"] <= 1 for r in got)


def pipeline_folder(spark, tmp_path, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, _md5 string, kept boolean, _bit int, _id long")
    docs.repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, 0), (2, 1, 1), (7, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Nulls, null ids, repeats, batches without words, a long text and columns whose names clash, through all stages."""
    long = " ".join(f"word{i % 977} other{i % 13}" for i in range(30000))
    texts = [(1, None), (2, ""), (3, "a b c d e f g h"), (4, "a b c d e f  g h"), (5, long), (6, long + " x"), (3, "a b c d e f g h"), (None, "no id here at all"), (None, None), (7, " \n")]
    folder = pipeline_folder(spark, tmp_path, [(i, t, "en", None, len(t or ""), "m", False, 5, 9) for i, t in texts])
    got = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in got} == {7, None, 4, 5}  # the longest of equal texts, blank ones included, and the first of near copies
    assert all(r["length"] <= 1024 for r in got)


@pytest.mark.parametrize("trees, blocks", [(1, 1), (150 * 8 * 8 * 3, 40 * 8 * 8 * 2), (1 << 25, 1 << 24)])
def test_stretches_of_trees_and_blocks(spark, monkeypatch, trees, blocks):
    """However trees and query blocks are dealt, results are exact; and a task leaves k rows a query, not k a tree."""
    monkeypatch.setattr(vptree, "SHARD", 150)
    monkeypatch.setattr(vptree, "LEAF", 16)
    monkeypatch.setattr(vptree, "BLOCK", 40)
    monkeypatch.setattr(vptree, "TREES", trees)
    monkeypatch.setattr(vptree, "BLOCKS", blocks)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1300, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    asked = df.where("vec_id % 10 = 0")
    found = vptree.nearest(df, asked, k=5)
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in found.collect()}
    for q in range(0, 1300, 10):
        score = x @ x[q]
        score[q] = -np.inf
        assert [got[q, k + 1] for k in range(5)] == np.argsort(-score, kind="stable")[:5].tolist()
    stretches = -(-9 // max(1, trees // (8 * 150 * 8)))  # 9 shards
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        window = found._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "FlatMapCoGroupsInArrow" in window and stretches >= 1


def test_best_of_other_trees_prunes():
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(500, 4)) * 0.01 + c for c in np.eye(4)])
    x /= np.linalg.norm(x, axis=1)[:, None]
    q, own = x[::40], np.arange(0, 2000, 40)
    parts = [np.arange(0, 2000, 2), np.arange(1, 2000, 2)]
    made = [(x[p][o], p[o], e, n) for p in parts for o, e, n in [vptree.build(x[p], 1.0)]]
    alone = [vptree.search(a, ids, e, n, 1.0, q, own, 10, 1.0) for a, ids, e, n in made]
    best = alone[0][:2]
    both = vptree.search(*made[1], 1.0, q, own, 10, 1.0, (best[0].copy(), best[1].copy()))
    score = x @ q.T
    score[own, np.arange(len(own))] = -np.inf
    assert np.allclose(both[0], -np.sort(-score, axis=0)[:10].T)
    assert both[2] <= alone[1][2]


@pytest.mark.parametrize("rows, most", [(4096, 1 << 24), (3, 1 << 24), (4096, 4000)])
def test_ngram_groups_are_small(spark, monkeypatch, rows, most):
    """Groups end by rows and by bytes, whatever the documents' lengths, and links stay the same."""
    monkeypatch.setattr(ngram_join, "GROUP_ROWS", rows)
    monkeypatch.setattr(ngram_join, "GROUP_BYTES", most)
    rng = random.Random(8)
    base = [" ".join(f"w{rng.randrange(400)}" for _ in range(n)) for n in (5, 40, 40, 2000, 2000, 300, 3, 0)]
    texts = [t for b in base for t in (b, b + " tail", b)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    docs = ngram_join.described(df, 3, ngram_join.Bounds(90, 100), "doc_id", "text")
    sizes = docs.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("long")).alias("b")).collect()
    assert all(r["n"] <= rows and (r["n"] == 1 or r["b"] <= most) for r in sizes) and (len(sizes) > 2 or rows == 4096 and most == 1 << 24)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.link(df, n=3, num=90, den=100).collect()}
    assert got == {3 * k + j: 3 * k + (j if not b else 1 if j == 1 and len(b.split()) < 30 else 0) for k, b in enumerate(base) for j in range(3)}


def test_pipeline_of_an_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, pipeline_folder(spark, tmp_path, [])).count() == 0


def test_parts_of_a_common_shingle_meet_without_sending_its_largest_one_around(spark):
    """Every pair of different parts meets; the largest part's entries are sent once, not to every block."""
    main, others = 5000, 30
    rows = [(7, r, main + others, 1 if r < main else r) for r in range(main + others)]
    found = spark.createDataFrame(rows, "token long, row long, held long, part long")
    sent = ngram_join.parting(found)
    assert sent.count() <= main + others * (-(-main // ngram_join.MEET) + 1)
    x, y = sent, sent.select("token", "lo", "hi", sent["row"].alias("_row"), sent["part"].alias("_part"), sent["side"].alias("_side"))
    met = x.join(y, ["token", "lo", "hi"]).where("row < _row AND part <> _part AND (lo = hi OR side <> _side)")
    assert met.select("row", "_row").distinct().count() == main * others + others * (others - 1) // 2
    assert ngram_join.meeting(found).count() == (main + others) * (-(-(main + others) // ngram_join.MEET))


def test_pairs_between_parts_are_given_once_not_at_every_shingle(spark):
    """Documents of different parts that share forty common shingles are a pair once, and no pair is lost."""
    bounds, shared, docs = ngram_join.Bounds(80, 100), 40, 30
    sets = [np.sort(ngram_join.mix(np.array([*range(shared), 1000 + r], np.uint64))) for r in range(docs)]
    rows = [(t, r, docs, shared + 1, 1, shared, r // 3, bytearray(ngram_join.parity(x))) for r, x in enumerate(sets) for t in x.view(np.int64).tolist()]
    parted = spark.createDataFrame(rows, "token long, row long, held long, size int, matches int, common int, part long, sign binary")
    got = [(p["a"], p["b"]) for p in ngram_join.candidates(ngram_join.carrying(parted), bounds, True).collect()]
    assert len(got) <= 2 * len(set(got))
    assert set(got) == {(a, b) for a in range(docs) for b in range(a + 1, docs) if a // 3 != b // 3}
