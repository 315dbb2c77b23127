"""Toxicity by class-conditional Kneser-Ney models.

Two models, of toxic and of ordinary text, give the letters of each word: the next letter after up to ``order`` - 1
letters of the word so far. The longest contexts have counts of their own class, discounted and held by ``STRENGTH``
against the back-off. Below, both back off to the same Kneser-Ney continuation counts of all training text, so a rare
expression gets nearly equal likelihoods from both and cannot tip the balance. A document has two measures: the
log-likelihood ratio of all its events divided by their number, to which ordinary words add as toxic ones do, and the
ratio of each word beyond ``margin`` divided by the number of words, which a few strong words in a long text decide. A
logistic fit on labelled rows that the counts have not seen makes a score of both.

Arrow finds the distinct stretches between blanks of a batch, and numpy scores their words: an event is a 64-bit hash of
its letters, looked up among the model's sorted hashes.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe, scratch

ORDER, MARGIN, STRENGTH = 6, 3.0, 10.0
#: Entries of the model that are sent to every task at most (16 bytes each), those of the most frequent contexts; words
#: that need others get their values by a join with the whole model.
MODEL_ROWS = 1 << 20
#: Labelled rows of the logistic fit at most, and of a labels table that is broadcast.
FIT_ROWS, BROADCAST_ROWS = 50_000, 1_000_000
#: Characters of the texts that are split into words at once, about; a longer text is alone.
BATCH = 500_000
#: Stretches whose sums a worker keeps.
KEPT = 100_000

U = np.uint64
FACTOR = 0x9E3779B97F4A7C15

words = re.compile(r"\w+").findall


def grams(word: str, order: int = ORDER) -> list[str]:
    """The events of a word: each letter with the letters before it, from the start mark on."""
    s = f"^{word}$"
    return [s[max(0, j - order + 1) : j + 1] for j in range(1, len(s))]


def mixed(sums: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hashes of strings from their polynomial sums and lengths."""
    x = sums + sizes.astype(np.uint64) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(29))


def letters(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points plus one of all strings, one after another, and the strings' lengths."""
    flat = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + U(1)
    return flat, np.fromiter(map(len, strings), np.int64, len(strings))


def hashes(strings: list[str], order: int) -> np.ndarray:
    """A hash of each string of at most ``order`` characters, one at least."""
    flat, sizes = letters(strings)
    powers = np.array([pow(FACTOR, k, 1 << 64) for k in range(order + 1)], np.uint64)
    ends = np.cumsum(sizes)
    back = np.repeat(ends, sizes) - np.arange(len(flat)) - 1
    sums = np.add.reduceat(flat * powers[back], ends - sizes) if len(strings) else np.zeros(0, np.uint64)
    return mixed(sums, sizes)


def fold(id_col: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))), F.lit(5))


def counted(df: DataFrame, order: int) -> DataFrame:
    """gram, toxic, ordinary: counts of the events of ``df`` (_text, _toxic), pre-aggregated in each task."""

    def run(chunks):
        for b in chunks:
            for lo, hi in bpe.batches(b.column(0), BATCH):
                seen = (Counter(), Counter())
                for text, toxic in zip(b.column(0).slice(lo, hi - lo).to_pylist(), b.column(1).slice(lo, hi - lo).to_pylist(), strict=True):
                    seen[toxic].update(words((text or "").lower()))
                made: dict[str, list[int]] = {}
                for k in (0, 1):
                    for w, n in seen[k].items():
                        for g in grams(w, order):
                            made.setdefault(g, [0, 0])[k] += n
                yield pa.RecordBatch.from_arrays([pa.array(list(made), pa.string()), pa.array([v[1] for v in made.values()], pa.int64()), pa.array([v[0] for v in made.values()], pa.int64())], names=["gram", "toxic", "ordinary"])

    parts = df.select("_text", "_toxic").mapInArrow(scratch.lean(run), "gram string, toxic long, ordinary long")
    return parts.groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def context(gram: Column) -> Column:
    return F.substring(gram, 1, F.length(gram) - 1)


def shared(types: DataFrame, order: int, discount: float = 0.75) -> DataFrame:
    """gram, p: the back-off of both models, interpolated Kneser-Ney of order - 1 letters from continuation counts."""
    levels, level = [], types.select("gram")
    for _ in range(order - 1):
        level = level.where(F.length("gram") > 1).groupBy(F.substring("gram", 2, order).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
        levels.append(level)
        level = level.select("gram")
    below = None
    for level in reversed(levels):
        w = Window.partitionBy("_h")
        level = level.withColumn("_h", context(F.col("gram"))).select("gram", "n", F.sum("n").over(w).alias("_s"), F.count(F.lit(1)).over(w).alias("_t"))
        low = F.lit(1e-4)
        if below is not None:
            level = level.withColumn("_low", F.substring("gram", 2, order)).join(below.select(F.col("gram").alias("_low"), F.col("p").alias("_p")), "_low", "left")
            low = F.coalesce("_p", low)
        below = level.select("gram", (F.greatest(F.col("n") - discount, F.lit(0.0)) / F.col("_s") + discount * F.col("_t") / F.col("_s") * low).alias("p"))
    return below


class Model(NamedTuple):
    """Log-likelihood ratios of the events in the model and, where the next letter isn't in it, of a context alone.

    ``keys`` and ``values``: whole contexts, sorted by the hashes of context + letter and context + "\\0". ``contexts``
    has all of them: _h, _n (events), _other (the ratio of other letters), _letters (ratios by letter); None where all
    of them are sent.
    """

    keys: np.ndarray
    values: np.ndarray
    contexts: DataFrame | None

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of hashes, 0 where there is none, and where there is one."""
        if not len(self.keys):
            return np.zeros(len(keys)), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = self.keys[at] == keys
        return np.where(hit, self.values[at], 0.0), hit


def models(train: DataFrame, order: int = ORDER, strength: float = STRENGTH) -> Model:
    """The models of ``train`` (_text, _toxic): every event that occurs is in them, however rare.

    With n events of a class after a context, t of them different and c of them this letter, the class gives the letter
    (max(c - d, 0) + (strength + d * t) * p) / (strength + n), p being the shared back-off.
    """
    types = scratch.table(counted(train, order), "grams")
    once = types.agg(*(F.count(F.when(F.col(c) == n, 1)).alias(f"{c}{n}") for c in ("toxic", "ordinary") for n in (1, 2))).first()
    cut = {c: once[f"{c}1"] / max(1, once[f"{c}1"] + 2 * once[f"{c}2"]) or 0.5 for c in ("toxic", "ordinary")}
    w = Window.partitionBy("_h")
    full = types.withColumn("_h", context(F.col("gram"))).select("gram", "toxic", "ordinary", "_h", *(F.sum(c).over(w).alias(f"_n_{c}") for c in cut), *(F.count(F.when(F.col(c) > 0, 1)).over(w).alias(f"_t_{c}") for c in cut))
    total = {c: F.col(f"_n_{c}") + F.lit(strength) for c in cut}
    back = {c: (F.lit(strength) + F.lit(cut[c]) * F.col(f"_t_{c}")) / total[c] for c in cut}
    full = full.withColumn("_low", F.substring("gram", 2, order)).join(shared(types, order).select(F.col("gram").alias("_low"), "p"), "_low", "left").withColumn("p", F.coalesce("p", F.lit(1e-4)))
    own = {c: F.greatest(F.col(c) - cut[c], F.lit(0.0)) / total[c] + back[c] * F.col("p") for c in cut}
    events = full.select("_h", (F.col("_n_toxic") + F.col("_n_ordinary")).alias("_n"), (F.log(back["toxic"]) - F.log(back["ordinary"])).alias("_other"), F.substring("gram", -1, 1).alias("c"), (F.log(own["toxic"]) - F.log(own["ordinary"])).alias("r"))
    contexts = scratch.table(events.groupBy("_h").agg(F.max("_n").alias("_n"), F.max("_other").alias("_other"), F.map_from_entries(F.collect_list(F.struct("c", "r"))).alias("_letters")), "contexts")
    size = F.floor(4 * F.log2("_n"))
    least, rows, whole = None, 0, True
    for r in sorted(contexts.groupBy(size.alias("size")).agg(F.sum(F.size("_letters") + 1).alias("n")).collect(), reverse=True):
        rows += r["n"]
        if rows > MODEL_ROWS:
            whole = False
            break
        least = r["size"]
    sent = contexts.where(size >= least) if least is not None else contexts.limit(0)
    sent = sent.select(F.col("_h"), F.explode(F.map_concat("_letters", F.create_map(F.lit("\0"), "_other"))).alias("c", "r")).select(F.concat("_h", "c").alias("gram"), "r").toArrow()
    keys = hashes(sent.column(0).to_pylist(), order)
    by = np.argsort(keys)
    return Model(keys[by], sent.column(1).to_numpy()[by], None if whole else contexts)


class Words(NamedTuple):
    """Values of words: the ratio beyond the margin, all of it, events, and whether it takes more than was sent."""

    strong: np.ndarray
    ratio: np.ndarray
    events: np.ndarray
    open: np.ndarray


def values(model: Model, found: list[str], order: int, margin: float) -> Words:
    flat, sizes = letters([f"^{w}$" for w in found])
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    place = np.arange(len(flat)) - first
    sums, factor = np.zeros(len(flat), np.uint64), 1
    for back in range(order):
        at = np.flatnonzero(place >= back)
        sums[at] += flat[at - back] * U(factor)
        factor = factor * FACTOR % (1 << 64)
    events = np.flatnonzero(place > 0)
    word = np.repeat(np.arange(len(found)), sizes)[events]
    size = np.minimum(place[events] + 1, order)
    value, hit = model.find(mixed(sums[events], size))
    miss = np.flatnonzero(~hit)
    other, known = model.find(mixed(sums[events[miss]] - flat[events[miss]] + U(1), size[miss]))
    value[miss] = other
    total = np.bincount(word, value, len(found)).astype(np.float64)  # integers where nothing is counted
    rest = np.zeros(len(found), bool)
    if model.contexts is not None:
        rest[word[miss[~known]]] = True
    return Words(np.maximum(0.0, total - margin), total, sizes - 1, rest)


class Scorer:
    """Measures texts under what was sent of a model; sums of stretches between blanks are kept in a bounded table."""

    def __init__(self, model: Model, order: int = ORDER, margin: float = MARGIN):
        self.model, self.order, self.margin = model, order, margin
        self.known: dict[bytes, int] = {}
        self.sums = np.zeros((4, 0))

    def stretches(self, parts: list[bytes]) -> tuple[np.ndarray, dict[int, list[str]]]:
        """Sums over each stretch's words (the ratio beyond the margin, all of it, words, events) and its open words."""
        split = [words(s.decode("utf-8", "replace").lower()) for s in parts]
        number: dict[str, int] = {}
        flat = np.array([number.setdefault(w, len(number)) for ws in split for w in ws], np.int64)
        of = np.repeat(np.arange(len(split)), np.fromiter(map(len, split), np.int64, len(split)))
        w = values(self.model, list(number), self.order, self.margin)
        closed = ~w.open[flat]
        sums = np.stack([np.bincount(of, x, len(split)).astype(np.float64) for x in (np.where(closed, w.strong[flat], 0.0), np.where(closed, w.ratio[flat], 0.0), np.ones(len(flat)), w.events[flat])])
        return sums, {k: [x for x in split[k] if w.open[number[x]]] for k in np.unique(of[~closed]).tolist()}

    def measured(self, texts: pa.Array) -> dict[str, pa.Array]:
        """For each text: sums over the words whose values are known here, numbers of words and events, the other words."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
        cut = blank.copy()
        cut[1:] &= ~blank[:-1]
        cut[offsets[:-1][offsets[:-1] < len(raw)]] = True
        borders = np.append(np.flatnonzero(cut), len(raw))
        parts = pa.Array.from_buffers(pa.large_binary(), len(borders) - 1, [None, pa.py_buffer(borders), pa.py_buffer(raw)]).dictionary_encode()
        names, which, open_ = bpe.as_bytes(parts.dictionary), parts.indices.to_numpy(), {}
        if self.model.contexts is None:
            if len(self.known) > KEPT:
                self.known, self.sums = {}, np.zeros((4, 0))
            new = [s for s in names if s not in self.known]
            if new:
                self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
                self.sums = np.concatenate([self.sums, self.stretches(new)[0]], axis=1)
            sums = self.sums[:, np.fromiter(map(self.known.__getitem__, names), np.int64, len(names))]
        else:
            sums, open_ = self.stretches(names)
        document = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(borders, offsets)))
        strong, ratio, n_words, n_events = (np.bincount(document, x[which], len(texts)).astype(np.float64) for x in sums)
        out = {"_sum": pa.array(strong), "_all": pa.array(ratio), "_words": pa.array(n_words.astype(np.int64)), "_events": pa.array(n_events.astype(np.int64))}
        if self.model.contexts is not None:
            odd = np.isin(which, list(open_))
            rest: list[Counter] = [Counter() for _ in range(len(texts))]
            for d, k in zip(document[odd].tolist(), which[odd].tolist(), strict=True):
                rest[d].update(open_[k])
            out |= {"_rest": pa.array([list(c) for c in rest], pa.list_(pa.string())), "_times": pa.array([list(c.values()) for c in rest], pa.list_(pa.int64()))}
        return out


def evidence(df: DataFrame, model: Model, order: int, margin: float) -> DataFrame:
    """``df`` (_text, _md5 of it, and others) with _text replaced by _strong (a word) and _ratio (an event)."""
    whole = model.contexts is None
    sent = df.sparkSession.sparkContext.broadcast((model.keys, model.values))
    keep = [c for c in df.columns if c != "_text"]
    schema = df.select(*keep, *(F.lit(0.0).alias(c) for c in ("_sum", "_all")), *(F.lit(0).cast("long").alias(c) for c in ("_words", "_events"))).schema
    if not whole:
        schema = T.StructType([*schema, T.StructField("_rest", T.ArrayType(T.StringType())), T.StructField("_times", T.ArrayType(T.LongType()))])

    def run(chunks):
        scorer = Scorer(Model(*sent.value, None if whole else ()), order, margin)
        for b in chunks:
            at = b.schema.get_field_index("_text")
            for lo, hi in bpe.batches(b.column(at), BATCH):
                part = b.slice(lo, hi - lo)
                made = scorer.measured(part.column(at))
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in keep), *made.values()], names=[*keep, *made])

    means = [(F.col(a) / F.greatest(n, F.lit(1))).alias(c) for a, n, c in (("_sum", "_words", "_strong"), ("_all", "_events", "_ratio"))]
    seen = df.select(*keep, "_text").mapInArrow(scratch.lean(run), schema)
    if whole:
        return seen.select(*keep, *means)

    def split(chunks):
        here = Model(*sent.value, ())
        for b in chunks:
            rows = []
            for w in b.column(0).to_pylist():
                events = grams(w, order)
                value, hit = here.find(hashes(events, order))
                other, known = here.find(hashes([g[:-1] + "\0" for g in events], order))
                total = float(value.sum() + other[~hit].sum())
                rows += [(w, g[:-1], g[-1], 0.0 if i else total) for i, g in enumerate(g for g, a, b in zip(events, hit, known, strict=True) if not a and not b)]
            yield pa.RecordBatch.from_pylist([dict(zip(("_word", "_h", "_c", "_sent"), r, strict=True)) for r in rows], pa.schema([("_word", pa.string()), ("_h", pa.string()), ("_c", pa.string()), ("_sent", pa.float64())]))

    seen = scratch.table(seen, "evidence")
    rest = seen.where(F.size("_rest") > 0).select("_md5", F.explode(F.arrays_zip("_rest", "_times")).alias("r")).select("_md5", F.col("r")["_rest"].alias("_word"), F.col("r")["_times"].alias("_times")).distinct()
    value = rest.select("_word").distinct().mapInArrow(split, "_word string, _h string, _c string, _sent double").join(model.contexts, "_h", "left")
    value = value.groupBy("_word").agg(F.sum(F.col("_sent") + F.coalesce(F.col("_letters")[F.col("_c")], "_other", F.lit(0.0))).alias("_value"))
    more = rest.join(value, "_word").groupBy("_md5").agg(F.sum(F.col("_times") * F.greatest(F.col("_value") - margin, F.lit(0.0))).alias("_more"), F.sum(F.col("_times") * F.col("_value")).alias("_more_all"))
    made = seen.join(more, "_md5", "left")
    return made.withColumn("_sum", F.col("_sum") + F.coalesce("_more", F.lit(0.0))).withColumn("_all", F.col("_all") + F.coalesce("_more_all", F.lit(0.0))).select(*keep, *means)


def features(strong: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(strong)), strong, np.log(strong + 1e-3), ratio])


def logistic(strong: np.ndarray, ratio: np.ndarray, toxic: np.ndarray) -> list[float]:
    """Weights of :func:`features` by Newton's method with a small ridge; the prior alone where a class is missing."""
    if len(set(toxic.tolist())) < 2:
        p = (toxic.sum() + 0.5) / (len(toxic) + 1) if len(toxic) else 0.25
        return [math.log(p / (1 - p)), 0.0, 0.0, 0.0]
    x, w = features(strong, ratio), np.zeros(4)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(4), x.T @ (toxic - p) - 1e-3 * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w.tolist()


def score(df: DataFrame, labels: DataFrame, order: int = ORDER, margin: float = MARGIN, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """The id column, ``held_out``, ``score`` (0 to 1), ``predicted`` and ``text_md5`` for every row of ``df``.

    Labels are learned from rows with crc32(id as text) mod 5 not 0: those with 2, 3 or 4 give the counts, those with
    1 (of at most FIT_ROWS, by a hash of the id) the logistic fit. ``labels`` has the id column and ``label_col`` 0 or
    1; other values and nulls are no labels; an id labelled both ways counts as toxic; repeated labels count once.
    Null and empty texts have no evidence and get a score from the fit; very long texts are read whole. Without labels
    of both kinds every row gets the share of the toxic ones, 0.25 where there are none. Null ids are never labelled.
    Repeated rows keep a row each; an empty table gives none; other columns don't matter.
    """
    marks = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_toxic"))
    marks = marks.withColumn("_fold", fold(F.col("_id"))).where("_fold <> 0")
    if labels.count() <= BROADCAST_ROWS:
        marks = F.broadcast(marks)
    docs = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).withColumn("_md5", F.md5(F.coalesce("_text", F.lit(""))))
    marked = docs.join(marks, "_id")
    model = models(marked.where("_fold <> 1"), order)
    fit = evidence(marked.where("_fold = 1").select("_id", "_text", "_md5", "_toxic"), model, order, margin)
    fit = fit.select(F.xxhash64("_id").alias("_o"), "_md5", "_toxic", "_strong", "_ratio").orderBy("_o", "_md5").limit(FIT_ROWS).collect()
    weights = logistic(*(np.array([r[c] for r in fit]) for c in ("_strong", "_ratio", "_toxic")))
    out = evidence(docs, model, order, margin)
    x = F.lit(weights[0]) + F.lit(weights[1]) * F.col("_strong") + F.lit(weights[2]) * F.log(F.col("_strong") + 1e-3) + F.lit(weights[3]) * F.col("_ratio")
    out = out.withColumn("_score", 1 / (1 + F.exp(-x)))
    return out.select(F.col("_id").alias(id_col), (fold(F.col("_id")) == 0).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"), F.col("_md5").alias("text_md5"))
