"""URL rules through a cascade of Bloom filters; DataFrame and SQL functions only.

The keys of a url are its host suffixes put before its path prefixes, for the label counts and prefix lengths that the
rule list has. They are the key universe. Level 0 of a cascade encodes the listed keys; level 1 the universe's keys
that level 0 lets through though they aren't listed; level 2 the listed keys that level 1 lets through; and so on
until a level lets nothing wrong through. Membership of any key of the universe is then exact and needs no join.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch

#: A level's bits, which every task holds; a list that needs more is looked up by a join.
MOST_BITS = 1 << 27
#: Shapes of rules that are columns of a url's row; with more of them the keys are rows.
MOST_SHAPES = 24


@dataclass(frozen=True)
class Rule:
    action: str  # allow or block
    host: str
    path: str

    @property
    def key(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Level:
    bits: DataFrame  # one row, one array of integers
    size: int
    hashes: int
    salt: int

    def holds(self, key: Column) -> Column:
        words = self.bits.scalar()
        tests = [F.getbit(F.element_at(words, (p.bitwiseAND(F.lit(self.size - 1)) / 64).cast("int") + 1), p.bitwiseAND(F.lit(63)).cast("int")) == 1 for p in places(key, self.size, self.hashes, self.salt)]
        return reduce(lambda a, b: a & b, tests)


def places(key: Column, size: int, hashes: int, salt: int) -> list[Column]:
    """Double hashing, other hashes for each level; ``size`` is a power of two of at most 2**27, so no sum overflows."""
    one = F.xxhash64(F.lit(2 * salt), key).bitwiseAND(F.lit(size - 1))
    two = F.xxhash64(F.lit(2 * salt + 1), key).bitwiseAND(F.lit(size - 1)).bitwiseOR(F.lit(1))
    return [(one + two * F.lit(i)).bitwiseAND(F.lit(size - 1)) for i in range(hashes)]


def level(keys: DataFrame, count: int, wrong: float, salt: int) -> Level:
    """A Bloom filter over ``keys`` (one column, key) that lets a share ``wrong`` of other keys through."""
    hashes = max(1, min(30, round(math.log2(1 / wrong))))
    size = max(64, 1 << math.ceil(math.log2(max(1, count) * hashes / math.log(2))))
    spark = keys.sparkSession
    bits = keys.select(F.explode(F.array(*places(F.col("key"), size, hashes, salt))).alias("p"))
    words = bits.groupBy((F.col("p") / 64).cast("int").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p").bitwiseAND(F.lit(63)).cast("int"))).alias("x"))
    packed = words.agg(F.map_from_entries(F.collect_list(F.struct("w", "x"))).alias("m"))  # size / 64 entries at most
    full = F.transform(F.sequence(F.lit(0), F.lit(size // 64 - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long")))
    if size <= 4096:
        return Level(scratch.table(packed.select(full.alias("bits")), "bloom"), size, hashes, salt)
    slots = spark.range(size // 64).select(F.col("id").cast("int").alias("w")).join(words, "w", "left")
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("w", F.coalesce("x", F.lit(0).cast("long")).alias("x")))), lambda z: z["x"])
    return Level(scratch.table(slots.agg(in_order.alias("bits")), "bloom"), size, hashes, salt)


def cascade(listed: DataFrame, universe: DataFrame) -> list[Level]:
    """Levels for ``listed`` over ``universe``, both with the column key and distinct keys."""
    n = listed.count()
    total = max(1, universe.agg(F.approx_count_distinct("key")).first()[0])
    if not n:
        return []
    levels = [level(listed, n, min(0.5, n / (math.sqrt(2) * total)), 0)]
    wrong = scratch.table(universe.where(levels[0].holds(F.col("key"))).join(F.broadcast(listed) if n <= 100_000 else listed, "key", "left_anti").distinct(), "passed")
    own = listed
    while count := wrong.count():
        levels.append(level(wrong, count, 0.5, len(levels)))
        own, wrong = wrong, scratch.table(own.where(levels[-1].holds(F.col("key"))), "passed")
    return levels


def member(levels: list[Level], key: Column) -> Column:
    """Whether the key, one of the universe, is listed."""
    answer = F.lit(len(levels) % 2 == 1)
    for i in reversed(range(len(levels))):
        answer = F.when(levels[i].holds(key), answer).otherwise(F.lit(i % 2 == 1))
    return answer


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or the end, A-Z lower-cased; path: from there up to ?, # or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.coalesce(F.translate(host, ascii_uppercase, ascii_lowercase), F.lit("")), F.coalesce(path, F.lit(""))


def candidates(host: Column, path: Column, shapes: list[tuple[int, int]]) -> list[Column]:
    """Keys of a url, one for each (labels, path length) shape; null where the url is too short for it."""
    labels = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1
    return [F.when((labels >= n) & (F.length(path) >= m), F.concat(F.substring_index(host, ".", -n), F.substring(path, 1, m))) for n, m in shapes]


def order(key: Column) -> Column:
    """Longer keys are greater, then those with longer hosts."""
    return F.struct(F.length(key).alias("long"), F.length(F.substring_index(key, "/", 1)).alias("host"), key.alias("key"))


def rules_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    rows = ", ".join(f"('{r.action}', '{q(r.host)}', '{q(r.path)}')" for r in rules)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(action, host, path)" if rules else "SELECT '' AS action, '' AS host, '' AS path WHERE false")


def q(text: str) -> str:
    return text.replace("\\", "\\\\").replace("'", "\\'")


def judge(df: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", otherwise: str = "allow") -> DataFrame:
    """The id column, host, path, rule, verdict for every row of ``df``.

    ``rules`` has the columns action (allow or block), host, path; a rule fits its host and all subdomains where the
    url's path begins with the rule's, and the longest one wins. A url that the cascades list nowhere gets the verdict
    ``otherwise``. Null urls and those without :// have an empty host and path and no rule. Repeated rows keep a row
    each; an empty table gives none; an empty rule list lets every row have ``otherwise``; a key that both actions
    list is blocked. Other columns of ``df`` don't matter.

    Very long urls are read whole. Beyond MOST_BITS for level 0 the keys are looked up by a join on the key instead,
    since every task holds a cascade's levels.
    """
    listed = rules.select("action", F.concat(F.translate("host", ascii_uppercase, ascii_lowercase), "path").alias("key"), F.struct((F.length("host") - F.length(F.replace("host", F.lit("."), F.lit(""))) + 1).alias("n"), F.length("path").alias("m")).alias("shape"))
    # at most the labels of a host times the lengths of a path
    shapes = sorted((r["shape"]["n"], r["shape"]["m"]) for r in listed.select("shape").distinct().collect())
    host, path = host_and_path(F.col(url_col))
    rows = df.select(F.col(id_col).alias("_id"), host.alias("_host"), path.alias("_path"))
    if not shapes:
        return rows.select(F.col("_id").alias(id_col), F.col("_host").alias("host"), F.col("_path").alias("path"), F.lit(None).cast("string").alias("rule"), F.lit(otherwise).alias("verdict"))
    count = listed.count()
    blocked, allowed = listed.where("action = 'block'").select("key").distinct(), listed.where("action = 'allow'").select("key").distinct().join(listed.where("action = 'block'").select("key"), "key", "left_anti")
    if len(shapes) > MOST_SHAPES or count * 40 > MOST_BITS:
        return _as_rows(rows, shapes, blocked, allowed, count * 40 <= MOST_BITS, id_col, otherwise)
    names = [f"_key{i}" for i in range(len(shapes))]
    rows = rows.select("_id", "_host", "_path", *(k.alias(n) for k, n in zip(candidates(F.col("_host"), F.col("_path"), shapes), names, strict=True)))
    universe = rows.select(F.explode(F.array(*names)).alias("key")).where("key IS NOT NULL")
    no, yes = cascade(blocked, universe), cascade(allowed, universe)
    fits = [F.when(F.col(n).isNotNull() & (member(no, F.col(n)) | member(yes, F.col(n))), order(F.col(n))) for n in names]
    rows = rows.withColumn("_rule", F.array_max(F.array(*fits))["key"] if len(fits) > 1 else fits[0]["key"])
    verdict = F.when(F.col("_rule").isNull(), F.lit(otherwise)).when(member(no, F.col("_rule")), "block").otherwise("allow")
    return rows.select(F.col("_id").alias(id_col), F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"), verdict.alias("verdict"))


def _as_rows(rows: DataFrame, shapes: list[tuple[int, int]], blocked: DataFrame, allowed: DataFrame, small: bool, id_col: str, otherwise: str) -> DataFrame:
    """The same with a row for each key of a url: for many shapes, and (not ``small``) for lists that must be joined."""
    rows = scratch.table(rows.withColumn("_row", F.monotonically_increasing_id()), "urls")
    labels = F.length("_host") - F.length(F.replace("_host", F.lit("."), F.lit(""))) + 1
    by_labels = {n: [m for k, m in shapes if k == n] for n, _ in shapes}

    def cut(n: int, lengths: list[int]) -> Column:
        fit = F.filter(F.array(*map(F.lit, lengths)), lambda m: m <= F.length("_path"))
        return F.when(labels >= n, F.transform(fit, lambda m: F.concat(F.substring_index("_host", ".", -n), F.call_function("substring", F.col("_path"), F.lit(1), m))))

    cuts = [cut(n, lengths) for n, lengths in by_labels.items()]
    keys = rows.select("_row", F.explode(F.flatten(F.filter(F.array(*cuts), lambda x: x.isNotNull()))).alias("key"))
    if small:
        no, yes = cascade(blocked, keys.select("key")), cascade(allowed, keys.select("key"))
        hit = keys.withColumn("action", F.when(member(no, F.col("key")), "block").when(member(yes, F.col("key")), "allow")).where("action IS NOT NULL")
    else:
        both = blocked.select("key", F.lit("block").alias("action")).unionByName(allowed.select("key", F.lit("allow").alias("action")))
        hit = keys.join(both, "key")
    hit = hit.groupBy("_row").agg(F.max(F.struct(order(F.col("key")).alias("o"), "key", "action")).alias("_hit"))
    rows = rows.join(hit, "_row", "left")
    return rows.select(F.col("_id").alias(id_col), F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_hit.key").alias("rule"), F.coalesce("_hit.action", F.lit(otherwise)).alias("verdict"))
