"""Row and inner-index orders that lower the number of tiles, never accepted where they don't.

An order is a table ``perm`` (axis, old_id, new_id), axis being "row" or "inner". A coarse order comes from a
breadth-first traversal of the graph of rows and inner indices, all components level by level side by side; a fine
order packs similar ids inside small windows. Exact tile counts decide whether each is taken.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import WORD_STEP, bit, degree_bucket, div, mixed, panel_sketches, popcount, signed, soft_bucket
from ..functions.ordering import Tables, numbered, settled
from . import blocks
from .graph import LOCAL_LINKS, components, labels
from .matrix import Matrix
from .product import PLUS_TIMES, Semiring, multiply, product_count, right_operand
from .tiles import DENSE, tiles, totals

#: Window and group of ids and extent of the opposite panels, by axis; rounds of the traversal.
WINDOW, GROUP, PANEL = {"row": 32, "inner": 16}, {"row": 8, "inner": 4}, {"row": 4, "inner": 8}
LEVEL_BUDGET = 2048
VARIANTS = ("full", "coarse", "fine", "coarse-row", "coarse-inner", "unguarded")


def identity(a: Matrix) -> DataFrame:
    spark = a.df.sparkSession
    one = lambda axis, n: spark.range(n).select(F.lit(axis).alias("axis"), F.col("id").alias("old_id"), F.col("id").alias("new_id"))
    return one("row", a.m).unionByName(one("inner", a.n))


def reversal(a: Matrix) -> DataFrame:
    last = F.when(F.col("axis") == "row", F.lit(a.m - 1)).otherwise(F.lit(a.n - 1))
    return identity(a).withColumn("new_id", last - F.col("old_id"))


def by_degree(a: Matrix) -> DataFrame:
    """Each axis by rising number of entries, then id; ids without entries last."""
    v = vertices(a).withColumn("_none", F.col("degree") == 0)
    rows = numbered(v.where(F.col("vid") < a.m), ["_none", "degree", "vid"], "new_id").select(F.lit("row").alias("axis"), F.col("vid").alias("old_id"), "new_id")
    inner = numbered(v.where(F.col("vid") >= a.m), ["_none", "degree", "vid"], "new_id").select(F.lit("inner").alias("axis"), (F.col("vid") - a.m).alias("old_id"), "new_id")
    return rows.unionByName(inner)


def inverse(perm: DataFrame) -> DataFrame:
    return perm.select("axis", F.col("new_id").alias("old_id"), F.col("old_id").alias("new_id"))


def axis(perm: DataFrame, name: str, old: str, new: str) -> DataFrame:
    return perm.where(F.col("axis") == name).select(F.col("old_id").alias(old), F.col("new_id").alias(new))


def apply(a: Matrix, perm: DataFrame, rows: bool = True, inner: bool = True) -> Matrix:
    """P_r A P_k^T: both axes renamed, entries kept one by one."""
    df = a.df
    if rows:
        df = df.join(axis(perm, "row", "i", "_i"), "i").select(F.col("_i").alias("i"), "k", "v")
    if inner:
        df = df.join(axis(perm, "inner", "k", "_k"), "k").select("i", F.col("_k").alias("k"), "v")
    return Matrix(df, a.m, a.n)


def apply_inner_to_rows(b: Matrix, perm: DataFrame) -> Matrix:
    """P_k B: the right operand's rows follow the left one's inner index."""
    return Matrix(b.df.join(axis(perm, "inner", "i", "_i"), "i").select(F.col("_i").alias("i"), "k", "v"), b.m, b.n)


#: Ids of an axis whose order is broadcast at most.
BROADCAST_IDS = 1 << 20


def restore_rows(c: Matrix, perm: DataFrame, active_rows: int | None = None, left: Matrix | None = None) -> Matrix:
    """C with its rows back in the old order; entries at or beyond ``active_rows`` are an error.

    The rows are those of the left operand ``left``, where given, so that C isn't computed to look at them.
    """
    back = axis(perm, "row", "_old", "i")
    rows = (left or c).df.select("i").distinct()
    if active_rows is not None and not rows.where(F.col("i") >= active_rows).isEmpty():
        raise ValueError("entries beyond the active rows")
    if not rows.join(back, "i", "left_anti").isEmpty():
        raise ValueError("rows outside the order")
    back = F.broadcast(back) if c.m <= BROADCAST_IDS else back
    return Matrix(c.df.join(back, "i").select(F.col("_old").alias("i"), "k", "v"), c.m, c.n)


def bijective(perm: DataFrame, name: str, size: int) -> bool:
    r = perm.where(F.col("axis") == name).agg(*(f(c) for c in ("old_id", "new_id") for f in (F.count, F.count_distinct, F.min, F.max))).first()
    return (size == 0 and r[0] == 0) or tuple(r) == (size, size, 0, size - 1) * 2


def active(a: Matrix, perm: DataFrame) -> DataFrame:
    """axis, active: the shortest prefix of new ids that holds all entries."""
    return prefix(apply(a, perm))


def prefix(a: Matrix) -> DataFrame:
    """axis, active: the shortest prefix of ids that holds all entries."""
    ends = a.df.agg(F.max("i").alias("row"), F.max("k").alias("inner"))
    return ends.select(F.explode(F.array(*(F.struct(F.lit(x).alias("axis"), (F.coalesce(x, F.lit(-1)) + 1).alias("active")) for x in ("row", "inner")))).alias("s")).select("s.*")


def summary(perm: DataFrame) -> DataFrame:
    """axis, moved, displacement."""
    return perm.groupBy("axis").agg(F.count(F.when(F.col("old_id") != F.col("new_id"), 1)).alias("moved"), F.sum(F.abs(F.col("new_id") - F.col("old_id"))).alias("displacement"))


def vertices(a: Matrix) -> DataFrame:
    """vid, degree: rows 0..m-1, inner indices m..m+n-1; entries, duplicates counted."""
    spark = a.df.sparkSession
    counts = a.row_counts().select(F.col("i").alias("vid"), "entries").unionByName(a.column_counts().select((F.col("k") + a.m).alias("vid"), "entries"))
    return spark.range(a.m + a.n).select(F.col("id").alias("vid")).join(counts, "vid", "left").select("vid", F.coalesce("entries", F.lit(0)).alias("degree"))


def seeds(a: Matrix) -> DataFrame:
    """vid, degree, rank: those with entries first, then by degree and id."""
    return numbered(vertices(a).withColumn("_none", F.col("degree") == 0), ["_none", "degree", "vid"], "rank").drop("_none")


@dataclass(frozen=True)
class Links:
    """A matrix as a graph, in tables of its own: links (i, k: vertices i and m + k; n entries) dealt by ranges of i, and
    degrees (vid, degree, linked: whether any link is known at both ends).
    """

    tables: Tables
    links: DataFrame
    degrees: DataFrame

    @classmethod
    def of(cls, a: Matrix) -> Links:
        spark = a.df.sparkSession
        parts, tables = int(spark.conf.get("spark.sql.shuffle.partitions")), Tables(spark)
        every = a.df.groupBy("i", (F.col("k") + a.m).alias("k")).agg(F.count(F.lit(1)).alias("n"))
        every = tables.put("links", every.repartitionByRange(parts, "i"))
        side = lambda own, other: every.where(F.col(own).isNotNull()).groupBy(F.col(own).alias("vid")).agg(F.sum("n").alias("degree"), F.max(F.col(other).isNotNull()).alias("linked"))
        degrees = tables.put("degrees", side("i", "k").unionByName(side("k", "i")))
        return cls(tables, every.where("i IS NOT NULL AND k IS NOT NULL"), degrees)


def order_of(seed: Column, degree: Column, vertices: int) -> Column:
    """A number by which seeds are ordered as by degree, then id."""
    return degree * F.lit(vertices) + seed


def levels_from(here: np.ndarray, component: np.ndarray, seen: np.ndarray, first: np.ndarray, degree: np.ndarray, to: np.ndarray, bucket: np.ndarray, level: int, budget: int):
    """Vertices of the levels after ``level``, whose vertices are ``here`` in their order, and their level, up to ``budget``.

    Links of vertex x lead ``to``, with the ``bucket`` there, from ``first``[x] on. ``component`` and ``seen`` are filled.
    """
    while len(here) and level < budget:
        level += 1
        own = np.repeat(np.arange(len(here)), degree[here])
        link = np.arange(len(own)) + np.repeat(first[here] - np.cumsum(degree[here]) + degree[here], degree[here])
        new = ~seen[to[link]]
        own, link = own[new], link[new]
        next_, at = np.unique(to[link], return_index=True)  # the first link to a vertex is that of its earliest parent
        by = np.lexsort((next_, bucket[link[at]], own[at]))
        next_ = next_[by]
        component[next_], seen[next_] = component[here[own[at[by]]]], True
        yield next_, level
        here = next_


def level_table(ids: np.ndarray, component: np.ndarray, parts: list[tuple[np.ndarray, int]]) -> pa.Table:
    """vid, component, place, level of vertices (places in ``ids``) level by level."""
    at = np.concatenate([np.zeros(0, np.int64), *(x for x, _ in parts)])
    place = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(x)) for x, _ in parts)])
    level = np.repeat(np.array([n for _, n in parts], np.int64), [len(x) for x, _ in parts])
    return pa.table({n: pa.array(x, pa.int64()) for n, x in zip(("vid", "component", "place", "level"), (ids[at], component[at], place, level), strict=True)})


def expanded(start: pa.Table, links: pa.Table, level: int, budget: int) -> pa.Table:
    """vid, component, place, level of the levels after ``level`` that a gathered graph has, up to ``budget``.

    ``start`` (vid, component, place) is the level itself; ``links`` (src, dst, bucket) lead to vertices not reached yet.
    """
    column = lambda t, c: t.column(c).to_numpy()
    begin, src, dst, bucket = column(start, "vid"), column(links, "src"), column(links, "dst"), column(links, "bucket")
    ids = np.unique(np.concatenate([begin, src, dst]))
    order = np.argsort(src, kind="stable")
    first = np.searchsorted(src[order], ids)
    degree = np.diff(np.append(first, len(src)))
    component, seen = np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
    here = np.searchsorted(ids, begin)
    component[here], seen[here] = column(start, "component"), True
    here = here[np.argsort(column(start, "place"), kind="stable")]
    return level_table(ids, component, list(levels_from(here, component, seen, first, degree, np.searchsorted(ids, dst)[order], bucket[order], level, budget)))


def walked(members: pa.Table, links: pa.Table, vertices: int, budget: int) -> pa.Table:
    """vid, component, place, level of the whole components that a task has, from their seeds on, up to level ``budget``.

    ``members`` (vid, degree) are their vertices, ``links`` (i, k) lead both ways.
    """
    ids, degree = (members.column(c).to_numpy() for c in ("vid", "degree"))
    by = np.argsort(ids)
    ids, degree = ids[by], degree[by]
    i, k = (np.searchsorted(ids, links.column(c).to_numpy()) for c in ("i", "k"))
    if not len(i):
        return level_table(ids, ids, [])
    joined, label = labels(i, k)  # every member has a link
    ranked = joined[np.lexsort((joined, degree[joined]))]
    own = np.zeros(len(ids), np.int64)
    own[joined] = label
    seeds_ = ranked[np.unique(own[ranked], return_index=True)[1]]
    seeds_ = seeds_[np.lexsort((seeds_, degree[seeds_]))]
    component, seen = np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
    component[seeds_], seen[seeds_] = degree[seeds_] * vertices + ids[seeds_], True
    src, to = np.concatenate([i, k]), np.concatenate([k, i])
    order = np.argsort(src, kind="stable")
    count = np.bincount(src, minlength=len(ids))
    bucket = np.where(degree <= 1, 0, np.minimum(np.frexp(degree.astype(np.float64))[1] - 1, 7))
    to = to[order]
    return level_table(ids, component, [(seeds_, 0), *levels_from(seeds_, component, seen, np.cumsum(count) - count, count, to, bucket[to], 0, budget)])


LEVEL = "vid long, component long, place long, level long"


def in_tasks(left: DataFrame, links: DataFrame, run: Callable, parts: int = 1) -> DataFrame:
    """What ``run`` (of its rows in ``left`` and ``links``) makes of each ``part``, many levels a task."""
    # a number of its own, since few bytes would put all parts into one task
    n = max(int(links.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(2 * parts, 1024))
    left, links = left.repartition(n, "part"), links.repartition(n, "part")
    return left.groupBy("part").cogroup(links.groupBy("part")).applyInArrow(run, LEVEL)


def level_by_level(start: DataFrame, held: Links, name: str, total: int, budget: int, local: int) -> DataFrame:
    """vid, component, place, level from ``start`` on, one level a step, until ``local`` links (both ways) at most lead on; the
    rest in a task. ``total``: links both ways that may be met.

    Each level is written once; places follow its order with gaps. Rows and inner indices alternate, so a level can only
    meet the one before the last.
    """
    tables, links, spark = held.tables, held.links, start.sparkSession
    degrees = held.degrees.select(F.col("vid").alias("dst"), "degree")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    here = tables.put(f"{name}/level=0", start.select("vid", "component", "place"))
    level, left, rest, before = 0, total, None, None
    every = lambda: spark.read.schema(LEVEL).parquet(f"{tables.path}/{name}")
    while level < budget:
        count, ahead = here.join(held.degrees, "vid").agg(F.count(F.lit(1)), F.coalesce(F.sum("degree"), F.lit(0))).first()
        if not count:
            break
        if left <= local:
            reached = every().select("vid")
            both = links.select(F.col("i").alias("src"), F.col("k").alias("dst")).unionByName(links.select(F.col("k").alias("src"), F.col("i").alias("dst")))
            both = both.join(reached.toDF("dst"), "dst", "left_anti").join(degrees, "dst").select(F.lit(0).alias("part"), "src", "dst", degree_bucket("degree").alias("bucket"))
            at = level
            rest = in_tasks(here.withColumn("part", F.lit(0)), both, lambda x, y: expanded(x, y, at, budget))
            break
        left -= ahead
        sides = [links.join(here.select(F.col("vid").alias(x), "component", "place"), x).select(F.col(y).alias("dst"), "component", "place") for x, y in (("i", "k"), ("k", "i"))]
        new = sides[0].unionByName(sides[1])
        if before is not None:
            new = new.join(before.select(F.col("vid").alias("dst")), "dst", "left_anti")
        new = new.groupBy("dst", "component").agg(F.min("place").alias("_p")).join(degrees, "dst")
        keys = ["_p", degree_bucket("degree"), "dst"]
        new = new.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
        level += 1
        before, here = here, tables.put(f"{name}/level={level}", new.select(F.col("dst").alias("vid"), "component", F.monotonically_increasing_id().alias("place")))
    return every().unionByName(rest) if rest is not None else every()


def longs(spark: SparkSession, names: tuple[str, ...], rows: list[tuple]) -> DataFrame:
    """A few rows of the driver's."""
    return spark.createDataFrame(pa.table({n: pa.array([r[c] for r in rows], pa.int64()) for c, n in enumerate(names)}))


#: Rounds that are taken component after component without knowing all of them first.
FEW_ROUNDS = 16


def one_by_one(held: Links, vertices: int, total: int, budget: int, local: int) -> DataFrame:
    """vid, component, place, level of what ``budget`` rounds reach: each component from its seed on, then the next one."""
    left, reached, number = budget, None, 0
    while left > 0:
        open_ = held.degrees.where("linked") if reached is None else held.degrees.where("linked").join(reached.select("vid"), "vid", "left_anti")
        seed = open_.agg(F.min(F.struct("degree", "vid")).alias("s")).select("s.*").first()
        if seed is None or seed["vid"] is None:
            break
        own = seed["degree"] * vertices + seed["vid"]
        start = longs(held.degrees.sparkSession, ("vid", "component", "place"), [(seed["vid"], own, own)])
        found = held.tables.put(f"found{number}", level_by_level(start, held, f"walk{number}", total, left, local))
        left -= found.agg(F.max("level")).first()[0] + 1
        reached, number = found if reached is None else reached.unionByName(found), number + 1
    return reached if reached is not None else held.degrees.sparkSession.createDataFrame([], LEVEL)


def traversal(a: Matrix, budget: int = LEVEL_BUDGET, local: int = LOCAL_LINKS, held: Links | None = None) -> tuple[DataFrame, int, int]:
    """vid, component, level, place of the vertices with entries that the rounds reach; components; rounds.

    Components start at their seed, the vertex of the least degree, then id, in that order; ``component`` is a number that
    orders them so. A vertex belongs to its earliest parent of the level before; parents emit theirs by degree bucket and
    id. One round expands one level of one component; at ``budget`` rounds the traversal stops, so no more components than
    that are looked at.

    Components of up to ``local`` links (both ways) are gathered, as many to a task as have a quarter of that together, and
    expanded there level after level. Larger ones take a step a level until no more links than that are left of them.
    """
    held, vertices = held or Links.of(a), a.m + a.n
    tables, links, degrees = held.tables, held.links, held.degrees
    total = 2 * links.count()
    walk = lambda x, y: walked(x, y, vertices, budget)
    if total <= local:
        one = F.lit(0).alias("part")
        reached = in_tasks(degrees.where("linked").select(one, "vid", "degree"), links.select(one, "i", "k"), walk)
    elif budget <= FEW_ROUNDS:
        reached = one_by_one(held, vertices, total, budget, local)
    else:
        label = tables.put("label", components(links.select(F.col("i").alias("src"), F.col("k").alias("dst")), local, dealt=True).join(degrees, "vid").select("vid", "label", "degree"))
        seeds_ = label.groupBy("label").agg(F.min(F.struct("degree", "vid")).alias("s"), F.sum("degree").alias("links"))
        seeds_ = seeds_.select("label", F.col("s.vid").alias("vid"), order_of(F.col("s.vid"), F.col("s.degree"), vertices).alias("component"), "links").orderBy("component").limit(budget).collect()
        part, before = [], 0
        for s in seeds_:
            if s["links"] <= local:
                part.append((s["label"], before // max(1, local // 4)))
                before += s["links"]
        spark = links.sparkSession
        small = F.broadcast(longs(spark, ("label", "part"), part))
        members = tables.put("members", label.join(small, "label").select("part", "vid", "degree"))
        mine = links.join(members.toDF("_part", "i", "_degree"), "i").select(F.col("_part").alias("part"), "i", "k")
        reached = in_tasks(members, mine, walk, len({p for _, p in part}))
        large = [(s["vid"], s["component"], s["component"]) for s in seeds_ if s["links"] > local]
        if large:
            start = longs(spark, ("vid", "component", "place"), large)
            reached = reached.unionByName(level_by_level(start, held, "walk", sum(s["links"] for s in seeds_ if s["links"] > local), budget, local))
    reached = tables.put("reached", reached)
    depth = reached.groupBy("component").agg((F.max("level") + 1).alias("depth")).orderBy("component").limit(budget).collect()
    starts, used = [], 0
    for d in depth:
        if used < budget:
            starts.append((d["component"], used))
        used += d["depth"]
    start = F.broadcast(longs(reached.sparkSession, ("component", "_start"), starts))
    seen = reached.join(start, "component").where(F.col("_start") + F.col("level") <= budget)
    return seen.select("vid", "component", "level", "place"), len(starts), min(used, budget)


def residual(a: Matrix, budget: int = LEVEL_BUDGET) -> DataFrame:
    """vid of the vertices with entries that the traversal doesn't reach within its rounds."""
    held = Links.of(a)
    return held.degrees.select("vid").join(traversal(a, budget, held=held)[0].select("vid"), "vid", "left_anti")


def coarse(a: Matrix, budget: int = LEVEL_BUDGET) -> tuple[DataFrame, int, int]:
    """The proposal: the traversal, then unreached vertices by falling seed rank, all reversed, axes apart, empty ids last."""
    held = Links.of(a)
    seen, components, rounds = traversal(a, budget, held=held)
    every = a.df.sparkSession.range(a.m + a.n).select(F.col("id").alias("vid")).join(held.degrees.select("vid", "degree"), "vid", "left").join(seen, "vid", "left")
    none, late, zero = F.col("degree").isNull(), F.col("component").isNull(), F.lit(0).cast("long")
    # reversed: late ones first, by rising degree and id, then the traversal from its end
    back = [F.coalesce(-F.col(c), zero).alias(c[0]) for c in ("component", "level", "place")]
    keys = ["inner", "none", "on_time", "d", "c", "l", "p", "vid"]
    every = every.select("vid", (F.col("vid") >= a.m).alias("inner"), none.alias("none"), (~late).alias("on_time"), F.when(late & ~none, F.col("degree")).otherwise(zero).alias("d"), *back)
    placed = numbered(every, keys, "new_id").select(F.when(F.col("inner"), "inner").otherwise("row").alias("axis"), "inner", "vid", "new_id")
    placed = placed.select("axis", *((F.col(x) - F.when(F.col("inner"), a.m).otherwise(0)).alias(y) for x, y in (("vid", "old_id"), ("new_id", "new_id"))))
    placed = held.tables.put("order", placed)
    held.tables.drop("links", "degrees", "label", "members", "reached")
    return placed, components, rounds


def held_tiles(a: Matrix) -> int:
    return a.df.select(div("i", 8), div("k", 4)).distinct().count()


def tile_count(a: Matrix, perm: DataFrame) -> int:
    return held_tiles(apply(a, perm))


def profiles(a: Matrix, perm: DataFrame, name: str) -> DataFrame:
    """id, degree, soft_bucket, panel_occupancy, panel_min, panel_max, panel_span, f0, f1, h0, h1, place of each id of an axis.

    Panels are those of the other axis under ``perm``. f0 and f1 are fingerprint words, h0 and h1 minima of unsigned
    sketch hashes (null without entries).
    """
    own, other, step = ("i", "k", PANEL["row"]) if name == "row" else ("k", "i", PANEL["inner"])
    panels = a.df.join(axis(perm, "inner" if name == "row" else "row", other, "_new"), other).select(F.col(own).alias("id"), div("_new", step).alias("panel"))
    marks = panel_sketches(panels.select("panel").distinct())
    # unsigned order of the hashes: their order with the top bit turned
    turn = lambda c: F.col(c).bitwiseXOR(F.lit(-(1 << 63)))
    seen = panels.join(marks, "panel").groupBy("id").agg(F.count(F.lit(1)).alias("degree"), F.min("panel").alias("panel_min"), F.max("panel").alias("panel_max"), F.bit_or(bit(F.col("b0"))).alias("f0"), F.bit_or(bit(F.col("b1"))).alias("f1"), F.min(turn("h0")).alias("h0"), F.min(turn("h1")).alias("h1"))
    ids = axis(perm, name, "id", "place").join(seen, "id", "left")
    zero = lambda c, z: F.coalesce(c, F.lit(z).cast("long")).alias(c)
    out = ids.select("id", "place", zero("degree", 0), zero("panel_min", -1), zero("panel_max", -1), zero("f0", 0), zero("f1", 0), turn("h0").alias("h0"), turn("h1").alias("h1"))
    return out.withColumn("soft_bucket", soft_bucket("degree")).withColumn("panel_occupancy", popcount("f0") + popcount("f1")).withColumn("panel_span", F.when(F.col("degree") == 0, 0).otherwise(F.col("panel_max") - F.col("panel_min") + 1))


def least(keys: list[np.ndarray], among: np.ndarray) -> np.ndarray:
    """For each row the place of the least of those ``among`` by the keys in turn; the last key tells all apart."""
    for key in keys:
        largest = np.iinfo(key.dtype).max
        low = np.where(among, key, largest).min(axis=1, keepdims=True)
        among = among & (key == low)
    return among.argmax(axis=1)


def packed_windows(cols: dict[str, np.ndarray], there: np.ndarray, group: int) -> np.ndarray:
    """Ids of many windows in packed order, a row each; ``there`` says which places of a row hold an id.

    Each group starts with the best anchor left: not empty, then high bucket, many panels, low first panel, short span,
    high degree, low fingerprint words, low id. It is filled with what fits the group best: near the anchor's bucket,
    few new fingerprint bits, a large overlap of the union, a large overlap, little growth of the span, near the
    anchor's degree, low id.
    """
    rows = np.arange(len(there))
    f0, f1 = cols["f0"].view(np.uint64), cols["f1"].view(np.uint64)
    degree, bucket, low, high, ids = (cols[c] for c in ("degree", "soft_bucket", "panel_min", "panel_max", "id"))
    anchor = [(degree == 0).astype(np.int8), -bucket, -cols["panel_occupancy"], low, cols["panel_span"], -degree, f0, f1, ids]
    left, out = there.copy(), np.full(there.shape, -1, np.int64)
    bits = lambda x, y: np.bitwise_count(x).astype(np.int64) + np.bitwise_count(y)
    span = lambda lo, hi: np.where(lo < 0, 0, hi - lo + 1)
    for place in range(there.shape[1]):
        some = left.any(axis=1)
        if place % group == 0:
            best = least(anchor, left)
            lead, own0, own1, lo, hi = best, f0[rows, best], f1[rows, best], low[rows, best], high[rows, best]
        else:
            a0, a1, lo_, hi_ = own0[:, None], own1[:, None], lo[:, None], hi[:, None]
            shared, union = bits(a0 & f0, a1 & f1), np.maximum(1, bits(a0 | f0, a1 | f1))
            wide_lo = np.where(low < 0, lo_, np.where(lo_ < 0, low, np.minimum(lo_, low)))
            wide_hi = np.where(low < 0, hi_, np.maximum(hi_, high))
            # shares of at most 128 bits differ by more than one part in 2**20 where they differ
            fit = [np.abs(bucket[rows, lead][:, None] - bucket), bits(f0 & ~a0, f1 & ~a1), -((shared << 20) // union), -shared, span(wide_lo, wide_hi) - span(lo_, hi_), np.abs(degree[rows, lead][:, None] - degree), ids]
            best = least(fit, left)
            own0, own1 = np.where(some, own0 | f0[rows, best], own0), np.where(some, own1 | f1[rows, best], own1)
            lo, hi = wide_lo[rows, best], wide_hi[rows, best]
        out[some, place] = ids[rows, best][some]
        left[rows, best] &= ~some
    return out


PROFILE = ("id", "degree", "soft_bucket", "panel_occupancy", "panel_min", "panel_max", "panel_span", "f0", "f1")


def packing(a: Matrix, perm: DataFrame, name: str) -> DataFrame:
    """old_id, new_id: the proposal of the fine pass; no id leaves its window. A batch's windows are packed side by side."""
    width, group = WINDOW[name], GROUP[name]

    def run(batches):
        for b in batches:
            held = b.column("ids")
            size = held.value_lengths().to_numpy()
            row = np.repeat(np.arange(len(size)), size)
            at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            cols = {c: np.zeros((len(size), width), np.int64) for c in PROFILE}
            there = np.zeros((len(size), width), bool)
            there[row, at] = True
            for c, x in zip(PROFILE, held.flatten().flatten(), strict=True):
                cols[c][row, at] = x.to_numpy()
            packed = packed_windows(cols, there, group)
            win, place = np.nonzero(packed >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(packed[win, place]), pa.array(b.column("win").to_numpy()[win] * width + place)], names=["old_id", "new_id"])

    ids = F.collect_list(F.struct(*(F.col(c).cast("long").alias(c) for c in PROFILE))).alias("ids")  # a window's, so few
    return profiles(a, perm, name).groupBy(div("place", width).alias("win")).agg(ids).mapInArrow(run, "old_id long, new_id long")


def window_costs(a: Matrix, current: DataFrame, proposal: DataFrame, name: str) -> DataFrame:
    """win, t0, f0, t1, f1, accepted: tiles and fan-out of each window now and as proposed (old_id, new_id of this axis)."""
    own, other = ("i", "k") if name == "row" else ("k", "i")
    width, group, step = WINDOW[name], GROUP[name], PANEL[name]
    now = axis(current, name, own, "p0")
    then = proposal.select(F.col("old_id").alias(own), F.col("new_id").alias("p1"))
    base = a.df.select("i", "k").join(axis(current, "inner" if name == "row" else "row", other, "_o"), other).join(now, own).join(then, own)
    keys = base.select(div("p0", width).alias("win"), div("_o", step).alias("opp"), F.explode(F.array(F.struct(F.lit(0).alias("state"), F.col("p0").alias("p")), F.struct(F.lit(1).alias("state"), F.col("p1").alias("p")))).alias("s"))
    keys = keys.select("win", "opp", "s.state", div(F.pmod(F.col("s.p"), F.lit(width)), group).alias("grp")).distinct()
    groups = keys.groupBy("win", "state", "grp").agg(F.count(F.lit(1)).alias("t"), (F.max("opp") - F.min("opp") + 1).alias("f"))
    sums = groups.groupBy("win").agg(*(F.coalesce(F.sum(F.when(F.col("state") == s, F.col(c))), F.lit(0)).alias(f"{c}{s}") for s in (0, 1) for c in ("t", "f")))
    return sums.withColumn("accepted", (F.col("t1") < F.col("t0")) | ((F.col("t1") == F.col("t0")) & (F.col("f1") < F.col("f0"))))


#: Rows of windows that a task packs at once, about; entries of one id up to which its windows are packed that way.
PACKED, MOST_OF_ONE = 1 << 18, 1 << 22
#: Kinds of rows that a pass leaves: ids with their new place, entries with their new places, figures of windows.
IDS, ENTRIES, COSTS, FANS = range(4)


def grouped_profiles(own: np.ndarray, panel: np.ndarray, n: int) -> dict[str, np.ndarray]:
    """The profile (without id) of places 0 to n - 1, from the places of entries and their panels."""
    by = np.argsort(own, kind="stable")
    at, panel = own[by], panel[by]
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1])[: len(at)])
    out = {c: np.zeros(n, np.int64) for c in PROFILE if c != "id"}
    out["degree"], held = np.bincount(own, minlength=n), at[first]
    out["panel_min"] -= 1
    out["panel_max"] -= 1
    if len(first):
        out["panel_min"][held], out["panel_max"][held] = np.minimum.reduceat(panel, first), np.maximum.reduceat(panel, first)
        for word in (0, 1):
            bits = np.int64(1) << (mixed(panel + np.int64(signed(word * WORD_STEP))) & 63)
            out[f"f{word}"][held] = np.bitwise_or.reduceat(bits, first)
    some = out["degree"] > 0
    out["soft_bucket"] = np.where(some, (np.frexp(out["degree"].astype(np.float64))[1] - 1) // 2, -1).astype(np.int64)
    out["panel_occupancy"] = (np.bitwise_count(out["f0"].view(np.uint64)).astype(np.int64) + np.bitwise_count(out["f1"].view(np.uint64))).astype(np.int64)
    out["panel_span"] = np.where(some, out["panel_max"] - out["panel_min"] + 1, 0)
    return out


def costs_of(place: np.ndarray, panel: np.ndarray, group: int, per: int, windows: int) -> tuple[np.ndarray, np.ndarray]:
    """Tiles and fan-out of windows of ``per`` groups, from the places of entries and their panels."""
    if not len(place):
        return np.zeros(windows, np.int64), np.zeros(windows, np.int64)
    wide = np.int64(panel.max() + 1)
    key = np.unique(place // group * wide + panel)
    own, panel = key // wide, key % wide
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    last = np.append(first[1:], len(own)) - 1
    win = own[first] // per
    add = lambda x: np.bincount(win, x, minlength=windows).astype(np.int64)
    return add(last - first + 1), add(panel[last] - panel[first] + 1)


def packed_batch(rows: pa.Table, width: int, group: int, step: int, free: bool) -> pa.Table:
    """kind, x, y of a batch of whole windows, from rows p, x: an id (as -1 - id) at a place, or an entry's other place."""
    p, x = (rows.column(c).to_numpy() for c in ("p", "x"))
    low = p.min() // width * width
    is_id = x < 0
    ids = np.full(int(p.max()) - low + 1, -1, np.int64)
    ids[p[is_id] - low] = -1 - x[is_id]
    own, other = p[~is_id] - low, x[~is_id]
    n, windows = len(ids), -(-len(ids) // width)
    cols = grouped_profiles(own, other // step, n) | {"id": ids}
    wide = lambda c: np.append(c, np.zeros(windows * width - n, np.int64)).reshape(windows, width)
    cols = {c: wide(v) for c, v in cols.items()}
    there = wide((ids >= 0).astype(np.int64)).astype(bool)
    packed = packed_windows(cols, there, group)
    win, place = np.nonzero(packed >= 0)
    by = np.argsort(ids)
    then = np.arange(n)
    then[by[np.searchsorted(ids[by], packed[win, place])]] = win * width + place
    per = width // group
    (t0, f0), (t1, f1) = (costs_of(at[own], other // step, group, per, windows) for at in (np.arange(n), then))
    taken = (t0 > 0) & (free | (t1 < t0) | ((t1 == t0) & (f1 < f0)))
    at = np.where(np.repeat(taken, width)[:n], then, np.arange(n)) + low
    held = ids >= 0
    figures = [(COSTS, taken.sum(), (t0 - t1)[taken].sum()), (FANS, f0.sum(), np.where(taken, f1, f0).sum())]
    kind = np.repeat([IDS, ENTRIES, *(f[0] for f in figures)], [held.sum(), len(own), *(1 for _ in figures)])
    first = np.concatenate([ids[held], at[own], [f[1] for f in figures]])
    second = np.concatenate([at[held], other, [f[2] for f in figures]])
    return pa.table({"kind": pa.array(kind, pa.int32()), "x": pa.array(first, pa.int64()), "y": pa.array(second, pa.int64())})


def packed_axis(entries: DataFrame, order: DataFrame, rows: int, name: str, free: bool) -> DataFrame:
    """kind, x, y: what the fine pass makes of an axis whose entries (i, k) are in the current order (old_id, new_id of it).

    A window's profiles, proposal and costs need its own entries alone, so whole windows go to a task once, and entries leave
    it with their new places. ``rows``: of both.
    """
    width, group, step = WINDOW[name], GROUP[name], PANEL[name]
    own, other = ("i", "k") if name == "row" else ("k", "i")
    both = entries.select(F.col(own).alias("p"), F.col(other).alias("x")).unionByName(order.select(F.col("new_id").alias("p"), (F.lit(-1) - F.col("old_id")).alias("x")))
    spark = entries.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // (1 << 22)))
    windows = max(1, order.count() // width)
    per = max(1, min(4096, PACKED * windows // max(1, rows)))
    both = both.withColumn("batch", div("p", width * per)).repartition(n, "batch")
    return both.groupBy("batch").applyInArrow(lambda t: packed_batch(t, width, group, step, free), "kind int, x long, y long")


@dataclass
class Plan:
    algorithm: str
    perm: DataFrame
    stats: dict = field(default_factory=dict)

    def table(self) -> DataFrame:
        """key, value; null where nothing was measured."""
        return self.perm.sparkSession.createDataFrame([(k, None if v is None else str(v)) for k, v in self.stats.items()], "key string, value string")


def finished(a: Matrix, algorithm: str, perm: DataFrame, stats: dict, moved: Matrix | None = None) -> Plan:
    """The plan with its figures; ``moved`` is the matrix under the order, where it is there already."""
    moved = moved or apply(a, perm)
    ends = {r["axis"]: r["active"] for r in prefix(moved).collect()}
    t = totals(tiles(moved, dense=DENSE)).first()
    moved = {r["axis"]: (r["moved"], r["displacement"]) for r in summary(perm).collect()}
    names = ("accepted_row_windows", "accepted_inner_windows", "row_tile_reduction", "inner_tile_reduction", "row_fanout_before", "row_fanout_after", "inner_fanout_before", "inner_fanout_after", "coarse_components", "coarse_levels")
    out = {"algorithm": algorithm, "sweeps": 1, "row_window": WINDOW["row"], "inner_window": WINDOW["inner"], "active_rows": ends["row"], "active_inner": ends["inner"]}
    out |= {"moved_rows": moved.get("row", (0, 0))[0], "moved_inner": moved.get("inner", (0, 0))[0], "row_displacement_sum": moved.get("row", (0, 0))[1], "inner_displacement_sum": moved.get("inner", (0, 0))[1]}
    out |= {n: stats.get(n, 0) for n in names} | {"coarse_level_budget": stats.get("coarse_level_budget", LEVEL_BUDGET), "coarse_candidate_accepted": int(stats.get("coarse_candidate_accepted", 0)), "coarse_tile_reduction": stats.get("coarse_tile_reduction", 0)}
    out |= {"coarse_ms": stats.get("coarse_ms", 0.0), "fine_ms": stats.get("fine_ms", 0.0), "reorder_peak_workspace_bytes": None, "num_tiles": t["tiles"], "active_row_tiles": -(-ends["row"] // 8), "active_k_tiles": -(-ends["inner"] // 4), "sparse_tiles": t["tiles"] - t["dense_tiles"], "dense_tiles": t["dense_tiles"], "payload": t["payload"]}
    return Plan(algorithm, perm, out)


def plan(a: Matrix, variant: str = "full", budget: int = LEVEL_BUDGET) -> Plan:
    """Coarse order, then rows, then inner indices inside windows; each step is taken only where it is no worse.

    Variants leave steps out; "unguarded" takes every proposal. Entries are kept under the order so far.
    """
    if variant not in VARIANTS:
        raise ValueError(f"no variant {variant}")
    tables = Tables(a.df.sparkSession)
    keep = lambda name, df: Matrix(tables.put(name, df.select("i", "k", F.lit(1.0).alias("v"))), a.m, a.n)
    a = keep("entries", a.df.where("i IS NOT NULL AND k IS NOT NULL"))
    free, current, moved, stats = variant == "unguarded", identity(a), a, {"coarse_level_budget": budget}
    before, started = held_tiles(a), time.monotonic()
    if variant != "fine":
        proposal, stats["coarse_components"], stats["coarse_levels"] = coarse(a, budget)
        proposed = keep("proposed", apply(a, proposal).df)
        after = held_tiles(proposed)
        if free or after < before:
            stats |= {"coarse_candidate_accepted": 1, "coarse_tile_reduction": before - after}
            current, moved = proposal, proposed
        stats["coarse_ms"] = round(1000 * (time.monotonic() - started), 3)
    started = time.monotonic()
    for name in ("row", "inner"):
        if variant in ("coarse", f"coarse-{'inner' if name == 'row' else 'row'}"):
            continue
        mine, s = fine(a, moved, current, name, free, tables)
        stats |= {f"accepted_{name}_windows": s[0], f"{name}_tile_reduction": s[1], f"{name}_fanout_before": s[2], f"{name}_fanout_after": s[3]}
        current = current.where(F.col("axis") != name).unionByName(mine[0])
        moved = mine[1] or keep(f"moved-{name}", apply(a, current).df)
    if variant != "coarse":
        stats["fine_ms"] = round(1000 * (time.monotonic() - started), 3)
    current = tables.put("order", current)
    made = finished(a, "coarse-fine" if variant == "full" else f"coarse-fine-{variant}", current, stats, moved)
    tables.drop("entries", "proposed", "row", "inner", "moved-row", "moved-inner")
    return made


def fine(a: Matrix, moved: Matrix, current: DataFrame, name: str, free: bool, tables: Tables) -> tuple[tuple[DataFrame, Matrix | None], tuple]:
    """An axis after its fine pass, and the entries then, if they are there; accepted windows, tiles won, fan-out before and after.

    Where one id has more than MOST_OF_ONE entries, profiles and costs are aggregates, so no task has all of them.
    """
    own = "i" if name == "row" else "k"
    sums = moved.df.groupBy(own).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    order = current.where(F.col("axis") == name)
    if sums[0] <= MOST_OF_ONE:
        made = tables.put(name, packed_axis(moved.df, order, sums[1] + (a.m if name == "row" else a.n), name, free))
        s = {r["kind"]: r[1:] for r in made.where(F.col("kind") >= COSTS).groupBy("kind").agg(F.sum("x"), F.sum("y")).collect()}
        mine = made.where(F.col("kind") == IDS).select(F.lit(name).alias("axis"), F.col("x").alias("old_id"), F.col("y").alias("new_id"))
        to = {"i": "x", "k": "y"} if name == "row" else {"i": "y", "k": "x"}
        entries = made.where(F.col("kind") == ENTRIES).select(*(F.col(c).alias(n) for n, c in to.items()), F.lit(1.0).alias("v"))
        return (mine, Matrix(entries, a.m, a.n)), (*s.get(COSTS, (0, 0)), *s.get(FANS, (0, 0)))
    current = settled(current)
    proposal = settled(packing(a, current, name))
    costs = settled(window_costs(a, current, proposal, name).withColumn("accepted", F.lit(True) if free else F.col("accepted")))
    s = costs.agg(F.count(F.when(F.col("accepted"), 1)), *(F.coalesce(F.sum(x), F.lit(0)) for x in (F.when(F.col("accepted"), F.col("t0") - F.col("t1")), F.col("f0"), F.when(F.col("accepted"), F.col("f1")).otherwise(F.col("f0"))))).first()
    taken = costs.where("accepted").select("win")
    mine = axis(current, name, "old_id", "p0").withColumn("win", div("p0", WINDOW[name])).join(taken.withColumn("_taken", F.lit(True)), "win", "left").join(proposal, "old_id")
    mine = mine.select(F.lit(name).alias("axis"), "old_id", F.when(F.col("_taken"), F.col("new_id")).otherwise(F.col("p0")).alias("new_id"))
    return (settled(mine), None), tuple(s)


def identity_plan(a: Matrix) -> Plan:
    return finished(a, "identity_baseline", settled(identity(a)), {})


def external_plan(a: Matrix, perm: DataFrame, name: str) -> Plan:
    """An order from elsewhere; it must be a bijection on both axes."""
    if not (bijective(perm, "row", a.m) and bijective(perm, "inner", a.n)):
        raise ValueError("the order is no bijection")
    return finished(a, f"external:{name}", settled(perm), {})


def cut(a: Matrix, rows: int | None = None, inner: int | None = None) -> Matrix:
    """The part of a matrix before these ids on its axes, as a smaller matrix; entries beyond are left out."""
    m, n = a.m if rows is None else min(rows, a.m), a.n if inner is None else min(inner, a.n)
    keep = F.lit(True)
    for c, size, whole in (("i", m, a.m), ("k", n, a.n)):
        if size < whole:
            keep &= F.col(c) < size
    return Matrix(a.df.where(keep), m, n)


def operands(a: Matrix, b: Matrix, made: Plan) -> tuple[Matrix, Matrix]:
    """Both operands under the plan's order, cut at its active prefix: no tile row or inner tile beyond it exists, and rows
    of B that no entry of A asks for are gone before they are sent anywhere.
    """
    rows, inner = made.stats["active_rows"], made.stats["active_inner"]
    return cut(apply(a, made.perm), rows, inner), cut(apply_inner_to_rows(b, made.perm), inner)


def multiply_reordered(a: Matrix, mode: str = "aat", b: Matrix | None = None, made: Plan | None = None) -> tuple[Matrix, Plan]:
    """C = A B through an order: both operands renamed and cut, multiplied, and C's rows put back. Without a plan, one is made."""
    right, made = right_operand(a, mode, b), made or plan(a)
    left, right = operands(a, right, made)
    c = multiply(left, "ab", right)
    return restore_rows(Matrix(c.df, a.m, c.n), made.perm, made.stats["active_rows"], left), made


@dataclass
class Prepared:
    """A left operand under its plan, written once in buckets of the inner index, for products with ever new B."""

    table: str
    m: int
    n: int
    made: Plan
    buckets: int

    def multiply(self, b: Matrix, semiring: Semiring = PLUS_TIMES) -> Matrix:
        """C = A B. B is dealt by its rows to A's buckets; A isn't sent anywhere."""
        if b.m != self.n:
            raise ValueError("the inner dimensions differ")
        left = self.made.perm.sparkSession.table(self.table)
        right = cut(apply_inner_to_rows(b, self.made.perm), self.made.stats["active_inner"]).df.select(F.col("i").alias("_k"), F.col("k").alias("j"), F.col("v").alias("w"))
        met = left.join(right.repartition(self.buckets, "_k").hint("merge"), left["k"] == F.col("_k"))
        pairs = product_count(Matrix(left, self.m, self.n), Matrix(right.select(F.col("_k").alias("i"), F.col("j").alias("k"), F.col("w").alias("v")), self.n, b.n)).first()[0]
        c = blocks.added(met.select("i", "j", semiring.times(F.col("v"), F.col("w")).alias("v")), semiring, blocks.Grid.of(self.m, b.n, pairs), blocks.triples, "i long, j long, v double")
        return restore_rows(Matrix(c.select("i", F.col("j").alias("k"), "v"), self.m, b.n), self.made.perm, self.made.stats["active_rows"], Matrix(left, self.m, self.n))


def prepare(a: Matrix, made: Plan, table: str, path: str, buckets: int | None = None) -> Prepared:
    """Write A under the plan to ``table`` (its files in ``path``), bucketed and sorted by the inner index.

    The order itself is settled with the plan. The number of buckets is that of shuffle partitions unless given.
    """
    n = buckets or int(a.df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    moved = cut(apply(a, made.perm), made.stats["active_rows"], made.stats["active_inner"])
    moved.df.select("i", "k", "v").repartition(n, "k").write.mode("overwrite").option("path", path).bucketBy(n, "k").sortBy("k").saveAsTable(table)
    return Prepared(table, a.m, a.n, made, n)
