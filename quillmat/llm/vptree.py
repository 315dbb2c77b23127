"""Nearest neighbours by inner product: a vantage-point tree for each shard of the vectors.

Vectors get one more component so that all have the largest norm; the largest inner product is then the smallest
Euclidean distance, for which the triangle inequality holds. A leaf of a tree is left out where its distance bound
times ``relax`` exceeds the k-th best distance so far: 1 is exact search, more visits fewer leaves and may miss some.

Trees are built where their shard is, one row each. Stretches of trees meet stretches of query blocks, both of bounded
bytes: a task takes each of its blocks through its trees, so the best found so far prune the trees after, and k rows a
query leave it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

#: Vectors of a shard and of a leaf, and queries of a block.
SHARD, LEAF, BLOCK = 8192, 128, 512
#: Bytes of the trees and of the query blocks that a task holds, about; one of each at least.
TREES, BLOCKS = 1 << 25, 1 << 24


def build(x: np.ndarray, top: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the vectors, leaf ends, and a row per inner node: place of its vantage point, then the bounds.

    Nodes are in heap order: children of i are 2i+1 (inside, with bounds [0:2]) and 2i+2 (outside, bounds [2:4]).
    """
    wide = np.column_stack([x, np.sqrt(np.maximum(0, top * top - (x * x).sum(axis=1)))])
    groups, nodes = [np.arange(len(x))], []
    while len(groups[0]) > LEAF:
        below = []
        for g in groups:
            mean = wide[g].mean(axis=0)
            v = g[np.argmax(((wide[g] - mean) ** 2).sum(axis=1))]
            d = np.sqrt(((wide[g] - wide[v]) ** 2).sum(axis=1))
            o = np.argsort(d, kind="stable")
            half = (len(g) + 1) // 2
            near, far = o[:half], o[half:]
            nodes.append((v, d[near[0]], d[near[-1]], d[far[0]], d[far[-1]]))
            below += [g[near], g[far]]
        groups = below
    order = np.concatenate(groups)
    place = np.empty(len(x), np.int64)
    place[order] = np.arange(len(x))
    table = np.array([(place[v], *b) for v, *b in nodes], np.float64).reshape(-1, 5)
    return order, np.cumsum([len(g) for g in groups]), table


def search(x: np.ndarray, ids: np.ndarray, ends: np.ndarray, nodes: np.ndarray, top: float, q: np.ndarray, own: np.ndarray, k: int, relax: float, best: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """(scores, ids) of the k best of a tree for each query, -inf where there are fewer; and the leaf visits.

    ``best``: scores and ids from other trees, which take part and prune this one.
    """
    m = len(q)
    norm = (q * q).sum(axis=1) + top * top
    low = np.zeros((m, 1))
    if len(nodes):
        d = np.sqrt(np.maximum(0, norm[:, None] - 2 * q @ x[nodes[:, 0].astype(np.int64)].T))
        at = 0
        while at < len(nodes):
            n = low.shape[1]
            here, b = d[:, at : at + n], nodes[at : at + n]
            inside = np.maximum(low, np.maximum(here - b[:, 2], b[:, 1] - here))
            outside = np.maximum(low, np.maximum(here - b[:, 4], b[:, 3] - here))
            low = np.stack([inside, outside], axis=2).reshape(m, 2 * n)
            at += n
    starts = np.concatenate([[0], ends[:-1]])
    scores, found = best or (np.full((m, k), -np.inf), np.full((m, k), np.iinfo(np.int64).max))
    slack, visits = 1e-9 * (1 + top * np.sqrt(norm)), 0

    def visit(leaf: int, who: np.ndarray) -> None:
        rows = slice(starts[leaf], ends[leaf])
        near = q[who] @ x[rows].T
        a, b = np.nonzero((near >= (scores[who, -1] - slack[who])[:, None]) & (ids[rows] != own[who][:, None]))
        new = np.full(near.shape, -np.inf)
        new[a, b] = (q[who[a]] * x[rows][b]).sum(axis=1)  # the same sum for equal vectors, unlike a matrix product
        both = np.concatenate([scores[who], new], axis=1)
        names = np.concatenate([found[who], np.where(new > -np.inf, ids[rows], np.iinfo(np.int64).max)], axis=1)
        top_k = np.lexsort((names, -both), axis=1)[:, :k]
        scores[who], found[who] = np.take_along_axis(both, top_k, 1), np.take_along_axis(names, top_k, 1)

    first, at_once = np.argmin(low, axis=1), 0
    near = low.min(axis=1) * relax <= np.sqrt(np.maximum(0, norm - 2 * scores[:, -1])) + slack
    for leaf in np.unique(first[near]).tolist():
        who = np.flatnonzero(near & (first == leaf))
        at_once += len(who)
        visit(leaf, who)
    for leaf in np.argsort(low.sum(axis=0), kind="stable").tolist():
        worst = np.sqrt(np.maximum(0, norm - 2 * scores[:, -1]))
        who = np.flatnonzero((first != leaf) & ~(low[:, leaf] * relax > worst + slack))
        visits += len(who)
        if len(who):
            visit(leaf, who)
    return scores, found, visits + at_once


def usable(vector: Column) -> Column:
    """Not null, not zero, no null or non-finite component."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda c: c != 0), F.lit(False))


def packed(df: DataFrame, key: str, top: float | None) -> DataFrame:
    """A row per key with its vectors: ids, vectors and, where ``top`` is given, their tree."""

    def run(group: pa.Table) -> pa.Table:
        ids, x = group["id"].to_numpy(), group["v"].combine_chunks()
        x = x.flatten().to_numpy().reshape(len(ids), -1).astype(np.float64)
        if top is None:
            parts = [ids.tobytes(), x.tobytes(), b"", b""]
        else:
            order, ends, nodes = build(x, top)
            parts = [ids[order].tobytes(), x[order].tobytes(), ends.astype(np.int64).tobytes(), nodes.tobytes()]
        return pa.table({key: pa.array([group[key][0].as_py()], pa.int64()), "size": pa.array([group["size"][0].as_py()], pa.int64()), **{c: pa.array([p], pa.binary()) for c, p in zip(("ids", "x", "ends", "nodes"), parts, strict=True)}})

    return df.groupBy(key, "size").applyInArrow(run, f"{key} long, size long, ids binary, x binary, ends binary, nodes binary")


def nearest(df: DataFrame, queries: DataFrame, k: int = 20, relax: float = 1.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` vectors of ``df`` with the largest inner product for each row of ``queries``.

    Returns query_id, rank (from 1), vec_id, score, nearest first, ties to the smaller id. Candidates are all rows but
    those with the query's own id; fewer than k are all returned. Vectors that are null, zero or hold null or
    non-finite components take no part, nor do rows without an id; vectors of another length than the query's are no
    candidates for it. Repeated rows are candidates each. Empty tables give no rows; other columns don't matter.
    """
    if relax < 1:
        raise ValueError("relax must be 1 or more")
    pick = lambda d: d.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable(F.col("v"))).withColumn("size", F.size("v").cast("long"))
    base, asked = pick(df), pick(queries)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c))
    n, top, width = base.agg(F.count(F.lit(1)), F.max(norm), F.max("size")).first()
    blocks_of = max(1, -(-asked.count() // BLOCK))
    shards, top = max(1, -(-n // SHARD)), float(top or 0) * (1 + 1e-12)
    deal = lambda d, name, parts: d.withColumn(name, F.pmod(F.xxhash64(F.col("id"), F.col("v")), F.lit(parts)))
    held = [max(1, most // (8 * rows * max(1, width or 0))) for most, rows in ((TREES, SHARD), (BLOCKS, BLOCK))]
    stretch = lambda c, n: F.floor(F.col(c) / n)
    every = lambda parts, n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit((parts - 1) // n).cast("long")))
    trees = scratch.table(packed(deal(base, "shard", shards), "shard", top), "trees").withColumn("_s", stretch("shard", held[0])).withColumn("_b", every(blocks_of, held[1]))
    blocks = packed(deal(asked, "block", blocks_of), "block", None).select("size", "ids", "x", stretch("block", held[1]).alias("_b"), every(shards, held[0]).alias("_s"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        size, out = (left if left.num_rows else right)["size"][0].as_py(), [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        floats = lambda c, n: np.frombuffer(c).reshape(-1, n)
        ints = lambda c: np.frombuffer(c, np.int64)
        forest = [(floats(t["x"], size), ints(t["ids"]), ints(t["ends"]), floats(t["nodes"], 5)) for t in left.to_pylist()]
        for b in right.to_pylist():
            q, q_ids, best = floats(b["x"], size), ints(b["ids"]), None
            for x, ids, ends, nodes in forest:
                best = search(x, ids, ends, nodes, top, q, q_ids, k, relax, best)[:2]
            if best:
                has = best[0] > -np.inf
                out.append((np.repeat(q_ids, has.sum(axis=1)), best[1][has], best[0][has]))
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    found = trees.groupBy("_s", "_b", "size").cogroup(blocks.groupBy("_s", "_b", "size")).applyInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
