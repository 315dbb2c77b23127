"""Connected components by alternating stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import Tables, settled

#: Links up to which a graph, or what is left of one, is gathered to one task.
LOCAL_LINKS = 1 << 22
#: Links of a partition that become stars at once.
STRETCH = 1 << 22


def labels(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vertices of links, and the least vertex of each one's component: roots hook onto lesser roots, paths halve."""
    ids, both = np.unique(np.concatenate([src, dst]), return_inverse=True)
    s, d = both[: len(src)], both[len(src) :]
    label = np.arange(len(ids))
    while True:
        now, least = label.copy(), np.minimum(label[s], label[d])
        np.minimum.at(now, label[s], least)
        np.minimum.at(now, label[d], least)
        while (now[now] != now).any():
            now = now[now]
        if (now == label).all():
            return ids, ids[label]
        label = now


def gathered(links: pa.Table) -> pa.Table:
    ids, label = labels(links.column("src").to_numpy(), links.column("dst").to_numpy())
    return pa.table({"vid": ids, "label": label})


def forests(chunks):
    """Links of a partition (src, dst) as stars: some at a time, each vertex with the least one that they connect it to."""
    held, n = [], 0

    def flush():
        ids, label = labels(*(np.concatenate([b.column(c).to_numpy() for b in held]) for c in range(2)))
        other = ids != label
        return pa.RecordBatch.from_arrays([pa.array(ids[other]), pa.array(label[other])], names=["src", "dst"])

    for b in chunks:
        held, n = [*held, b] if len(b) else held, n + len(b)
        if n >= STRETCH:
            yield flush()
            held, n = [], 0
    if held:
        yield flush()


def components(links: DataFrame, local: int = LOCAL_LINKS, dealt: bool = False) -> DataFrame:
    """vid, label (the least vertex of its component) of every vertex in ``links`` (src, dst, longs).

    Up to ``local`` links one task does it. Of more, neighbouring links become stars within their partition first (as the
    partitions are, where they are ``dealt`` already). What is left to connect are centres of stars that share a vertex:
    where these are few, they are the next graph, else :func:`rounds` goes on.
    """
    n = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links = links.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    links = links if dealt else links.repartitionByRange(n, "dst")
    tables = Tables(links.sparkSession)
    stars = tables.put("stars", links.mapInArrow(forests, "src long, dst long"))
    count = stars.count()
    if count <= local:
        return stars.withColumn("part", F.lit(0)).groupBy("part").applyInArrow(gathered, "vid long, label long")
    every = stars.unionByName(stars.select(F.col("dst").alias("src"), "dst").distinct())
    # a vertex is at most once in the stars of a partition's stretch, so its centres are few
    chained = tables.put("chained", every.distinct().withColumn("_before", F.lag("dst").over(Window.partitionBy("src").orderBy("dst"))))
    tops = tables.put("tops", chained.where("_before IS NOT NULL").select(F.col("dst").alias("src"), F.col("_before").alias("dst")).distinct())
    if 2 * tops.count() > count:
        return rounds(stars)
    label = components(tops, local).select(F.col("vid").alias("_top"), "label")
    least = chained.where("_before IS NULL")
    return least.join(label, least["dst"] == label["_top"], "left").select(F.col("src").alias("vid"), F.coalesce("label", "dst").alias("label"))


def rounds(links: DataFrame) -> DataFrame:
    """The same by alternating stars, in rounds whose number grows with the logarithm of the components' sizes. Neighbours
    are never gathered: a vertex's least neighbour is an aggregate.
    """
    before = None
    while True:
        both = links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("_m"))
        large = both.where("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("_m").alias("dst")).where("src <> dst").distinct()
        least = large.groupBy("src").agg(F.min("dst").alias("_m"))
        small = large.join(least, "src").select(F.col("dst").alias("src"), F.col("_m").alias("dst")).unionByName(least.select("src", F.col("_m").alias("dst")))
        links = settled(small.where("src <> dst").distinct())
        now = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("src", "dst"))).first()
        if now == before:
            break
        before = now
    roots = links.select(F.col("dst").alias("vid"), F.col("dst").alias("label")).distinct()
    return links.select(F.col("src").alias("vid"), F.col("dst").alias("label")).unionByName(roots)
