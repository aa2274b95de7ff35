"""Shared pieces of the training-data operators: lineage cuts, guarded broadcasts, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space; ``bytes.split()`` cuts at the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"

#: Largest estimated size of a side that is sent to every executor; above it the join shuffles.
BROADCAST_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only in a local session, where they are one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tallyspark-")
        spark.sparkContext.setCheckpointDir(folder)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and return the written table.

    The written table has no lineage, so a lost executor never repeats the work above it.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/tallyspark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a written table for broadcast if its counted rows fit ``limit`` bytes, else leave the shuffle join."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a long, b long)`` as ``(node, component)``; component is the smallest node.

    Alternating large-star and small-star rounds over a written edge table. Minima are aggregated with partial sums
    and written, then joined back: broadcast below the size limit, else by a shuffle of two written tables, in which
    adaptive execution splits a star's centre over tasks. No neighbour list is ever gathered in one task. Nulls and
    self-links are ignored; an empty input gives an empty result.
    """
    canon = lambda e: e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = cut(canon(edges.select(F.col("a").cast("long").alias("u"), F.col("b").cast("long").alias("v"))))
    while not _stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m")))
        large = both.where("v > u").join(small(low, 16), F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = cut(large.distinct())
        low = cut(large.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m")))
        pairs = large.join(small(low, 16), F.col("u") == F.col("c"))
        ends = F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
        now = cut(pairs.select(ends.alias("e")).select("e.*").where("u <> v").distinct())
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one edge to a smaller one, which has none: then the edges are the components."""
    roles = edges.select(F.col("u").alias("n"), F.lit(1).alias("down"), F.lit(0).alias("top")).unionByName(edges.select(F.col("v").alias("n"), F.lit(0).alias("down"), F.lit(1).alias("top")))
    per = roles.groupBy("n").agg(F.sum("down").alias("down"), F.max("top").alias("top"))
    return not per.where("down > 1 OR (down > 0 AND top > 0)").limit(1).count()


def local_forest(n: int, chunks) -> "numpy.ndarray":  # noqa: F821
    """Labels of ``n`` local nodes after uniting every ``(i, j)`` index pair of ``chunks``; the label is the smallest index."""
    import numpy as np

    label = np.arange(n)
    for i, j in chunks:
        while True:
            a, b = label[i], label[j]
            keep = a != b
            if not keep.any():
                break
            i, j, a, b = i[keep], j[keep], a[keep], b[keep]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            label = _flat(label)
    return label


def _flat(label):
    while True:
        up = label[label]
        if (up == label).all():
            return label
        label = up


def spanning_pairs(n: int, chunks):
    """Of the ``(i, j, cost)`` index pairs of ``chunks`` those of a spanning forest, cheap pairs of a chunk first.

    Returns ``(i, j)`` arrays. Every pair returned is one of the pairs given, and every pair given joins two nodes that
    the returned ones connect.
    """
    import numpy as np

    label, taken = np.arange(n), []
    for i, j, cost in chunks:
        while True:
            a, b = label[i], label[j]
            keep = a != b
            if not keep.any():
                break
            i, j, cost, a, b = i[keep], j[keep], cost[keep], a[keep], b[keep]
            high = np.maximum(a, b)
            order = np.lexsort((cost, high))
            first = order[np.r_[True, high[order][1:] != high[order][:-1]]]  # each root is hung up once
            taken.append((i[first], j[first]))
            label[high[first]] = np.minimum(a, b)[first]
            label = _flat(label)
    return tuple(np.concatenate(x) for x in zip(*taken, strict=True)) if taken else (np.zeros(0, np.int64),) * 2
