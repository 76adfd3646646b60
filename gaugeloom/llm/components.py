"""Connected components of a link table, by contraction within parts, then alternating star contractions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import batches as B
from .common import keep

MOST_ROUNDS = 60
#: Links that a task contracts within itself, about 16 bytes each before Python's own.
LOCAL = 500_000


def _contract(batches):
    """Of the links of a part: each node with the smallest it can reach within the part."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y] if up[y] != y else y
        return x

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            a, b = find(u), find(v)
            if a != b:
                up[max(a, b)] = min(a, b)
    nodes = np.array([x for x in up if find(x) != x], np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(np.array([find(x) for x in nodes.tolist()], np.int64))], ["u", "v"])


def _stars(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each linked node can reach; nodes are bigints.

    The links are dealt at random over parts of about LOCAL, counted first, and each part is contracted to stars within a
    task.  One part is all there is to do.  Of several parts' stars, each round links every node's larger neighbours, then its smaller ones, to the smallest of
    them.  Rounds grow with the logarithm of the longest path; each is written to the shared folder.
    Only whether something changed reaches the driver.  Nodes without a link are not in the result.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges = keep(edges, "links")
    parts = max(1, -(-edges.count() // LOCAL))
    edges = keep(edges.repartition(parts).mapInArrow(B.giving_back(_contract), "u bigint, v bigint"), "stars")
    if parts == 1:
        return _stars(edges)
    edges = edges.distinct()
    for _ in range(MOST_ROUNDS):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small_least.select("u", F.col("m").alias("v"))).distinct()
        after = keep(small, "links")
        # a star forest has one neighbour per node, and no neighbour is itself linked to a smaller one
        unsettled = after.groupBy("u").agg(F.min("v").alias("v"), F.count("*").alias("n"))
        centres = unsettled.join(after.select(F.col("v").alias("c")).distinct(), F.col("u") == F.col("c"), "left")
        done = centres.where("n > 1 OR c IS NOT NULL").isEmpty()
        edges = after
        if done:
            return _stars(edges)
    raise RuntimeError("components did not settle")
