"""Connected components of an edge table by rounds of joins and grouped minima."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perfgrid.llm.common import table
from perfgrid.session import cut


def reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node reachable) of a bounded number of edges."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[u], root[v])
        before = root.copy()
        np.minimum.at(root, root[u], low)
        np.minimum.at(root, root[v], low)
        root = root[root]
        if (root == before).all():
            return nodes, nodes[root]


def _one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cols = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches]
    if cols:
        nodes, least = reachable(*(np.concatenate(c) for c in zip(*cols)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(least)], ["node", "component"])


def components(edges: DataFrame, few: int = 500_000) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of an edge (a, b).

    A table that was counted to have at most ``few`` edges (8 MB) is settled in one task; a longer one in rounds.

    Large-star and small-star rounds: each node's neighbours are hung on the smallest one.
    The number of rounds grows with the logarithm of the longest path. Minima are taken
    map-side first and joined back, so that a node with very many neighbours is one row of
    the aggregate and its edges stay spread. Nothing is collected but two totals a round.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    e = cut(e)
    if e.count() <= few:
        return cut(e.coalesce(1).mapInArrow(_one_task, "node long, component long"))
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u")
        small = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        e = cut(small.filter("u <> v").distinct())
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def with_components(nodes: DataFrame, key: str, edges: DataFrame) -> DataFrame:
    """Adds ``component_id`` to rows with a unique ``key``; nodes without an edge are their own."""
    comp = components(edges).select(F.col("node").alias(key), F.col("component").alias("component_id"))
    return nodes.join(comp, key, "left").withColumn("component_id", F.coalesce("component_id", key))
