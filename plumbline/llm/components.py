"""Connected components of a large graph, by alternating star contractions.

Each round makes every node point at the smallest node near it ("large star": larger neighbours are linked
to the smallest neighbour; "small star": a node and its smaller neighbours are linked to the smallest of
them). Rounds end when the edges are stars. Both steps are a grouped minimum and a join, so that a node
with very many neighbours is pre-aggregated before the shuffle and its join rows can be split by adaptive
execution; nothing is collected but one count and one sum a round.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.text import written


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index of each node's component, for the links a[i] - b[i] among nodes 0..n-1."""
    label = np.arange(n)
    if not len(a):
        return label
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while not np.array_equal(label, up := label[label]):
            label = up
        if np.array_equal(label, before):
            return label


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """edges: (u, v), u > v. Large star looks at all neighbours of a node, small star at the smaller ones."""
    seen = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if larger else edges
    least = seen.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = seen.join(least, "u")
    if larger:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges: (u long, v long), any direction, repeats and loops allowed, no nulls.
    Returns (node long, component long) for every node with a link to another; component is the smallest node.
    No edges: no rows."""
    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    if now.isEmpty():
        return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    before = None
    while True:
        now = written(_star(_star(now, True), False))
        # a star has each node under one centre: as many edges as nodes below, and no centre is below another
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    centres = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(centres)
