"""Connected components of a graph given by its links, by alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqspark.llm.shared import stored


def spanning_links(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node linked to it) for the nodes of a part of the links but for the smallest ones themselves."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = np.arange(len(nodes))
    a, b = ends[:len(a)], ends[len(a):]
    while True:  # each node takes the smallest label around it, then its label's label
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while True:
            shorter = label[label]
            if np.array_equal(shorter, label):
                break
            label = shorter
        if np.array_equal(before, label):
            break
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (a, b: long) but the roots, the smallest node of each component.

    Every round is written to the shared folder; a round shuffles by node, and groups are aggregated before the
    shuffle. A hot node's rows meet only in a join, which Spark can split.
    """
    links = stored(links.where("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    last = None
    while True:
        # Large star: each node's larger neighbours go to its smallest neighbour.
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: the neighbours that are smaller go to the smallest.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        links = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        state = links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").bitwiseAND(0xFFFFFFFF))).first()
        if state == last:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        last = state
