"""Connected components of a graph of links, by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import drop, shuffle_partitions, written


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) of a local graph given by its links, without the smallest nodes themselves."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inverse[: len(a)], inverse[len(a) :]
    label = np.arange(len(nodes))
    while len(x):
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        while not np.array_equal(up := label[label], label):
            label = up
        open_ = label[x] != label[y]
        x, y = x[open_], y[open_]
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _with_least(e: DataFrame) -> DataFrame:
    """(u, v, m): the links of e with the least v of each u. A node of very many links is dealt out by v: least by (u, part of v) first,
    then by u, and the links meet their own part's row."""
    salted = e.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(max(64, shuffle_partitions(e.sparkSession)))))
    parts = salted.groupBy("u", "part").agg(F.min("v").alias("least"))
    return salted.join(parts.select("u", "part").join(parts.groupBy("u").agg(F.min("least").alias("m")), "u"), ["u", "part"]).drop("part")


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has a link to another node; component is the smallest node reachable.

    Each round writes the links to the shared folder; the driver sees only their number and a checksum. A node with very many
    links is never gathered: see _with_least().
    """
    e = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    (e, path), before = written(e, "links"), None
    while True:
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            break
        before = state
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).where("u != v").distinct()
        large, middle = written(large, "stars")
        small = _with_least(large)
        small = small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.where("v = m").select("u", "v"))
        gone = (path, middle)
        e, path = written(small.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars")
        for x in gone:
            drop(links.sparkSession, x)
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
