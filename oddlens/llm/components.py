"""Connected components of a table of links: parts of the links are contracted in their tasks, then alternating large and small stars join the parts."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddlens.llm.common import freed_rows, lookup, written

#: Links that a task contracts: 16 bytes each.
PART = 500_000

#: With more links than this, a node may have many neighbours, and its rows are dealt by salt.
MANY = 50_000


def _star(edges: DataFrame, large: bool, many: bool) -> DataFrame:
    """edges (u, v), u > v, distinct. large: every node's larger neighbours go to its least one; small: the smaller ones do, and the node itself."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    if many:
        least = written(least, "least")
    to = lookup(both, least, "u") if many else both.join(least.hint("merge"), "u")
    if large:
        out = to.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = to.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return written(out.where("u != v").distinct(), "star")


def least_of_parts(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some links and the least node that each reaches by them."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v = np.split(at.reshape(-1), 2)
    root = np.arange(len(nodes))
    while True:
        a, b = root[u], root[v]
        if np.array_equal(a, b):
            return nodes, nodes[root]
        # a root goes to the least root that a link joins it with, and then nodes to the root of their root
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(root, up := root[root]):
            root = up


def _contracted(edges: DataFrame, n: int) -> DataFrame:
    """n edges (u, v), dealt evenly to tasks, each of which replaces its own by a star around the least node of each of their parts."""

    def stars(batches):
        held = [b for b in batches if len(b)]
        if held:
            nodes, least = least_of_parts(*(np.concatenate([b[c].to_numpy(np.int64) for b in held]) for c in ("u", "v")))
            yield pd.DataFrame({"u": nodes, "v": least})[nodes != least]

    return edges.repartition(math.ceil(n / PART)).mapInPandas(freed_rows(stars), "u bigint, v bigint")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """links (a, b): rows (node, component) with the least node of each component; nodes without links are left out."""
    high, low = F.greatest(a, b), F.least(a, b)
    edges = written(links.where(F.col(a) != F.col(b)).select(high.alias("u"), low.alias("v")).distinct(), "edges")
    n = edges.count()
    if n:
        edges = written(_contracted(edges, n).distinct() if n > PART else _contracted(edges, n), "contracted")
    mark = None
    while n > PART:  # one part is done
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
        edges = _star(_star(edges, True, now[0] > MANY), False, now[0] > MANY)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
