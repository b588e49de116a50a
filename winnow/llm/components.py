"""Connected components of a graph of links, by alternating stars.

A large-star step links every larger neighbour of a node to the smallest one; a
small-star step links the smaller neighbours, and the node, to the smallest.
Components don't change, and in a few rounds every node hangs on the smallest of
its component (Kiveris et al., 2014).  A hub's neighbours are only ever reduced by
a minimum, which is pre-aggregated, and joined with it so that adaptive execution can
split a hub.  A graph of at most ``ONE_TASK`` links (16 bytes each) is done in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared, split_join

#: Links that one task takes; with more, all is done by shuffles.
ONE_TASK = 1_000_000


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links (u, v); each v in turn is linked to the smallest of u's neighbours and u itself."""
    if large:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = split_join(both, least, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def _union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) from all links of a small graph: labels fall to the least neighbour's, then to that one's, until none does."""
    links = [np.stack([b.column("u").to_numpy(), b.column("v").to_numpy()]) for b in batches]
    names, ends = np.unique(np.concatenate([np.zeros((2, 0), np.int64), *links], axis=1), return_inverse=True)
    u, v = ends.reshape(2, -1)
    root = np.arange(len(names))
    while np.any(root[u] != root[v]):
        low = np.minimum(root[u], root[v])
        np.minimum.at(root, root[u], low)
        np.minimum.at(root, root[v], low)
        while np.any(root[root] != root):
            root = root[root]
    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(names[root])], ["node", "root"])


def components(links: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(node, root): for each node with a link to another, the smallest node of its component.

    ``links`` has columns u and v; order, repeats and links of a node to itself don't
    matter.  Lineage is cut in each round, and only a count and a sum reach the driver.
    """
    now = shared(links.select("u", "v").filter("u <> v").distinct())
    if now.count() <= one_task:
        return now.coalesce(1).mapInArrow(_union, "node bigint, root bigint")
    mark = None
    while True:
        now = shared(_star(_star(now, True), False))
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark or not seen[0]:
            break
        mark = seen
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
