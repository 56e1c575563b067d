"""Connected components of a graph given as a table of links, by alternating large-star and small-star rounds.

Before the first round, the links of each Arrow batch are contracted: each node of the batch is linked to the least
node that the batch alone connects it with, so that several links between a node and one group become one. Components
stay as they are, and a batch is bounded, so no task holds more than that.
Every round is two group-bys and two joins on node keys, whose skewed sides adaptive execution splits; its table of
links is written to the shared folder. Links shrink towards stars, in a number of rounds about the logarithm of the
longest chain, and end once they are stars, by one group-by. Nothing but its answer reaches the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import mapped, written


def contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, least node of its component) with the components of the links given; loops vanish."""
    names, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    parent = list(range(len(names)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for i, j in zip(ends[: len(a)].tolist(), ends[len(a) :].tolist()):
        i, j = root(i), root(j)
        parent[max(i, j)] = min(i, j)
    least = np.fromiter(map(root, range(len(names))), np.int64, len(names))
    moved = least != np.arange(len(names))
    return names[moved], names[least[moved]]


def _contract(batches):
    for batch in batches:
        a, b = contracted(batch.column("a").to_numpy(), batch.column("b").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links has (u, v) with u > v. Large: every neighbour above a node goes to the least of all; small: those below."""
    if large:
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).filter("u > v")


def _settled(links: DataFrame) -> bool:
    """Whether every node is the upper end of one link at most, and then the lower end of none: stars around their least nodes."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("upper")).union(links.select("v", F.lit(0)))
    held = ends.groupBy("node").agg(F.sum("upper").alias("upper"), F.count(F.lit(1)).alias("links"))
    return held.filter("upper > 0 AND links > 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """links (a, b long; loops, repeats and either direction allowed) -> (node, root).

    root is the smallest node of the component; nodes without a link do not appear."""
    links = mapped(links.select("a", "b"), _contract, "a long, b long")
    held = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct()
    held = written(held, "links")
    while not _settled(held):
        held = written(_star(_star(held, large=True).distinct(), large=False).distinct(), "links")
    return held.select(F.col("u").alias("node"), F.col("v").alias("root")).union(held.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
