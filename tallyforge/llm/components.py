"""Connected components of a graph that is only ever held as a table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import work

#: Links that a task joins by itself, about.
PART = 1 << 18


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of every node with a link; root: the component's smallest node.

    Alternating stars (Kiveris et al., Connected Components in MapReduce and Beyond, 2014): each round first links all
    larger neighbours of a node to its smallest one, then all smaller ones, until every node has one link, to a root.
    Rounds grow with the logarithm of a component's size. The links and each round are written to the shared folder.
    """
    edges = work.written(links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v"), "links")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = work.written(small.where("u <> v").distinct(), "links")
        ends = edges.select(F.inline(F.array(*(F.struct(F.col(c).alias("node"), F.lit(up).alias("up"), F.lit(1 - up).alias("down")) for c, up in (("u", 1), ("v", 0))))))
        if not ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").limit(1).count():
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def least_joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ends of links, ascending, and the smallest node that each is joined with."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        before, low = root.copy(), np.minimum(root[x], root[y])
        for end in (before[x], before[y], x, y):
            np.minimum.at(root, end, low)
        while not np.array_equal(further := root[root], root):
            root = further
        if np.array_equal(root, before):
            return nodes, nodes[root]


def forest(links: DataFrame, a: str, b: str) -> DataFrame:
    """As ``components``, by few queries: every task first joins PART links or so, and only its trees go on to the rounds.

    If there are no more links than that, the one task's trees are the components.
    """
    edges = work.written(links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v"), "links")
    tasks = -(-edges.count() // PART)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches, pa.schema([("u", pa.int64()), ("v", pa.int64())]))
        node, root = least_joined(*(np.asarray(table.column(c).to_numpy(), np.int64) for c in ("u", "v")))
        yield pa.record_batch([pa.array(node), pa.array(root)], ["node", "root"])

    dealt = edges.repartition(tasks, "u") if tasks > 1 else edges.coalesce(1)
    trees = work.written(dealt.mapInArrow(join, "node long, root long"), "trees")
    return components(trees, "node", "root") if tasks > 1 else trees
