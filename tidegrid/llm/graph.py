"""Connected components, in one task for few edges, over edges that stay distributed for more."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Edges that one task may hold together, some 32 MB; with more, the edges stay distributed.
TOGETHER = 1 << 21


def labels_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges, ascending, and of each the smallest node that it reaches: larger roots go under smaller
    ones, and paths are shortened to the roots after each round."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, root = ends[: len(a)], ends[len(a) :], np.arange(len(nodes))
    while len(x):
        x, y = root[x], root[y]
        apart = x != y
        x, y = x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    return nodes, nodes[root]


def together(edges: DataFrame) -> DataFrame:
    """As ``components``, in one task; for at most ``TOGETHER`` edges."""
    kind = edges.schema["a"].dataType.simpleString()

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(x.column(0), x.column(1)) for x in batches if x.num_rows]
        if parts:
            nodes, least = labels_of(*(pa.chunked_array(x).to_numpy() for x in zip(*parts, strict=True)))
            for at in range(0, len(nodes), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 100_000], parts[0][0].type) for x in (nodes, least)], names=["node", "comp"])

    return materialise(edges.select("a", "b").coalesce(1).mapInArrow(solve, f"node {kind}, comp {kind}"))


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of the edges (a, b): the smallest node that can be reached.

    Up to ``TOGETHER`` edges, as counted, are solved in one task: rounds of joins would cost far more in tasks, files and
    the driver's memory than the edges themselves.  More stay distributed.  Each round takes the smallest label among a node's neighbours and then the label of that label, so the rounds grow
    with the logarithm of the longest path.  Labels are summed up by key before they move; nothing is collected.
    """
    edges = materialise(edges.select("a", "b"))
    if edges.count() <= TOGETHER:
        return together(edges)
    both = materialise(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = materialise(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("comp")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("comp").alias("low"))
        step = labels.join(near, labels["node"] == near["a"], "left").select("node", F.col("comp").alias("old"), F.least("comp", F.coalesce("low", "comp")).alias("comp"))
        jump = step.select(F.col("node").alias("root"), F.col("comp").alias("further"))
        moved = materialise(step.join(jump, F.col("comp") == F.col("root"), "left").select("node", "old", F.least("comp", F.coalesce("further", "comp")).alias("comp")))
        labels = moved.select("node", "comp")
        if moved.where("comp <> old").isEmpty():
            return labels
