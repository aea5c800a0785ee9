"""Connected components of an edge table: contraction inside partitions, then rounds of joins across them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Edges that a task contracts.
EDGES = 1 << 19


def forest(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node joined with it) of the edges given: rounds of taking the least label around and its label's label."""
    nodes, at = np.unique(np.concatenate((x, y)), return_inverse=True)
    a, b = at[: len(x)], at[len(x) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def contracted(edges: DataFrame, parts: int) -> DataFrame:
    """edges(x, y) as (node, label) stars of each of a few partitions; copies of an edge drop out on the way."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y, size = [], [], 0

        def held() -> tuple[np.ndarray, np.ndarray]:
            return forest(np.concatenate(x), np.concatenate(y)) if x else (np.empty(0, np.int64), np.empty(0, np.int64))

        for b in batches:
            x.append(b.column(0).to_numpy(zero_copy_only=False))
            y.append(b.column(1).to_numpy(zero_copy_only=False))
            size += b.num_rows
            if size > 2 * EDGES:
                n, label = held()
                x, y, size = [n], [label], 0
        n, label = held()
        for a in range(0, len(n), 1 << 16):
            z = slice(a, a + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(n[z], pa.int64()), pa.array(label[z], pa.int64())], names=["node", "label"])

    return edges.select("x", "y").coalesce(parts).mapInArrow(run, "node long, label long")


def components(edges: DataFrame) -> DataFrame:
    """edges(x, y) to (node, label): the least node of its component, for every node of an edge. edges should be a written table.

    Partitions are contracted to stars first. With one there is nothing to join; else each round gives a node the least
    label around it and then its label's label, so long chains halve, until no label changes. Nothing but counts comes to the driver.
    """
    parts = max(1, edges.count() // EDGES)
    stars = cut(contracted(edges, parts))
    if parts == 1:
        return stars
    both = stars.where("node <> label").select(F.col("node").alias("x"), F.col("label").alias("y"))
    both = cut(both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    labels = cut(stars.groupBy("node").agg(F.min("label").alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("y"), "label"), "y").groupBy(F.col("x").alias("node")).agg(F.min("label").alias("near"))
        low = labels.join(near, "node", "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
        # A label is a node, too: follow it once.
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = cut(low.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label")))
        changed = new.where("label <> old").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels
