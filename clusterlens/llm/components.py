"""Connected components of an edge table.

Edges are dealt to tasks of at most EDGES_PER_TASK; each task replaces its
edges by a forest of stars (node, smallest node it can reach there), which
leaves at most one edge per node and task. When there is more than one task,
rounds of joins finish the work: every node's label falls to the smallest
label of its neighbours and of the nodes that share its label (hooking plus
shortcut), so labels halve distances rather than walk them. Every round is
written to the shared folder; joins on a node or label that holds many rows
are salted (``shared.lookup``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterlens.llm import shared

EDGES_PER_TASK = 500_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node reachable) for every node of the edges."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        for side in (label[x], label[y], x, y):
            np.minimum.at(new, side, low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def _forests(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            if sum(len(a) for a, _ in held) > 2 * EDGES_PER_TASK:
                held = [forest(*map(np.concatenate, zip(*held, strict=True)))]
        if held:
            node, comp = forest(*map(np.concatenate, zip(*held, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(comp)], names=["node", "comp"])

    return edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL").mapInArrow(run, "node long, comp long")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``edges`` (a, b): comp is the smallest
    node reachable. No edges: an empty table. ``edges`` should be a written
    table: it is counted before it is dealt out."""
    tasks = -(-edges.count() // EDGES_PER_TASK)
    stars = shared.written(_forests(edges.coalesce(max(tasks, 1))), "forest")
    if tasks <= 1:
        return stars
    return _rounds(stars.select(F.col("node").alias("a"), F.col("comp").alias("b")))


def _rounds(edges: DataFrame) -> DataFrame:
    both = shared.written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = shared.written(
        both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("comp")), "labels")
    while True:
        near = shared.lookup(both.select(F.col("a").alias("from"), F.col("b").alias("node")), "node", labels, "from",
                             "inner")
        near = near.groupBy(F.col("from").alias("node")).agg(F.min("comp").alias("near"))
        step = labels.join(near, "node").select("node", "comp", F.least("comp", "near").alias("near"))
        best = step.groupBy("comp").agg(F.min("near").alias("best"))
        moved = shared.lookup(step, "comp", best, "node", "inner")
        moved = shared.written(
            moved.select("node", F.least("near", "best").alias("comp"), (F.col("comp") != F.least("near", "best"))
                         .alias("changed")), "labels")
        labels = moved.select("node", "comp")
        if moved.where("changed").isEmpty():
            return labels


def merged(comps: DataFrame, links: DataFrame) -> DataFrame:
    """(node, comp) after further ``links`` (a, b)."""
    return components(comps.select(F.col("node").alias("a"), F.col("comp").alias("b")).union(links.select("a", "b")))
