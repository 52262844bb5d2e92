"""Connected components, within a task and over a cluster."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written


def local_labels(count: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest node number in the component of each node."""
    label = np.arange(count)
    while True:
        least = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, least)
        np.minimum.at(new, right, least)
        np.minimum.at(new, label[left], least)
        np.minimum.at(new, label[right], least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


class Joined:
    """Components of numbered nodes under links that come in parts; between parts a label a node is kept."""

    def __init__(self, count: int) -> None:
        self.label = np.arange(count)

    def link(self, left: np.ndarray, right: np.ndarray) -> None:
        moved = self.moved()
        left, right = np.append(left, moved), np.append(right, self.label[moved])
        self.label = local_labels(len(self.label), left, right)

    def moved(self) -> np.ndarray:
        """Nodes that are not the smallest of their component."""
        return np.flatnonzero(self.label != np.arange(len(self.label)))


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b: long); the label is the smallest node.

    Each round maps a node to its smallest neighbour and contracts the edges, so the number of
    rounds grows with the logarithm of the longest chain. Nothing but counts comes to the driver.
    """
    edges = written(edges.where("a <> b").select("a", "b").distinct(), "edges")
    labels = None
    while edges.limit(1).count():
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("p"))
        parent = written(parent.select(F.col("a").alias("v"), "p"), "parents")
        if labels is None:
            labels = parent.select(F.col("v").alias("node"), F.col("p").alias("label"))
        else:
            labels = labels.join(parent, labels["label"] == parent["v"], "left").select(
                "node", F.coalesce("p", "label").alias("label")
            )
        labels = written(labels, "labels")
        ends = parent.select(F.col("v").alias("b"), F.col("p").alias("q"))
        edges = written(
            edges.join(parent, edges["a"] == parent["v"])
            .select("p", "b")
            .join(ends, "b")
            .where("p <> q")
            .select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))
            .distinct(),
            "edges",
        )
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels
