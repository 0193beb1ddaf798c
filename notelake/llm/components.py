"""Connected components of a graph of links, without the links or components ever meeting in one place.

Links are first thinned where they lie: a task joins its own links to trees, so cliques shrink to their size. Then labels spread: in
each round a node takes the least label among its neighbours, its label's node takes it too, and labels are followed one step
(shortcutting). The rounds grow with the logarithm of the components' width, not with their size. Every round is a written table.
A node with very many links meets its label by a sort-merge join of two plain shuffles, which Spark splits when skewed; sums
to the least label are combined before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) for the links given, without the least nodes themselves."""
    nodes, flat = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = flat[: len(u)], flat[len(u) :]
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
            break
        label = new
    rest = label != np.arange(len(nodes))
    return nodes[rest], nodes[label[rest]]


def _thin(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    u, v = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for b in batches:
        u = np.concatenate((u, b.column(0).to_numpy(zero_copy_only=False)))
        v = np.concatenate((v, b.column(1).to_numpy(zero_copy_only=False)))
        if len(u) > most:
            u, v = forest(u, v)
            if len(u) > most // 2:
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])
                u, v = u[:0], v[:0]
    if len(u):
        u, v = forest(u, v)
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def components(links: DataFrame, ws: Workspace) -> DataFrame:
    """(node, component) for nodes with a link, component being the least node reachable. links: (u, v) of longs."""
    thin = links.select("u", "v").where("u <> v").mapInArrow(_thin, "u long, v long")
    both = ws.table(thin.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v").distinct(), "both")
    f = ws.table(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("f")), "labels")
    while True:
        ends = both.where("u < v").join(f.select(F.col("node").alias("u"), F.col("f").alias("fu")), "u").join(f.select(F.col("node").alias("v"), F.col("f").alias("fv")), "v")
        if not ends.where("fu <> fv").limit(1).count():
            break
        up = f.select(F.col("node").alias("f"), F.col("f").alias("g"))
        t = ws.table(f.join(up, "f").select("node", "f", "g"), "twice")  # g: label of the label
        near = both.join(t.select(F.col("node").alias("v"), "g"), "v").groupBy("u").agg(F.min("g").alias("m"))
        near = ws.table(near, "near")
        pushed = t.join(near.withColumnRenamed("u", "node"), "node").groupBy(F.col("f").alias("node")).agg(F.min("m").alias("m"))
        new = t.select("node", F.col("g").alias("m")).unionByName(near.select(F.col("u").alias("node"), "m")).unionByName(pushed).groupBy("node").agg(F.min("m").alias("f"))
        new = ws.table(new, "labels")
        ws.drop(f, t, near)
        f = new
    ws.drop(both)
    return f.select("node", F.col("f").alias("component"))
