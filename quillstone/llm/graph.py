"""Connected components as DataFrame joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import cut

#: Edges that a task holds at a time.
HELD = 1 << 20


def contract(u: np.ndarray, v: np.ndarray, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) of each node, without whole not of the smallest, but one that has only a loop keeps it."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        x, y = label[a], label[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        if (low == high).all():
            break
        np.minimum.at(label, high, low)
        while ((jump := label[label]) != label).any():
            label = jump
    shown = whole | (label != np.arange(len(nodes))) | (np.bincount(label, minlength=len(nodes))[label] == 1)
    return nodes[shown], nodes[label[shown]]


def _contracted(whole: bool):
    """Stars that connect what the edges u, v of a task connect, from HELD edges at a time; with whole at once and with their centres."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def stars() -> pa.RecordBatch:
            x, y = contract(*(np.concatenate(c) for c in zip(*held, strict=True)), whole)
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["u", "v"])

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            if not whole and sum(len(x) for x, _ in held) >= HELD:
                yield stars()
                held.clear()
        if held:
            yield stars()

    return run


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component): each node of edges with the smallest node reachable from it.

    Tasks first contract the edges they have to stars. If these are at most HELD, one task ends the job; else tasks
    contract HELD of them each, and each node takes the smallest centre it has. Where a node has other centres or is one, centres
    are edges of a smaller graph, whose components come by rounds: each class takes the smallest label next to any of its nodes,
    and then that class's own choice (pointer jumping), so classes merge whole and the rounds grow with the
    logarithm of the node count, not with the diameter. Nodes meet their component once, after the rounds. Each round is a written table;
    only counts reach the driver. Hubs are safe: minima are pre-aggregated and the joins split skewed sides.
    Self-loops and repeated edges are allowed; an empty input gives an empty result.
    """
    stars = edges.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v"))
    stars = cut(stars.mapInArrow(_contracted(False), "u long, v long"), "stars")
    n = stars.count()
    if n <= HELD:
        return cut(stars.coalesce(1).mapInArrow(_contracted(True), "u long, v long"), "labels").toDF("node", "component")
    stars = cut(stars.coalesce(-(-n // HELD)).mapInArrow(_contracted(False), "u long, v long"), "edges")
    none = F.lit(None).cast("long")
    own = stars.union(stars.select(F.col("v").alias("u"), none)).groupBy("u").agg(F.min("v").alias("m"), F.collect_set("v").alias("all"), F.max(F.col("v").isNull()).alias("centre"))
    own = cut(own.select(F.col("u").alias("node"), F.coalesce("m", "u").alias("component"), "all", F.col("centre") & F.col("m").isNotNull()).toDF("node", "component", "all", "both"), "centres")
    upper = own.select(F.col("component").alias("u"), F.explode("all").alias("v")).filter("u <> v").union(own.filter("both and node <> component").select("node", "component"))
    merged = _rounds(cut(upper.distinct(), "upper")).toDF("part", "least")
    return cut(own.join(merged, F.col("component") == F.col("part"), "left").select("node", F.coalesce("least", "component").alias("component")), "labels")


def _rounds(edges: DataFrame) -> DataFrame:
    """(node, component) by rounds alone."""
    pairs = edges.union(edges.select("v", "u")).toDF("u", "v")
    labels = cut(pairs.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    while True:
        near = pairs.join(labels.select(F.col("node").alias("v"), "component"), "v").groupBy(F.col("u").alias("node")).agg(F.min("component").alias("near"))
        classes = labels.join(near, "node").groupBy("component").agg(F.least("component", F.min("near")).alias("least"))
        jump = classes.select(F.col("component").alias("least"), F.col("least").alias("jump"))
        classes = cut(classes.join(jump, "least", "left").select("component", F.least("least", "jump").alias("now")), "classes")
        if classes.filter("now <> component").limit(1).count() == 0:
            return labels
        labels = cut(labels.join(classes, "component").select("node", F.col("now").alias("component")), "labels")
