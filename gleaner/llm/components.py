"""Connected components over a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialize


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Each node's neighbours (the larger, or the smaller and itself) move to its least neighbour. Joins split hot nodes."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if larger else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")  # read back, so that the join has exchanges of its own
    moved = both.join(least, "a")
    if larger:
        out = moved.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    out = materialize(out.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    discard(edges, least)
    return out


#: So many links at most are joined in one task.
FEW = 1 << 20


def components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """(node, component): the least node reachable. edges: (a, b) of one integer type; loops and nulls are left out.

    Few links are joined in one task, of bounded size. Otherwise every round is written to the shared folder; rounds go on
    until nothing changes, which takes about the logarithm of the longest path. In the end each node's only edge leads to
    its component.
    """
    now = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    if now.count() <= few:
        kind = dict(now.dtypes)["a"]
        return now.coalesce(1).mapInArrow(_joined, f"node {kind}, component {kind}")
    mark = None
    while True:
        now = _star(_star(now, True), False)
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if seen == mark:
            return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
        mark = seen


def _joined(batches):
    """Each node that isn't its own component, with its component."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
            kind = batch.schema.field(0).type
    nodes = [x for x in root if find(x) != x]
    for at in range(0, len(nodes), 100_000):
        part = nodes[at : at + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, kind), pa.array([find(x) for x in part], kind)], ["node", "component"])


def local_labels(ids: np.ndarray, a: np.ndarray, b: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """Each row's least id reachable through the matrix of links between rows a and rows b."""
    label, top = ids.copy(), np.iinfo(np.int64).max
    while True:
        before = label.copy()
        label[a] = np.minimum(label[a], np.where(linked, label[b][None, :], top).min(axis=1, initial=top))
        label[b] = np.minimum(label[b], np.where(linked, label[a][:, None], top).min(axis=0, initial=top))
        if (label == before).all():
            return label
