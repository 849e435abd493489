"""Connected components of an edge table by alternating star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silvagrid.llm.common import discard, settle

#: Edges that one task contracts at a time.
CHUNK_EDGES = 1_000_000


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of these edges and the smallest node each reaches through them."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = np.split(ends, 2)
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        before = label.copy()
        np.minimum.at(label, label[u], low)
        np.minimum.at(label, label[v], low)
        label = label[label]
        if np.array_equal(before, label):
            return nodes, nodes[label]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the edges a task holds by stars of their components, chunk by chunk."""
    held: list[pa.RecordBatch] = []

    def stars() -> pa.RecordBatch:
        a, b = (np.concatenate([x.column(i).to_numpy() for x in held]) for i in (0, 1))
        nodes, roots = _roots(a, b)
        off = nodes != roots
        return pa.RecordBatch.from_arrays([pa.array(nodes[off]), pa.array(roots[off])], ["u", "v"])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(x.num_rows for x in held) >= CHUNK_EDGES:
            yield stars()
            held.clear()
    if held:
        yield stars()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every node of an edge; component is the smallest id reachable.

    Self-loops, repeated edges and either direction are fine; rows with a null end are no edges.
    Each task first contracts its edges; large-star and small-star rounds (each a
    minimum per node and a join, so a hub is split like any skewed join) do the rest in a
    logarithmic number of rounds.
    """
    pairs = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
    stars = settle(pairs.where("u <> v").mapInArrow(_contract, "u long, v long"), "edges")
    mark = None
    while True:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = settle(large.distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = settle(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small")
        now = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(large)
        discard(stars)
        stars = after
        if now == mark:
            break
        mark = now
    return stars.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        stars.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
