"""Connected components of an edge table, by alternating stars.

A round lets every node tell its larger neighbours, then its smaller ones, of the smallest node that it knows; the
number of rounds grows with the logarithm of a component's size. Each round is a table in the shared folder. Minima are
pre-aggregated, and the joins that hand them out can be split by the adaptive skew join where a node has very many neighbours. A table
goes when the next round has been written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import drop_stored, stored

#: Edges that one task may join up: 16 MB of them.
SMALL = 1 << 20


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All of few edges (u > v) at once: every node that is not a root, and its root."""
    edges = pa.Table.from_batches(list(batches), pa.schema([("u", pa.int64()), ("v", pa.int64())]))
    nodes, place = np.unique(np.concatenate([edges.column("u").to_numpy(), edges.column("v").to_numpy()]), return_inverse=True)
    u, v = np.split(place, 2)
    root = np.arange(len(nodes))
    while True:
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            break
        np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while not np.array_equal(root[root], root):
            root = root[root]
    child = np.flatnonzero(root != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[child]), pa.array(nodes[root[child]])], ["u", "v"])


def components(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """node, root (the smallest node of its component) for every node of the edges (u, v) but the roots themselves; nodes are longs.
    No more than `small` edges are joined up in one task."""
    now = stored(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(now)
    if state[0] <= small:
        out = stored(now.coalesce(1).mapInArrow(_joined, "u long, v long"))
        drop_stored(now)
        return out.select(F.col("u").alias("node"), F.col("v").alias("root"))
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("w")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large)
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
        told = large.join(least, F.col("u") == F.col("w")).select("u", "v", "m")
        small = told.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(told.select("u", F.col("m").alias("v"))).distinct()
        new = stored(small)
        drop_stored(now, large)
        now, before, state = new, state, _state(new)
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
