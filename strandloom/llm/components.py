"""Connected components of an edge table, by union-find inside tasks and star contraction between them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import cut

#: Edges that a task holds at once, and rows of all tasks' forests (16 bytes each) that one task may still join.
HELD, FINISH = 1 << 20, 1 << 20


def union_find(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the smallest node of each one's tree): larger roots are hung below smaller ones, then paths are halved."""
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    parent = np.arange(len(nodes))
    while (apart := parent[a] != parent[b]).any():
        a, b = a[apart], b[apart]
        x, y = parent[a], parent[b]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while (up := parent[parent]).tobytes() != parent.tobytes():
            parent = up
    return nodes, nodes[parent]


def _forest(stream, whole: bool = False):
    """Each task's edges as a spanning forest: every node beside the smallest of its tree (with `whole` the roots too)."""
    u, v, n = [], [], 0

    def joined():
        nodes, roots = union_find(np.concatenate(u), np.concatenate(v))
        far = slice(None) if whole else nodes != roots
        return nodes[far], roots[far]

    def rows(nodes, roots):
        return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], ["node", "component"])

    for batch in stream:
        u.append(batch.column("u").to_numpy()), v.append(batch.column("v").to_numpy())
        n += batch.num_rows
        if n > HELD and not whole:
            nodes, roots = joined()
            u, v, n = [nodes], [roots], len(nodes)
            if 2 * n > HELD:  # bounded memory: what is joined so far goes out and is forgotten
                yield rows(nodes, roots)
                u, v, n = [], [], 0
    if n:
        yield rows(*joined())


def components(edges: DataFrame, finish: int = FINISH) -> DataFrame:
    """(node, component) for every node of edges (u, v): the smallest node that is reachable.

    Tasks join their own edges first.  Forests of `finish` rows in all are
    joined by one more task, a bounded amount whatever the input; larger ones by
    large-star and small-star rounds between tasks until nothing changes, each a
    map-side-combined minimum and an equi-join, so a hub is split by skew joins.
    Both ways give the same rows, and nothing is collected but counts and a
    checksum.  Edges with a null end are ignored; loops and repeats are
    harmless; no edges give an empty table.
    """
    kind = "node long, component long"
    now = cut(edges.filter("u is not null and v is not null and u != v").select("u", "v").mapInArrow(_forest, kind)).toDF("u", "v")
    if now.count() <= finish:
        return now.coalesce(1).mapInArrow(lambda s: _forest(s, whole=True), kind)
    state = None
    while True:
        both = now.union(now.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").union(least.select("u", "m")).distinct()
        now = cut(small)
        seen = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum("v")).first())
        if seen == state:
            break
        state = seen
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
