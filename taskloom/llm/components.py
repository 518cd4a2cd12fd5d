"""Connected components of a distributed edge list, by alternating star contractions or, of few edges, in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


#: Edges that a single task joins, at most (some hundred bytes each).
TASK_EDGES = 1 << 19


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction of edges (u > v): link a node's neighbours to the smallest of them.

    large: every node moves its larger neighbours; else its smaller ones and itself. The minimum
    is pre-aggregated before the shuffle, so a node with very many edges costs one row a task.
    """
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        moved = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        joined = edges.join(least, "u")
        moved = joined.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where("u > v").distinct()


def _state(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def union(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least reachable node of each of the nodes 0 to max, by hooking and shortcuts."""
    parent = np.arange(max(u.max(), v.max()) + 1)
    while True:
        a, b = parent[u], parent[v]
        if np.array_equal(a, b):
            return parent
        least = np.minimum(a, b)
        np.minimum.at(parent, a, least)
        np.minimum.at(parent, b, least)
        while not np.array_equal(up := parent[parent], parent):
            parent = up


def _in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if not held:
            return
        u, v = map(np.concatenate, zip(*held))
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)  # in order, so the least place is the least node
        found = nodes[union(at[: len(u)], at[len(u) :])]
        for k in range(0, len(nodes), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[k : k + 10_000]), pa.array(found[k : k + 10_000])], ["node", "component"])

    return edges.select("u", "v").repartition(1).mapInArrow(run, "node long, component long")


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, task_edges: int = TASK_EDGES) -> DataFrame:
    """(node, component) for every node with an edge; component is its smallest reachable node.

    Nodes are longs. Edges to itself, repeats, and nulls are ignored; an empty table has no nodes. Up to
    ``task_edges`` edges are joined in one task, whose memory that bounds. More are contracted in rounds, each
    of which writes the contracted edges to the shared folder, so lineage stays short and a lost executor costs
    one round. Rounds end when a contraction changes nothing, after about log(longest chain) of them.
    """
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v and v is not null").distinct()
    edges = materialize(edges, "edges")
    before = _state(edges)
    if before[0] <= task_edges:
        out = materialize(_in_one_task(edges), "components")
        discard(edges)
        return out
    for _ in range(max_rounds):
        half = materialize(_star(edges, True), "edges")
        last, edges = edges, materialize(_star(half, False), "edges")
        discard(last, half)
        after = _state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not converge")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
