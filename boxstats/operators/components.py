"""Connected components of an edge DataFrame."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxstats.operators.joins import lookup_join
from boxstats.storage import discard, materialize

# Edges that a task contracts (16 bytes each, and a few times that while it does).
EDGES_PER_TASK = 1_000_000


def connected_components(edges: DataFrame) -> DataFrame:
    """(src, dst) bigint -> (id, comp): comp is the smallest id of the component.

    Tasks first contract the edges of one range each: every node of a task gets the smallest node that its edges lead to.
    Only these roots, where tasks share a node, are left to the steps between tasks. A column ``near``
    sorts the edges so that neighbours share a range (cells, for instance); the result does not depend on it.
    """
    spark = edges.sparkSession
    near = F.col("near") if "near" in edges.columns else F.lit(0)
    edges = materialize(
        edges.select(near.cast("bigint").alias("near"), F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        .filter("u != v").distinct()
    )
    tasks = max(spark.sparkContext.defaultParallelism, -(-edges.count() // EDGES_PER_TASK))
    # All columns take part, so no range holds more than its share.
    local = edges.repartitionByRange(tasks, "near", "u", "v").select("u", "v").mapInArrow(_contract, "id bigint, root bigint")
    # A node has at most one root of every task.
    nodes = materialize(local.groupBy("id").agg(F.min("root").alias("root"), F.collect_set("root").alias("roots")))
    discard(edges)
    shared = nodes.filter("size(roots) > 1").select(F.explode("roots").alias("src"), F.col("root").alias("dst"))
    tops = _alternate(shared)
    found = lookup_join(nodes.select("id", "root"), tops.toDF("root", "comp"), ["root"], "left", tops.count())
    found = materialize(found.select("id", F.coalesce("comp", "root").alias("comp")))
    discard(nodes)
    discard(tops)
    return found


def _contract(batches):
    """(id, root) of the nodes of some edges (u, v): the smallest node that each is connected with by them."""
    pairs = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches if b.num_rows]
    if not pairs:
        return
    u, v = (np.concatenate(ends) for ends in zip(*pairs))
    ids, index = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v = index[: len(u)], index[len(u) :]
    root = np.arange(len(ids))
    while True:
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            break
        u, v = u[apart], v[apart]
        # Every root that has a smaller one beside it goes below the smallest of them.
        np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (root != root[root]).any():
            root = root[root]
    roots = ids[root]
    for at in range(0, len(ids), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + (1 << 16)]), pa.array(roots[at : at + (1 << 16)])], names=["id", "root"])


def _alternate(edges: DataFrame) -> DataFrame:
    """As ``connected_components``, by shuffles alone.

    Alternates two steps (Kiveris et al. 2014) until nothing changes: every node hands its
    larger neighbours, then its smaller ones, to the smallest neighbour it knows. The
    edge set stays within twice its first size and converges in few rounds. Both steps are
    written out, which keeps the plan short and survives lost executors.
    """
    edges = materialize(
        edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).filter("u != v").distinct()
    )
    before, state = None, _digest(edges)
    while state != before:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = materialize(_hook(both, True, 2 * state[0]))
        former, edges = edges, materialize(_hook(large, False, 2 * state[0]))
        discard(former)
        discard(large)
        before, state = state, _digest(edges)
    # Every remaining edge points from a node to the smallest of its component.
    roots = edges.select(F.col("v").alias("id")).distinct().withColumn("comp", F.col("id"))
    found = materialize(edges.select(F.col("u").alias("id"), F.col("v").alias("comp")).unionByName(roots))
    discard(edges)
    return found


def _hook(edges: DataFrame, larger: bool, n_nodes: int) -> DataFrame:
    """Link neighbours of u to the smallest of u's neighbours and u itself.

    ``larger``: edges hold both directions, and the neighbours above u move. Otherwise
    edges hold u > v only, and all neighbours and u move. ``n_nodes`` bounds the number of u.
    """
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    source = edges.filter("v > u") if larger else edges
    moved = lookup_join(source, least, ["u"], table_rows=n_nodes)
    moved = moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not larger:
        moved = moved.unionByName(least.select("u", F.col("m").alias("v")))
    return moved.filter("u != v").distinct()


def _digest(edges: DataFrame) -> tuple:
    """Size and order-free checksums of an edge set; no round can undo another's links."""
    mix = F.xxhash64("u", "v").cast("decimal(20,0)")
    total = edges.agg(F.count(F.lit(1)), F.sum(mix), F.sum(F.col("v").cast("decimal(20,0)")))
    return tuple(total.first())
