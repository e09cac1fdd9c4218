"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a map-side combined minimum and an equi-join, so a hub's edges never meet in one task (AQE may
split the joins), nothing is collected, and each round is cut by a written table that survives lost executors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from deltaloom.llm._shared import remove, write_out


def forest(edges: DataFrame) -> DataFrame:
    """Edges with the same components, batch by batch at most one for each node: a dense group keeps a few, not its square."""

    def run(batches):
        for batch in batches:
            nodes, ends = np.unique(np.concatenate((batch.column(0).to_numpy(), batch.column(1).to_numpy())), return_inverse=True)
            parent = list(range(len(nodes)))
            for a, b in zip(ends[: batch.num_rows].tolist(), ends[batch.num_rows :].tolist()):
                while parent[a] != a:
                    parent[a] = a = parent[parent[a]]
                while parent[b] != b:
                    parent[b] = b = parent[parent[b]]
                if a != b:
                    parent[max(a, b)] = min(a, b)
            up = np.array(parent, dtype=np.int64)
            while len(up) and (up[up] != up).any():
                up = up[up]
            moved = np.flatnonzero(up != np.arange(len(up)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[up[moved]])], names=["u", "v"])

    return edges.mapInArrow(run, "u bigint, v bigint")


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """Rows (node, component): the smallest node reachable, for each node that has an edge to another one.

    ``edges`` has two columns of longs. Null ends and self-loops are ignored; direction and repeats do not matter.
    """
    spark = edges.sparkSession
    a, b = (F.col(c) for c in edges.columns)
    edges = edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    edges = forest(edges).distinct()
    current, path = write_out(edges, label)
    state = None
    while True:
        now = current.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if now == state or not now[0]:
            break
        state = now
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        old, (current, path) = path, write_out(small, label)
        remove(spark, old)
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def least_of_component(nodes: DataFrame, components: DataFrame, column: str, name: str) -> DataFrame:
    """Rows of ``nodes`` (node, column, ...) with the least ``column`` of their component as ``name``; a node without a component is its own.

    Only nodes with a component meet their like, in tables, so that AQE may split a hot component.
    """
    held, _ = write_out(nodes.select("node", column).join(components, "node"), "component-members")
    least, _ = write_out(held.groupBy("component").agg(F.min(column).alias(name)), "component-least")
    named = held.select("node", "component").join(least, "component").select("node", name)
    return nodes.join(named, "node", "left").withColumn(name, F.coalesce(name, column))
