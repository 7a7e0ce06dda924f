"""Distributed union-find: connected components of an edge table.

Each task first contracts the edges it holds with a local union-find, which turns
chains and cliques into stars. Alternating large-star and small-star steps then merge
the stars of different tasks. Every step groups with a partial ``min``, so a hub
node costs one row for each task, and the joins are plain equi-joins that adaptive
execution can split. The edge table never grows beyond twice its size and nothing but two sums
for each step comes to the driver.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import frozen, tidied


def _contract(batches):
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = p
        return x

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            u, v = root(u), root(v)
            if u != v:
                parent[max(u, v)] = min(u, v)
    nodes = [x for x in parent if root(x) != x]
    if nodes:
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["u", "v"])


def _stars(e: DataFrame) -> bool:
    """Whether each node has one parent, which has none: then the parents are the components."""
    ends = e.select("u", F.lit(1).alias("child")).unionAll(e.select(F.col("v").alias("u"), F.lit(0).alias("child")))
    return ends.groupBy("u").agg(F.sum("child").alias("n"), F.min("child").alias("least")).where("n > 1 OR n = 1 AND least = 0").isEmpty()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, component`` for every node of ``edges``; component is its smallest node.

    ``edges`` has two long columns, read by position. Loops and repeats are allowed,
    rows with a null end are ignored, and no edge gives an empty table. Nodes without
    an edge to another node do not appear. More than ``rounds`` steps raise an error.
    """
    u, v = edges.columns[:2]
    e = edges.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v")).where("u <> v").mapInArrow(tidied(_contract), "u long, v long")
    # u > v holds in every row from here on, and no row repeats after a step.
    e = frozen(e)
    for _ in range(rounds):
        if _stars(e):
            break
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m")), F.struct(F.col("v").alias("u"), F.col("m")))).alias("x")).select("x.u", F.col("x.m").alias("v"))
        e = frozen(small.where("u <> v").distinct())
    else:
        raise RuntimeError(f"no components after {rounds} steps")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
