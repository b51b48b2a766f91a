"""Connected components of an edge table, by local forests and then alternating large-star and small-star.

First each task turns the edges it has into a forest, a bounded number of them
at a time, which leaves at most one edge a node and shortens chains.  Each round
after that is two grouped minima and two joins; nothing is gathered per node.
Every round's edges are written to the shared folder, which bounds the lineage.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import settle

#: nodes a task's forest holds before it is sent on
HELD = 1 << 18


def _forest(batches):
    """Edges (u, v) from each node to its tree's smallest node, of ``HELD`` nodes or a batch more at a time."""
    up = {}

    def top(x):
        while (y := up.setdefault(x, x)) != x:
            up[x] = y = up[y]
            x = y
        return x

    def send(schema):
        ends = [(x, top(x)) for x in list(up) if up[x] != x]
        up.clear()
        return pa.RecordBatch.from_arrays([pa.array([e[i] for e in ends], schema.field(i).type) for i in (0, 1)], ["u", "v"])

    schema = None
    for batch in batches:
        schema = batch.schema
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = top(u), top(v)
            if a != b:
                up[max(a, b)] = min(a, b)
        if len(up) >= HELD:
            yield send(schema)
    if up:
        yield send(schema)


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one edge to a centre, which has none: the components are found."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e")).select("e.*")
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up > 0 and down > 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of each node of ``edges`` (u, v): comp is its component's smallest node.

    Nulls must not occur; loops and repeated edges are allowed.  No edges: no rows.
    """
    kinds = dict(edges.dtypes)
    forest = edges.where("u <> v").select("u", "v").mapInArrow(_forest, f"u {kinds['u']}, v {kinds['v']}")
    edges = settle(forest.distinct(), "edges")
    while not _settled(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges = settle(small.where("u <> v").distinct(), "edges")
    # in the end every node has one edge, to its component's smallest node
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
