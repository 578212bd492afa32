"""Iterative graph steps as repeated joins with durable checkpoints between rounds.

Each round is a groupBy and an equi join on node keys; nothing is gathered on the
driver except one count that decides whether to go on. Work per round shrinks or the
number of rounds is logarithmic in path length.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlens.session import cut_lineage


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): least id reachable. nodes(id), edges(src, dst), any direction.

    Alternating large-star and small-star rounds, until whoever has a lesser neighbour has
    no other. A busy node meets its neighbours through one row holding their minimum, never
    through a collected list.
    """
    both = edges.where(F.col("src") != F.col("dst")).select("src", "dst")
    state = cut_lineage(both.select(F.greatest("src", "dst").alias("u"),
                                    F.least("src", "dst").alias("v")).distinct())
    while True:
        sym = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sym.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("far"))
        if least.where("m < u and far != m").isEmpty():
            break
        # large star: every larger neighbour of u points at the least of u's circle
        least = least.select("u", F.least("m", "u").alias("m"))
        large = (sym.join(least, "u").where(F.col("v") > F.col("u"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where(F.col("u") != F.col("v")).distinct())
        # small star: every smaller neighbour of u, and u itself, point at the least one
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v")))
                 .where(F.col("u") != F.col("v")).distinct())
        state = cut_lineage(small)
    labels = state.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
    return (nodes.select("id").join(labels, "id", "left")
            .withColumn("component", F.coalesce("component", "id")))


def local_stars(links: DataFrame, block: list[str]) -> DataFrame:
    """(src, dst): edges that join the same ids as links(*block, src, dst) of longs, mostly one an id.

    Rows of a block come together, and what a batch of them joins becomes stars around its least ids;
    a block of any size takes as many batches as it needs.
    """
    def run(batches):
        for part in batches:
            above: dict[int, int] = {}

            def top(x):
                while (up := above.setdefault(x, x)) != x:
                    above[x] = x = above[up]
                return x
            for a, b in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                a, b = top(a), top(b)
                above[max(a, b)] = min(a, b)
            ids = list(above)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([top(x) for x in ids], pa.int64())], ["src", "dst"])
    dealt = links.repartition(*block).sortWithinPartitions(*block)
    return dealt.select("src", "dst").mapInArrow(run, "src long, dst long")


def accumulate_downstream(nodes: DataFrame, keys: list[str], value: str, how: str) -> DataFrame:
    """Fold `value` of every node into all nodes its `next` chain passes.

    nodes(*keys, id, next, value); next is null at an end and chains never loop. Pointer
    doubling: after k rounds a node holds the fold of everything within 2^k steps
    upstream, so rounds are logarithmic in the longest chain. how: sum, min or max.
    """
    fold = {"sum": F.sum, "min": F.min, "max": F.max}[how]
    merge = {"sum": lambda a, b: a + F.coalesce(b, F.lit(0)), "min": F.least, "max": F.greatest}[how]
    state = cut_lineage(nodes.select(*keys, "id", F.col("next").alias("jump"),
                                     F.col(value).alias("acc")))
    while not state.where(F.col("jump").isNotNull()).isEmpty():
        arriving = (state.where(F.col("jump").isNotNull())
                    .groupBy(*keys, F.col("jump").alias("id")).agg(fold("acc").alias("more")))
        hop = state.select(*keys, F.col("id").alias("jump"), F.col("jump").alias("further"))
        state = cut_lineage(
            state.join(arriving, keys + ["id"], "left")
            .withColumn("acc", merge(F.col("acc"), F.col("more"))).drop("more")
            .join(hop, keys + ["jump"], "left")
            .select(*keys, "id", F.col("further").alias("jump"), "acc"))
    return state.select(*keys, "id", F.col("acc").alias(value))
