"""Connected components of long ids, in rounds of star joins over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlens.llm.common import discard, stored


def linked_components(edges: DataFrame) -> DataFrame:
    """(id, component): the least id reachable, for every id on an edge, as a stored table. edges(src, dst) of longs.

    Large-star then small-star until every id but the least of its component has that one as its only
    neighbour. The least neighbour of an id is a map-side minimum kept as a table of one row an id, so
    both sides of each join are plain shuffles and Spark can split the rows of a busy id. Tables of past
    rounds are discarded. Null ends and loops are ignored; repeated edges count once; no edges give no rows.
    """
    state = stored(edges.where(F.col("src") != F.col("dst"))
                   .select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "edges")
    while True:
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("far"))
                       .select("u", F.least("u", "m").alias("m"), ((F.col("m") < F.col("u")) & (F.col("far") != F.col("m"))).alias("moves")), "least")
        if least.where("moves").isEmpty():                 # stars only: whoever has a lesser neighbour has no other
            discard(state)
            found = least.select(F.col("u").alias("id"), F.col("m").alias("component"))
            found.stored_folder = least.stored_folder
            return found
        large = stored(state.select(F.col("v").alias("c"), F.col("u").alias("w"))
                       .join(least.select(F.col("u").alias("c"), "m"), "c").where(F.col("w") != F.col("m"))
                       .select(F.col("w").alias("u"), F.col("m").alias("v"))
                       .unionByName(least.where(F.col("u") != F.col("m")).select("u", F.col("m").alias("v")))
                       .distinct(), "large")
        discard(state, least)
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        state = stored(large.join(least, "u").where(F.col("v") != F.col("m"))
                       .select(F.col("v").alias("u"), F.col("m").alias("v"))
                       .unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(large, least)
