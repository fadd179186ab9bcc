"""Connected components of a link table by randomised contraction.

Each round every node points at the neighbour (or itself) with the smallest random priority, and the links are rewritten
between the nodes pointed at.  Priorities change with the round, so the expected number of nodes falls by a constant factor
and long chains do not take long.  All steps are hash aggregates and equi-joins, which Spark can split where a hub holds
many links; each round ends in a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinflow.llm.common import drop_stage, stage


def components(links: DataFrame) -> DataFrame:
    """``links`` (a long, b long) -> (node, component), component being the smallest node reachable.

    Nodes without links do not occur; self-links, repeated links and nulls are ignored; no links give no rows.
    """
    links = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    )
    edges = stage(links.distinct(), "links")
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        seed = F.lit(len(maps))
        rank = lambda c: F.struct(F.xxhash64(F.col(c), seed).alias("p"), F.col(c).alias("v"))
        both = edges.select(F.col("a").alias("node"), rank("b").alias("to")).union(
            edges.select(F.col("b").alias("node"), rank("a").alias("to"))
        )
        to = both.groupBy("node").agg(F.min("to").alias("to"))
        to = stage(to.select("node", F.least("to", rank("node"))["v"].alias("to")), "hops")
        maps.append(to)
        a = to.select(F.col("node").alias("a"), F.col("to").alias("ta"))
        b = to.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        moved = edges.join(a, "a").join(b, "b").where("ta <> tb")
        moved = moved.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct()
        last, edges = edges, stage(moved, "links")
        drop_stage(last)
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = maps[0]
    for hop in maps[1:]:
        hop = hop.select(F.col("node").alias("to"), F.col("to").alias("next"))
        found = found.join(hop, "to", "left").select("node", F.coalesce("next", "to").alias("to"))
    found = stage(found, "roots")
    drop_stage(edges, *maps)
    least = found.groupBy("to").agg(F.min("node").alias("component"))
    return found.join(least, "to").select("node", "component")
