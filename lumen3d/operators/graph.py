"""Connected components of links, without a graph on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumen3d.functions.tables import shared_table


def both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def settled(links: DataFrame) -> bool:
    """Whether links (a, b) are stars: each a has one b, and no b is an a."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(links.select("b", F.lit(0), F.lit(1)))
    counts = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return counts.where("up > 1 or (up = 1 and down = 1)").isEmpty()


def component_ids(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each node of links (a, b) reaches.

    Large-star and small-star steps in turn: each node sends its neighbours above itself, then its neighbours
    below and itself, to the least of its neighbourhood, until stars are left. The number of links never grows,
    and rounds grow with the logarithm of a chain's length. Each step's least neighbour is summed up before it
    moves; links meet it in a join whose hot nodes adaptive execution can split. Each round ends in a written
    table. Links to itself and repeated links do no harm; null ends are left out.
    """
    links = links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = shared_table(links, "components")
    for _ in range(rounds):
        if settled(links):
            break
        pairs = both_ways(links)
        least = pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = pairs.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(low.select("a", F.col("m").alias("b"))).distinct()
        links = shared_table(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    else:
        raise RuntimeError("components did not settle")
    members = links.groupBy("a").agg(F.min("b").alias("component"))
    return members.select(F.col("a").alias("node"), "component").union(members.select(F.col("component").alias("node"), "component").distinct())
