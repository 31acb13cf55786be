"""Connected components of a link table, by alternating star contraction.

Large-star hangs every larger neighbour of a node on the node's smallest
neighbour, small-star does the same with the smaller ones; links end up as
stars around the smallest node of each component. Only sums per node are
shuffled, nothing is collected, and each round is checkpointed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellpulse.session import materialize


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    joined = links.join(least, "a")
    return (joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
            .unionByName(joined.select("a", F.col("m").alias("b"))).distinct())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node with a link to a smaller one; roots are not listed.

    ``links`` has two integral columns; direction, repeats and self-links do
    not matter. Rows with a null end are ignored. An empty table gives an
    empty result.
    """
    a, b = links.columns
    links = (links.where(F.col(a) != F.col(b))
             .select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    links, before = materialize(links), None
    while True:
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
        links = materialize(_small_star(_large_star(links)))
