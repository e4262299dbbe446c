"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprep.llm.common import materialize


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(u, v): each linked node with the smallest node that it is connected to; that smallest node has no row.

    Alternates large-star and small-star steps, which keep the components and reach stars in a number of rounds that
    grows with the logarithm of the graph. Only minima are gathered per node, and these combine before the shuffle.
    Each round is written, so a lost executor repeats one round at most.
    """
    edges = materialize(
        links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    )
    state = _state(edges)
    for _ in range(most_rounds):
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        inner = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(inner.union(least).distinct())
        found = _state(edges)
        if found == state:
            return edges
        state = found
    raise RuntimeError("components did not settle")


def _state(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
