"""Connected components of a link table by alternating large and small stars, all in joins and sums by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.llm.common import materialise


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first())


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: link each larger neighbour to the least of the neighbourhood; small star: each smaller one and itself.

    The minima are written out, so that Spark can split a node that most others link to.
    """
    turned = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    around = edges.unionByName(turned) if large else edges
    least = materialise(around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "star-minima")
    met = around.join(least, "u")
    if large:
        out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    return materialise(out.where("u <> v").distinct(), "stars")


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node with a link to another; ``links`` has bigint columns u and v, in either order.

    A component is named by its least node. Nulls and self-links are ignored; an empty table gives none.
    """
    edges = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = materialise(edges, "links")
    before = _state(edges)
    while before[0]:
        edges = _stars(_stars(edges, True), False)
        after = _state(edges)
        if after == before:
            break
        before = after
    named = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return named.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
