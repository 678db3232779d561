"""Connected components of a link table, by alternating star joins written between rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabflow.scratch import discard, materialize


def _with_least(edges: DataFrame) -> DataFrame:
    """(u, v, m): every neighbour v of u together with the least label m among u and its neighbours."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return edges.join(least, "u")


def star_labels(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the least node of its component.

    Each round links the larger neighbours of a node to its least neighbour, then the smaller
    ones; edges only ever point to smaller nodes, so the rounds end in stars. A round's table goes
    when the next is written. Nothing is
    gathered on the driver but a count and two checksums a round, no neighbour list is built,
    and a node with very many neighbours is summed before it is shuffled.
    """
    links = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    before = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.filter("u <> v").distinct(), name)
        old = links
        # here every edge points from a node to smaller ones: link them all to the least
        small = _with_least(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        links = materialize(small.filter("u <> v").distinct(), name)
        discard(old, large)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.expr("bit_xor(xxhash64(v, u))")).first()
        if now == before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now
