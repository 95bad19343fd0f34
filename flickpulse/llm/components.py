"""Connected components of a graph that is given as links between ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flickpulse.operators.scale import stage


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """One step of the alternating-stars method; ``links`` are (a, b) with a > b.

    Every node points its larger neighbours (``large``), or itself and its smaller ones, to its smallest neighbour. The
    smallest neighbour is a partial aggregate that is joined back, so a node with very many links is no group of rows.
    """
    near = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
    least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    joined = near.join(least, "a")
    if large:
        out = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(
            least.select("a", F.col("least").alias("b")))
    return out.filter(F.col("a") > F.col("b")).distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, component)`` of every node that has a link; the component is its smallest node.

    Links of a node with itself or with null are ignored. The links shrink to stars in a number of rounds that is
    logarithmic in the size of a component; each round is staged in the shared folder.
    """
    now = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"),
                       (F.col(a) != F.col(b)).alias("real")).filter("real").drop("real").distinct()
    now, before = stage(now), None
    while True:
        now = stage(_stars(_stars(now, True), False))
        state = now.agg(F.count("a"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
