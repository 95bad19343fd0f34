"""Keyword, genre and channel reach."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flickpulse.functions.vocab import PLATFORMS
from flickpulse.operators import engagement as E


def keyword_reach(posts: DataFrame) -> DataFrame:
    return (posts.filter(F.col("keyword").isNotNull()).groupBy(F.lower("keyword").alias("keyword"), "platform")
            .agg(F.sum(E.reach()).alias("total_reach"), F.count(F.lit(1)).alias("post_count")))


def genre_reach(labelled: DataFrame) -> DataFrame:
    """``labelled``: posts exploded to one row per matched genre; a post counts fully for each."""
    return labelled.groupBy("genre", "platform").agg(F.sum(E.reach()).alias("total_reach"),
                                                     F.count(F.lit(1)).alias("post_count"))


def channel_strategy(reach: DataFrame, key: str) -> DataFrame:
    """All four platforms per key: share of the top channel, the top channel, and its ratio to the runner-up.

    The four platforms are pivoted into columns and unpivoted, so the work stays inside the aggregation.
    """
    wide = reach.groupBy(key).agg(
        *[F.coalesce(F.sum(F.when(F.col("platform") == p, F.col("total_reach"))), F.lit(0)).alias(p)
          for p in PLATFORMS])
    order = F.array_sort(F.array(*[F.struct((-F.col(p)).alias("r"), F.lit(i).alias("i"), F.lit(p).alias("p"))
                                   for i, p in enumerate(PLATFORMS)]))
    best, second = order[0], order[1]
    out = wide.select(key, best["p"].alias("top_channel"), (-best["r"]).alias("top_reach"),
                      (-second["r"]).alias("second_reach"),
                      F.explode(F.array(*[F.struct(F.lit(p).alias("platform"), F.col(p).alias("reach"))
                                          for p in PLATFORMS])).alias("c"))
    return out.select(key, "c.platform", "c.reach", "top_channel",
                      F.when(F.col("top_reach") > 0, F.col("c.reach") / F.col("top_reach")).otherwise(0.0)
                      .alias("relative"),
                      F.when(F.col("second_reach") > 0, F.col("top_reach") / F.col("second_reach"))
                      .alias("headline_ratio"))


def keyword_variants(entity_keywords: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each wanted keyword, every keyword of the entities that own it, or the keyword itself when none does."""
    ek = entity_keywords.select("entity_id", F.lower("keyword").alias("variant")).distinct()
    asked = wanted.select(F.lower("keyword").alias("keyword")).distinct()
    owners = ek.withColumnRenamed("variant", "keyword").join(asked, "keyword", "left_semi")
    found = owners.join(ek, "entity_id").select("keyword", "variant").distinct()
    return (asked.join(found, "keyword", "left")
            .select("keyword", F.coalesce("variant", "keyword").alias("variant")))


def platform_breakdown(posts: DataFrame, entity_keywords: DataFrame, measure=None) -> DataFrame:
    """Per entity and platform: measure over the entity's whole keyword set, with its share of the entity total.

    Posts are first summed to (keyword, platform); only those sums meet the keyword sets.
    """
    sums = (posts.groupBy(F.lower("keyword").alias("variant"), "platform")
            .agg(F.sum(E.reach() if measure is None else measure).alias("m"), F.count(F.lit(1)).alias("n")))
    ek = entity_keywords.select("entity_id", F.lower("keyword").alias("variant")).distinct()
    per = ek.join(sums, "variant").groupBy("entity_id", "platform").agg(F.sum("m").alias("measure"),
                                                                        F.sum("n").alias("post_count"))
    total = F.sum("measure").over(W.partitionBy("entity_id"))  # four rows per entity
    return per.withColumn("share", F.when(total > 0, F.col("measure") / total).otherwise(0.0))
