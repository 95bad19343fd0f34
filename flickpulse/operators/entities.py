"""Entity catalogues, language views, seed and handle resolution, chain evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flickpulse.functions import columns as C
from flickpulse.operators import graph as G


def entity_catalog(entities: DataFrame, entity_keywords: DataFrame, category: str) -> DataFrame:
    """Entities of a category with a grouping value, one row per distinct keyword (no arrays that could grow)."""
    k = (entity_keywords.filter(F.col("category") == category)
         .groupBy("entity_id", "keyword").agg(F.max("genre").alias("grouping")))
    return entities.select("entity_id", "name").join(k, "entity_id")


def language_links(entities: DataFrame, mention_entities: DataFrame, language: str, title: str | None = None) -> DataFrame:
    pick = (F.col("type") == "MOVIE") & C.same_text("language", F.lit(language))
    if title is not None:
        pick &= C.same_text("name", F.lit(title))
    e = entities.filter(pick).select(F.col("entity_id").alias("managed_entity_id"), F.col("name").alias("movie"))
    return mention_entities.join(e, "managed_entity_id")


def posts_for_language(entities: DataFrame, mention_entities: DataFrame, mentions: DataFrame, language: str, page: int,
                       size: int) -> DataFrame:
    """Distinct (mention, title) rows of titles in a language, newest first, one page."""
    links = language_links(entities, mention_entities, language).select("mention_id", "movie").distinct()
    rows = links.join(mentions.select("mention_id", "platform", "author", "us", "sentiment_score"), "mention_id")
    return rows.orderBy(F.desc_nulls_last("us"), "mention_id", "movie").offset(page * size).limit(size)


def language_audience(entities: DataFrame, mention_entities: DataFrame, mentions: DataFrame, link: DataFrame,
                      language: str, title: str | None = None) -> DataFrame:
    """Mentions, distinct titles and mean valid sentiment (one decimal) per resolved user."""
    links = language_links(entities, mention_entities, language, title).select("mention_id", "managed_entity_id").distinct()
    m = mentions.filter(F.trim("author") != "").select("mention_id", "author", "sentiment_score")
    rows = G.resolve_authors(links.join(m, "mention_id"), link)
    valid = F.col("sentiment_score").between(1, 100)
    per_mention = rows.groupBy("global_user_id", "mention_id").agg(F.first("sentiment_score").alias("sentiment_score"))
    mood = per_mention.groupBy("global_user_id").agg(
        F.count(F.lit(1)).alias("mention_count"), C.round_half_up(F.avg(F.when(valid, F.col("sentiment_score"))), 1)
        .alias("average_sentiment"))
    titles = rows.groupBy("global_user_id").agg(F.countDistinct("managed_entity_id").alias("distinct_movies"))
    return mood.join(titles, "global_user_id")


def cross_platform_variance(posts: DataFrame, link: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Variance of a user's mean sentiment (0-1) over platforms: low is an evangelist, else a critic."""
    per = (G.resolve_authors(posts.filter(F.col("sentiment_score") != 0), link).groupBy("global_user_id", "platform")
           .agg(F.avg(F.col("sentiment_score") / 100).alias("mean")))
    out = per.groupBy("global_user_id").agg(F.var_pop("mean").alias("variance"), F.count(F.lit(1)).alias("n_platforms"))
    return out.withColumn("segment", F.when(F.col("variance") < threshold, F.lit("evangelist")).otherwise(F.lit("critic")))


def resolve_handle(profiles: DataFrame, wanted: DataFrame) -> DataFrame:
    """Handle -> profile whose URL on any platform ends with it (case-insensitive; smallest id when several).

    profiles: user, by_platform (map); the last path part of each URL is the join key.
    """
    tail = F.lower(F.regexp_extract(F.col("e.profile_url"), r"([^/@]+)/?$", 1))
    urls = profiles.select("user", F.explode(F.map_values("by_platform")).alias("e")).select("user", tail.alias("tail"))
    first = urls.groupBy("tail").agg(F.min("user").alias("user"))
    return (wanted.withColumn("tail", F.lower(F.regexp_replace("handle", "^@", ""))).join(first, "tail", "left")
            .select("handle", "user"))


def resolve_seed(profiles: DataFrame, wanted: DataFrame) -> DataFrame:
    """Seed text -> outcome (exact, normalized, ambiguous, unknown) and the profile where it is unique."""
    exact = profiles.select(F.col("user").alias("seed"), F.lit(True).alias("is_exact"))
    near = (profiles.select("user", C.normalize_author("user").alias("norm")).filter("norm IS NOT NULL")
            .groupBy("norm").agg(F.count(F.lit(1)).alias("n"), F.min("user").alias("one")))
    j = (wanted.withColumn("norm", C.normalize_author("seed")).join(exact, "seed", "left").join(near, "norm", "left"))
    outcome = (F.when(F.col("is_exact"), "exact").when(F.col("n") == 1, "normalized").when(F.col("n") > 1, "ambiguous")
               .otherwise("unknown"))
    return j.select("seed", outcome.alias("outcome"), F.when(F.col("is_exact"), F.col("seed")).when(
        F.col("n") == 1, F.col("one")).alias("user"))


CHAIN = "array<struct<`from`:string,`to`:string,lag:int,q:double,effectSize:double>>"


def chain_evidence(entities: DataFrame, chains: DataFrame, edges: DataFrame) -> DataFrame:
    """Chain steps of each entity's cohort, or of the pooled 'ALL' cohort when it has none, with supporting entities.

    entities: entity_id, cohort; chains: cohort, chain_id, path_score, chain_json; edges: cohort, from_series,
    to_series, lag_days, n_entities_supporting.
    """
    known = chains.select("cohort").distinct().withColumn("has_own", F.lit(True))
    resolved = (entities.join(known, "cohort", "left")
                .withColumn("resolved", F.when(F.col("has_own"), F.col("cohort")).otherwise(F.lit("ALL")))
                .withColumn("pooled", F.col("has_own").isNull()))
    steps = (chains.withColumn("s", F.explode(F.from_json("chain_json", CHAIN)))
             .select(F.col("cohort").alias("resolved"), "chain_id", "path_score", F.col("s.from").alias("from_series"),
                     F.col("s.to").alias("to_series"), F.col("s.lag").alias("lag_days"), F.col("s.q").alias("q"),
                     F.col("s.effectSize").alias("effect")))
    support = edges.withColumnRenamed("cohort", "resolved")
    with_support = steps.join(support, ["resolved", "from_series", "to_series", "lag_days"], "left")
    return resolved.select("entity_id", "resolved", "pooled").join(with_support, "resolved")


def collate(results: dict[str, DataFrame]) -> DataFrame:
    """Union results of several sources: a source label, columns prefixed by source, missing cells null."""
    out = None
    for source, df in results.items():
        part = df.select(F.lit(source).alias("source"), *[F.col(c).alias(f"{source}_{c}") for c in df.columns])
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def column_policy(df: DataFrame, table: str, skip: list[str] = (), mask: list[str] = (), patterns: list[str] = ()):
    """Drop skipped columns and mask masked ones. Rules are ``column``, ``table.column`` or ``schema.table.column``;
    ``patterns`` are regular expressions on the column name. Skipping wins over masking."""
    import re
    names = [table.split(".")[-1], table]
    covered = lambda rules, c: any(r.lower() in {c.lower(), *(f"{n}.{c}".lower() for n in names)} for r in rules)
    kept: list[Column] = []
    for c in df.columns:
        if covered(skip, c) or any(re.fullmatch(p, c, re.I) for p in patterns):
            continue
        kept.append(C.mask_value(c).alias(c) if covered(mask, c) else F.col(c))
    return df.select(*kept)
