"""User-title graph: nodes, weighted edges, degrees, and filters over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flickpulse.functions import columns as C
from flickpulse.operators import daily as D
from flickpulse.operators import engagement as E


def resolve_authors(df: DataFrame, link: DataFrame, author: str = "author") -> DataFrame:
    """Inner join to the global user through the normalised name; unresolved rows are left out."""
    return df.withColumn("normalized_author", C.normalize_author(author)).join(link, "normalized_author")


def retweet_counts(posts: DataFrame) -> DataFrame:
    """(retweeting author, handle) -> retweets."""
    return (posts.withColumn("handle", C.retweet_handle("text")).filter(F.col("handle").isNotNull())
            .groupBy("author", "handle").agg(F.count(F.lit(1)).alias("n")))


def retweet_in_degree(posts: DataFrame, link: DataFrame) -> DataFrame:
    per = retweet_counts(posts).groupBy("handle").agg(F.sum("n").alias("n"))
    return resolve_authors(per, link, "handle").groupBy("global_user_id").agg(F.sum("n").alias("in_degree"))


def node_id(kind: str, key: str) -> Column:
    """Stable id of a node: its type and natural key."""
    return F.concat(F.lit(kind + ":"), F.col(key).cast("string"))


def posted_about(mention_entities: DataFrame, mentions: DataFrame, entities: DataFrame, posts: DataFrame,
                 link: DataFrame) -> DataFrame:
    """USER -> MOVIE edges: weight is the summed engagement score, time the latest mention."""
    m = mentions.select("mention_id", "platform", "post_id", "author", F.col("us").alias("mention_us"))
    p = posts.select("platform", "post_id", E.score().alias("score"))
    rows = D.movie_links(mention_entities, entities).join(m, "mention_id").join(p, ["platform", "post_id"])
    per_author = rows.groupBy("author", "entity_id").agg(F.sum("score").alias("score"), F.max("mention_us").alias("us"))
    return resolve_authors(per_author, link).groupBy("global_user_id", "entity_id").agg(
        F.sum("score").alias("weight"), F.max("us").alias("us"))


def nodes(entities: DataFrame, about: DataFrame) -> DataFrame:
    movies = entities.filter(F.col("type") == "MOVIE").select(
        node_id("MOVIE", "entity_id").alias("id"), F.lit("MOVIE").alias("type"), F.col("name"), F.col("language"))
    users = about.select("global_user_id").distinct().select(
        node_id("USER", "global_user_id").alias("id"), F.lit("USER").alias("type"), F.col("global_user_id").alias("name"),
        F.lit(None).cast("string").alias("language"))
    return movies.unionByName(users)


def edges(about: DataFrame, shared: DataFrame, link: DataFrame) -> DataFrame:
    """POSTED_ABOUT and RETWEETED edges; both ends of a retweet must be user nodes."""
    posted = about.select(node_id("USER", "global_user_id").alias("from_id"), node_id("MOVIE", "entity_id").alias("to_id"),
                          F.lit("POSTED_ABOUT").alias("relation"), F.col("weight").cast("double").alias("weight"), "us")
    users = about.select("global_user_id").distinct()
    r = (shared.withColumn("handle", C.retweet_handle("text")).filter(F.col("handle").isNotNull())
         .groupBy("author", "handle").agg(F.count(F.lit(1)).alias("n"), F.max("us").alias("us")))
    a = resolve_authors(r, link).select(F.col("global_user_id").alias("from_user"), "handle", "n", "us")
    b = resolve_authors(a, link, "handle").select("from_user", F.col("global_user_id").alias("to_user"), "n", "us")
    ends = (b.join(users.withColumnRenamed("global_user_id", "from_user"), "from_user", "left_semi")
            .join(users.withColumnRenamed("global_user_id", "to_user"), "to_user", "left_semi"))
    retweeted = ends.groupBy("from_user", "to_user").agg(F.sum("n").cast("double").alias("weight"), F.max("us").alias("us"))
    return posted.unionByName(retweeted.select(
        node_id("USER", "from_user").alias("from_id"), node_id("USER", "to_user").alias("to_id"),
        F.lit("RETWEETED").alias("relation"), "weight", "us"))


def graph_filter(node: DataFrame, edge: DataFrame, language: str, name: str | None = None):
    """Titles of a language (and name), their users, and every edge among them."""
    pick = (F.col("type") == "MOVIE") & C.same_text("language", F.lit(language))
    if name is not None:
        pick &= C.same_text("name", F.lit(name))
    titles = node.filter(pick)
    touching = edge.filter(F.col("relation") == "POSTED_ABOUT").join(
        titles.select(F.col("id").alias("to_id")), "to_id", "left_semi")
    users = node.join(touching.select(F.col("from_id").alias("id")).distinct(), "id", "left_semi")
    kept = titles.unionByName(users)
    ids = kept.select("id")
    among = (edge.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi")
             .join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi"))
    return kept, among
