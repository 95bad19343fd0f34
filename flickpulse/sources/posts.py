"""Four platform tables as one posts table, and the scans over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flickpulse.functions import columns as C
from flickpulse.sources import schemas as S


def unify(x: DataFrame, youtube: DataFrame, reddit: DataFrame, instagram: DataFrame) -> DataFrame:
    """One wide posts table. Reddit content is title and text; a null title or text counts as empty."""
    common = ["keyword", "sentiment_category", "sentiment_score", "permalink", "author", "content_intent"]
    x, youtube = S.with_missing(x, S.X_POSTS), S.with_missing(youtube, S.YOUTUBE_COMMENTS)
    reddit, instagram = S.with_missing(reddit, S.REDDIT_POSTS), S.with_missing(instagram, S.INSTAGRAM_POSTS)

    def part(df, platform, time, likes, comments, content=F.col("text"), **extra):
        return df.select(F.col("id").alias("post_id"), F.lit(platform).alias("platform"), content.alias("content"),
                         F.col(time).alias("ts"), F.col(likes).cast("bigint").alias("likes"),
                         F.col(comments).cast("bigint").alias("comments"), *common,
                         *[F.col(c).cast(t).alias(n) for n, (c, t) in extra.items()])

    both = F.trim(F.concat_ws(" ", "title", "text"))
    parts = [part(x, "x", "created_at", "likes_count", "comment_count",
                  views=("views_count", "bigint"), shares=("shares_count", "bigint")),
             part(youtube, "youtube", "published_at", "likes_count", "reply_count"),
             part(reddit, "reddit", "created_at", "score", "num_comments", both, title=("title", "string")),
             part(instagram, "instagram", "timestamp", "like_count", "comments_count",
                  media_type=("media_type", "string"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def valid_sentiment(df: DataFrame, ranged: bool = True) -> DataFrame:
    """Score 0 marks an invalid sentiment: keep 1-100, or (``ranged=False``) anything but 0."""
    s = F.col("sentiment_score")
    return df.filter(s.between(1, 100) if ranged else s != 0)


def has_author() -> Column:
    return F.col("author").isNotNull() & (F.trim("author") != "")


def for_keyword(df: DataFrame, keyword: str, platform: str | None = None) -> DataFrame:
    hit = df.filter(C.same_text("keyword", F.lit(keyword)))
    return hit.filter(F.col("platform") == platform) if platform else hit


def newest_page(df: DataFrame, page: int, size: int, tie: str = "post_id") -> DataFrame:
    """One page, newest first, undated rows last. Plans as a bounded top-k."""
    return df.orderBy(F.col("us").desc_nulls_last(), F.col(tie)).offset(page * size).limit(size)


def page_with_total(df: DataFrame, page: int, size: int) -> DataFrame:
    total = df.agg(F.count(F.lit(1)).alias("n"))
    return newest_page(df, page, size).withColumn("total", total.scalar())


def newest_per(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The ``n`` newest rows per key; the limit is applied before the shuffle too, so a busy key stays small."""
    w = W.partitionBy(*keys).orderBy(F.col("us").desc_nulls_last(), F.col("post_id"))
    return df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)


def recent(df: DataFrame, as_of_us: Column, days: int = 90) -> DataFrame:
    """Last ``days`` days before ``as_of``; views required on x only; valid sentiment."""
    return valid_sentiment(df.filter((F.col("us") >= as_of_us - F.lit(days * 86_400_000_000))
                                     & ((F.col("platform") != "x") | (F.col("views") > 0))))
