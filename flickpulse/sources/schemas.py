"""Schemas of the platform tables, and a reader helper that back-fills missing columns with nulls."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


TYPES = {"string": T.StringType(), "timestamp": T.TimestampType(), "double": T.DoubleType(), "int": T.IntegerType()}


def _schema(text: str) -> T.StructType:
    pairs = [f.split() for f in text.split(",")]
    return T.StructType([T.StructField(name, TYPES[kind]) for name, kind in pairs])


X_POSTS = _schema("id string, text string, created_at timestamp, keyword string, sentiment_category string, "
                  "sentiment_score double, permalink string, author string, likes_count int, comment_count int, "
                  "views_count int, shares_count int, content_intent string")
YOUTUBE_COMMENTS = _schema("id string, video_id string, video_title string, text string, author string, "
                           "published_at timestamp, permalink string, keyword string, sentiment_category string, "
                           "sentiment_score double, likes_count int, reply_count int, content_intent string")
REDDIT_POSTS = _schema("id string, title string, text string, created_at timestamp, keyword string, "
                       "sentiment_category string, sentiment_score double, permalink string, author string, "
                       "score int, num_comments int, content_intent string")
INSTAGRAM_POSTS = _schema("id string, text string, media_type string, media_url string, permalink string, "
                          "timestamp timestamp, keyword string, sentiment_category string, sentiment_score double, "
                          "author string, like_count int, comments_count int, content_intent string")


def with_missing(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the columns of ``schema``; those absent from ``df`` become nulls."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                       for f in schema.fields])
