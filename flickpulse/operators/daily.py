"""Daily momentum, behaviour features and causal lift per entity.

Mention-level joins happen once; everything after works on (entity, day) rows. Windows are per entity over days, so
their length is bounded by the calendar, however many mentions an entity has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flickpulse.functions import columns as C
from flickpulse.functions.vocab import PLATFORMS
from flickpulse.operators import engagement as E
from flickpulse.operators import scale

DAY_US = 86_400_000_000


def _days(start: int, end: int, order: str = "day_no"):
    return W.partitionBy("entity_id").orderBy(order).rangeBetween(start, end)


def movie_links(mention_entities: DataFrame, entities: DataFrame) -> DataFrame:
    movies = entities.filter(F.col("type") == "MOVIE").select(F.col("entity_id").alias("managed_entity_id"))
    return mention_entities.join(movies, "managed_entity_id", "left_semi").withColumnRenamed("managed_entity_id",
                                                                                             "entity_id")


def movie_posts(mention_entities: DataFrame, mentions: DataFrame, entities: DataFrame, posts: DataFrame) -> DataFrame:
    """Bridge -> mention -> platform post for movie entities, one join on (platform, post id) for all platforms."""
    m = mentions.select("mention_id", "platform", "post_id")
    p = posts.filter(F.col("us").isNotNull()).select(
        "platform", "post_id", "author", "content_intent", scale.bucket_of("us", DAY_US).alias("day_no"),
        E.score().alias("score"))
    return movie_links(mention_entities, entities).join(m, "mention_id").join(p, ["platform", "post_id"])


def activity_cube(linked_posts: DataFrame) -> DataFrame:
    """The linked posts summed to (entity, day, platform, author, intent): every daily feature starts here."""
    return linked_posts.groupBy("entity_id", "day_no", "platform", "author", "content_intent").agg(
        F.sum("score").alias("score"), F.count(F.lit(1)).alias("n"))


def daily_volume(cube: DataFrame) -> DataFrame:
    return cube.groupBy("entity_id", "day_no").agg(F.sum("score").alias("volume"))


def vmi_daily(volume: DataFrame, entities: DataFrame) -> DataFrame:
    """Day index from the entity's first day, running volume, and z-score among the cohort on the same index."""
    w = W.partitionBy("entity_id")
    d = (volume.withColumn("day_index", F.col("day_no") - F.min("day_no").over(w))
         .withColumn("cumulative", F.sum("volume").over(
             w.orderBy("day_index").rowsBetween(W.unboundedPreceding, W.currentRow)))
         .join(entities.select("entity_id", "industry", "language"), "entity_id"))
    cohort = d.groupBy("industry", "language", "day_index").agg(
        F.count(F.lit(1)).alias("peers"), F.avg("volume").alias("mean"), F.stddev_pop("volume").alias("sd"))
    z = F.when(F.col("peers") >= 4, F.when(F.col("sd") > 0, (F.col("volume") - F.col("mean")) / F.col("sd"))
               .otherwise(0.0))
    # null industry or language is one cohort of its own, hence null-safe equality
    cohort = cohort.toDF("c_industry", "c_language", "c_index", "peers", "mean", "sd")
    on = (F.col("industry").eqNullSafe(F.col("c_industry")) & F.col("language").eqNullSafe(F.col("c_language"))
          & (F.col("day_index") == F.col("c_index")))
    return d.join(cohort, on, "left").select("entity_id", "day_index", "day_no", "volume",
                                             z.alias("cohort_zscore"), "cumulative")


def peak_and_total(vmi: DataFrame) -> DataFrame:
    """Day of the largest volume (earliest on ties) and volume to date."""
    return vmi.groupBy("entity_id").agg(
        F.max_by("day_index", F.struct("volume", -F.col("day_index"))).alias("peak_day_index"),
        F.max("volume").alias("peak_volume"), F.max_by("cumulative", "day_index").alias("vmi_to_date"))


def mention_daily(mention_entities: DataFrame, mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """Mentions, positives, negatives per (entity, day); labels are compared in upper case."""
    s = F.upper("sentiment")
    return (movie_links(mention_entities, entities)
            .join(mentions.select("mention_id", "day_no", "sentiment"), "mention_id")
            .groupBy("entity_id", "day_no").agg(
        F.count(F.lit(1)).alias("mentions"), F.count(F.when(s == "POSITIVE", 1)).alias("positive"),
        F.count(F.when(s == "NEGATIVE", 1)).alias("negative")))


def net_sentiment(positive: Column, negative: Column) -> Column:
    return F.when(negative > 0, positive / negative).otherwise(0.0)


def trailing_ratio(first: int, last: int) -> Column:
    """Positive over negative mentions of the calendar days [first, last] relative to the row's day."""
    total = lambda c: F.coalesce(F.sum(c).over(_days(first, last)), F.lit(0))
    return net_sentiment(total("positive"), total("negative"))


def trailing_sentiment(daily: DataFrame) -> DataFrame:
    now, before = trailing_ratio(-6, 0), trailing_ratio(-7, -1)
    return daily.select("entity_id", "day_no", now.alias("trailing_ratio"),
                        (now - before).alias("net_sentiment_delta"))


def intent_mix(cube: DataFrame) -> DataFrame:
    """(entity, day) -> map intent -> posts; the number of intents is a small fixed set."""
    per = cube.filter(F.col("content_intent").isNotNull()).groupBy("entity_id", "day_no", "content_intent").agg(
        F.sum("n").alias("n"))
    return per.groupBy("entity_id", "day_no").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("content_intent", "n")))).alias("intent_mix"))


def spillover(cube: DataFrame, threshold: float = 1.5) -> DataFrame:
    """Platform whose volume most exceeds its mean of the 7 days before; the divisor is always 7."""
    wide = cube.groupBy("entity_id", "day_no").agg(
        *[F.coalesce(F.sum(F.when(F.col("platform") == p, F.col("score"))), F.lit(0.0)).alias(p) for p in PLATFORMS])
    ratios = []
    for i, p in enumerate(PLATFORMS):
        base = F.coalesce(F.sum(p).over(_days(-7, -1)), F.lit(0.0)) / 7
        ratios.append(F.struct(F.when(base > 0, F.col(p) / base).otherwise(0.0).alias("ratio"),
                               F.lit(-i).alias("rank"), F.lit(p).alias("platform")))
    best = F.array_max(F.array(*ratios))
    return wide.select("entity_id", "day_no", F.when(best["ratio"] > threshold, best["platform"])
                       .alias("spillover_event"))


def spreader_share(cube: DataFrame, rating: DataFrame) -> DataFrame:
    """Share of the day's volume from authors at or above the 90th rating percentile."""
    p90 = scale.exact_quantiles(rating, "engagement_rating", {"p90": 0.9})
    top = (rating.filter(F.col("engagement_rating") >= p90.scalar()).select("author", F.lit(True).alias("top")))
    per = cube.groupBy("entity_id", "day_no", "author").agg(F.sum("score").alias("score"))
    share = F.sum(F.when(F.col("top"), F.col("score")).otherwise(0.0)) / F.sum("score")
    return per.join(top, "author", "left").groupBy("entity_id", "day_no").agg(
        F.when(F.sum("score") > 0, share).otherwise(0.0).alias("spreader_tier_share"))


def cascade_depth(cube: DataFrame, link: DataFrame, degrees: DataFrame) -> DataFrame:
    """Mean retweet in-degree of the day's distinct resolved authors; ``degrees``: global_user_id, in_degree."""
    authors = (cube.select("entity_id", "day_no", "author").distinct()
               .withColumn("normalized_author", C.normalize_author("author")).join(link, "normalized_author")
               .join(degrees, "global_user_id", "left"))
    return authors.groupBy("entity_id", "day_no").agg(
        F.avg(F.coalesce("in_degree", F.lit(0))).alias("cascade_depth"))


def behavior_daily(vmi: DataFrame, cube: DataFrame, daily: DataFrame, rating: DataFrame, link: DataFrame,
                   degrees: DataFrame) -> DataFrame:
    keys = ["entity_id", "day_no"]
    out = vmi.select(*keys, "day_index")
    for part in (daily.select(*keys, F.col("mentions").alias("comment_velocity")), intent_mix(cube),
                 trailing_sentiment(daily).select(*keys, "net_sentiment_delta"), spreader_share(cube, rating),
                 cascade_depth(cube, link, degrees), spillover(cube)):
        out = out.join(part, keys, "left")
    return out.na.fill(0, ["comment_velocity"]).na.fill(0.0, ["net_sentiment_delta", "spreader_tier_share",
                                                             "cascade_depth"])


def trend_fit(vmi: DataFrame) -> DataFrame:
    """Least squares of cumulative volume on day index over the 7 indices before, and the value 3 indices later."""
    w = _days(-7, -1, "day_index")
    y, x = F.col("cumulative"), F.col("day_index").cast("double")
    n, sxx = F.count(y).over(w), F.regr_sxx(y, x).over(w)
    sxy, syy = F.regr_sxy(y, x).over(w), F.regr_syy(y, x).over(w)
    slope = sxy / sxx
    level = F.avg(y).over(w) - slope * F.avg(x).over(w)
    fit = vmi.select("entity_id", "day_no", "day_index", n.alias("n_points"), slope.alias("slope"),
                     level.alias("intercept"), ((syy - sxy * sxy / sxx) / n).alias("variance"),
                     F.max("cumulative").over(_days(3, 3, "day_index")).alias("actual_plus_3"))
    return fit.filter(F.col("n_points") >= 2)


def own_threshold(ratios: DataFrame) -> DataFrame:
    """The entity's own 75th percentile of the trailing ratio (days per entity are bounded)."""
    return ratios.withColumn("threshold", F.percentile("trailing_ratio", 0.75).over(W.partitionBy("entity_id")))


def lift_events(vmi: DataFrame, daily: DataFrame) -> DataFrame:
    """Qualifying (entity, day): ratio at or above the own threshold, a trend of 2+ points, a value 3 days later."""
    joined = vmi.select("entity_id", "day_no", "day_index").join(
        trailing_on_days(vmi, daily), ["entity_id", "day_no"])
    q = own_threshold(joined).filter(F.col("trailing_ratio") >= F.col("threshold"))
    e = q.join(trend_fit(vmi).drop("day_index"), ["entity_id", "day_no"]).filter(F.col("actual_plus_3").isNotNull())
    projected = F.col("intercept") + F.col("slope") * (F.col("day_index") + 3)
    return e.select("entity_id", "day_no", ((F.col("actual_plus_3") - projected)
                                            / F.greatest(projected, F.lit(1.0))).alias("lift"), "variance")


def trailing_on_days(vmi: DataFrame, daily: DataFrame) -> DataFrame:
    """Trailing ratio for every volume day, also days without a mention row of their own."""
    days = vmi.select("entity_id", "day_no").withColumn("wanted", F.lit(True))
    all_days = daily.join(days, ["entity_id", "day_no"], "full")
    return (all_days.withColumn("trailing_ratio", trailing_ratio(-6, 0)).filter("wanted")
            .select("entity_id", "day_no", "trailing_ratio"))


def causal_lift(events: DataFrame, authors_by_day: DataFrame, link: DataFrame) -> DataFrame:
    """Inverse-variance mean lift per resolved user; a single event counts unweighted."""
    resolved = (authors_by_day.select("entity_id", "day_no", C.normalize_author("author").alias("normalized_author"))
                .join(link, "normalized_author").select("entity_id", "day_no", "global_user_id").distinct())
    weight = 1 / F.greatest(F.col("variance"), F.lit(1e-6))
    return (resolved.join(events, ["entity_id", "day_no"]).groupBy("global_user_id").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.when(F.count(F.lit(1)) == 1, F.max("lift")).otherwise(F.sum(weight * F.col("lift")) / F.sum(weight))
        .alias("causal_lift_score"))
        .withColumn("confidence", F.when(F.col("n_events") >= 3, F.lit("HIGH")).otherwise(F.lit("LOW"))))
