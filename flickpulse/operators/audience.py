"""Audience lists, spreaders, viral seeds, author categories and celebrity metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flickpulse.functions import columns as C
from flickpulse.operators import engagement as E
from flickpulse.operators import scale
from flickpulse.operators import timeline as TL
from flickpulse.sources import posts as P


def _per_user(posts: DataFrame, engagement: Column, *more) -> DataFrame:
    return posts.filter(P.has_author()).groupBy(F.col("author").alias("global_user_id")).agg(
        F.count(F.lit(1)).alias("post_count"), F.sum(engagement).alias("total_engagement"), *more)


def affinity(posts: DataFrame, profiles: DataFrame) -> DataFrame:
    """Predicted conversion of the authors in ``posts`` (one keyword's posts), with their profile."""
    raw = F.col("post_count") + F.log10(1.0 + F.greatest("total_engagement", F.lit(0)))
    return (_per_user(posts, E.reach()).join(profiles, "global_user_id")
            .withColumn("affinity_score", C.saturate(raw, 5.0))
            .withColumn("p_conv", C.sigmoid(F.col("affinity_score") * F.coalesce("influence_rank", F.lit(0.0)))))


def keyword_spreaders(posts: DataFrame, profiles: DataFrame, limit: int) -> DataFrame:
    return (_per_user(posts, E.reach()).join(profiles, "global_user_id")
            .orderBy(F.desc("influence_rank"), "global_user_id").limit(limit))


def entity_spreaders(posts: DataFrame, profiles: DataFrame, limit: int) -> DataFrame:
    """Top authors by likes + comments over an entity's keyword set; excitation breaks ties."""
    valid = P.valid_sentiment(posts)
    users = _per_user(valid, F.col("likes") + F.col("comments"), F.sum("likes").alias("total_likes"),
                      F.sum("comments").alias("total_comments"), F.sum("views").alias("total_views"))
    return (users.join(profiles, "global_user_id")
            .withColumn("engagement_per_post", C.round_half_up(F.col("total_engagement") / F.col("post_count"), 0))
            .orderBy(F.desc("total_engagement"), F.desc("influence_rank"), "global_user_id").limit(limit))


def posts_of_keywords(posts: DataFrame, keywords: DataFrame) -> DataFrame:
    """Posts whose keyword is in the set (column ``variant``)."""
    return posts.withColumn("variant", F.lower("keyword")).join(
        keywords.select(F.lower("variant").alias("variant")).distinct(), "variant", "left_semi")


def audience_size(posts: DataFrame, approximate: bool = False) -> Column | DataFrame:
    count = F.approx_count_distinct if approximate else F.countDistinct
    return posts.filter(P.has_author()).agg(count("author").alias("audience_size"))


def top_spreaders(posts: DataFrame, fits: DataFrame, limit: int = 50, min_posts: int = 2) -> DataFrame:
    """Viral potential: (likes + 3*comments) * (1 + alpha) * (1 + log10(1 + views) / 10); positive scores only."""
    per = posts.filter(P.has_author()).groupBy("author").agg(
        F.count(F.lit(1)).alias("n_posts"), F.coalesce(F.sum("likes"), F.lit(0)).alias("total_likes"),
        F.coalesce(F.sum("comments"), F.lit(0)).alias("total_comments"),
        F.coalesce(F.sum("views"), F.lit(0)).alias("total_views"),
        F.avg(F.when(F.col("sentiment_score").between(1, 100), F.col("sentiment_score"))).alias("mean_sentiment"))
    e = F.col("total_likes") + 3.0 * F.col("total_comments")
    multiplier = F.when(F.col("total_views") > 0, 1.0 + F.log10(1.0 + F.col("total_views")) / 10).otherwise(1.0)
    out = (per.filter(F.col("n_posts") >= min_posts).join(fits.select("author", "alpha"), "author")
           .withColumn("engagement_count", e).withColumn("reach_multiplier", multiplier)
           .withColumn("viral_potential_score", e * (1 + F.col("alpha")) * multiplier)
           .withColumn("engagement_rate", F.when(F.col("total_views") > 0, e / F.col("total_views")).otherwise(0.0)))
    return (out.filter(F.col("viral_potential_score") > 0)
            .orderBy(F.desc("viral_potential_score"), F.desc("total_views"), "author").limit(limit))


def seed_reach(posts: DataFrame) -> DataFrame:
    """Reach signals of seeds: X views, Instagram likes, Reddit score, number of YouTube comments."""
    p = F.col("platform")
    total = lambda name, c: F.coalesce(F.sum(F.when(p == name, c)), F.lit(0))
    r = posts.filter(P.has_author()).groupBy("author").agg(
        total("x", F.coalesce("views", F.lit(0))).alias("x_views"),
        total("instagram", F.coalesce("likes", F.lit(0))).alias("instagram_likes"),
        total("reddit", F.coalesce("likes", F.lit(0))).alias("reddit_score"),
        total("youtube", F.lit(1)).alias("youtube_comments"))
    return r.withColumn("total_reach", F.col("x_views") + F.col("instagram_likes") + F.col("reddit_score")
                        + F.col("youtube_comments"))


def seed_weights(profiles: DataFrame, reach: DataFrame, saturation: float = 0.99, moi_range=(0.1, 100.0),
                 reach_range=(1e-4, 1.0), q: float = 0.9) -> DataFrame:
    """One row: 90th percentiles of alpha, MOI and log reach, and the two clamped weights."""
    a = scale.exact_quantiles(profiles.filter((F.col("influence_rank") > 0) & (F.col("influence_rank") < saturation)),
                              "influence_rank", {"q": q})
    m = scale.exact_quantiles(profiles.filter(F.col("moi_score") > 0), "moi_score", {"q": q})
    r = scale.exact_quantiles(reach.filter(F.col("total_reach") > 0).withColumn("l", F.log1p("total_reach")), "l",
                              {"q": q})
    parts = (a.select(F.col("q").alias("alpha"), F.lit(None).cast("double").alias("moi"),
                      F.lit(None).cast("double").alias("log_reach"))
             .unionByName(m.select(F.col("q").alias("moi")), allowMissingColumns=True)
             .unionByName(r.select(F.col("q").alias("log_reach")), allowMissingColumns=True))
    one = parts.agg(F.max("alpha").alias("alpha_p90"), F.max("moi").alias("moi_p90"),
                    F.max("log_reach").alias("log_reach_p90"))
    return (one.withColumn("w_moi", C.clamp(F.col("alpha_p90") / F.col("moi_p90"), *moi_range))
            .withColumn("w_reach", C.clamp(F.col("alpha_p90") / F.col("log_reach_p90"), *reach_range)))


def keyword_authors(posts: DataFrame, keyword: str) -> DataFrame:
    return posts.filter(C.contains_text("keyword", F.lit(keyword))).select(
        F.col("author").alias("global_user_id")).distinct()


def viral_seeds(profiles: DataFrame, posts: DataFrame, keyword: str, weights: DataFrame, reach: DataFrame,
                pool: int = 200, limit: int = 50) -> DataFrame:
    """The most exciting authors on a keyword, scored by alpha + w_moi*MOI + w_reach*ln(1 + reach)."""
    candidates = (profiles.join(keyword_authors(posts, keyword), "global_user_id", "left_semi")
                  .orderBy(F.desc("influence_rank"), "global_user_id").limit(pool))
    w = scale.stage(weights)  # one row
    moi_term = w.select("w_moi").scalar() * F.col("moi_score")
    reach_term = w.select("w_reach").scalar() * F.log1p("total_reach")
    signals = ["x_views", "instagram_likes", "reddit_score", "youtube_comments"]
    names = ["x", "instagram", "reddit", "youtube"]
    best = F.array_max(F.array(*[F.struct(F.col(s).alias("v"), F.lit(-i).alias("i"), F.lit(n).alias("n"))
                                 for i, (s, n) in enumerate(zip(signals, names))]))
    scored = (candidates.join(reach.withColumnRenamed("author", "global_user_id"), "global_user_id")
              .filter(F.col("total_reach") > 0).withColumn("moi_term", moi_term).withColumn("reach_term", reach_term)
              .withColumn("seed_score", F.col("influence_rank") + F.col("moi_term") + F.col("reach_term"))
              .withColumn("primary_platform", best["n"]))
    top = scored.orderBy(F.desc("seed_score"), "global_user_id").limit(limit)
    return top.withColumn("place", F.row_number().over(  # over the 50 report rows
        W.partitionBy(F.lit(0)).orderBy(F.desc("seed_score"), "global_user_id")))


def movie_buffs(posts: DataFrame, categories: DataFrame, tone_floor: float = 75.0, bot_ratio: float = 0.99,
                bot_engagement: float = 20.0) -> DataFrame:
    """Categorised buffs and positive authors never categorised, with ``suspected_bot`` splitting the two lists."""
    per = _per_user(posts, E.reach(), F.avg(F.when(F.col("sentiment_score").between(1, 100),
                                                   F.col("sentiment_score"))).alias("avg_sentiment"))
    j = per.join(categories.withColumnRenamed("author", "global_user_id").withColumn("categorized", F.lit(True)),
                 "global_user_id", "left").na.fill(False, ["categorized"])
    keep = ((F.col("audience_classification") == "Movie Buff")
            | (~F.col("categorized") & (F.col("avg_sentiment") > tone_floor)))
    bot = ((F.col("posting_style") == "Power Burst Poster") & (F.col("branching_ratio") >= bot_ratio)
           & (F.col("total_engagement") / F.col("post_count") < bot_engagement))
    return j.filter(keep).withColumn("suspected_bot", F.coalesce(bot, F.lit(False)))


def uncategorized(posts: DataFrame, categories: DataFrame, tone_floor: float = 75.0) -> DataFrame:
    """Positive authors that have no category row (anti join)."""
    per = _per_user(posts, E.reach(), F.avg(F.when(F.col("sentiment_score").between(1, 100),
                                                   F.col("sentiment_score"))).alias("avg_sentiment"))
    return per.filter(F.col("avg_sentiment") > tone_floor).join(
        categories.select(F.col("author").alias("global_user_id")), "global_user_id", "left_anti")


def _dominant(posts: DataFrame, what: Column, out: str, key: str = "author") -> DataFrame:
    """Most frequent value per key, smallest value on ties; ``what`` has few distinct values."""
    n = posts.groupBy(key, what.alias("value_")).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(key).agg(F.min_by("value_", F.struct(-F.col("n"), "value_")).alias(out))


def author_audit(posts: DataFrame, key: str = "author", kernel: TL.Kernel = TL.PER_MINUTE):
    """Valid posts with excitation, spikes and bursts, plus the fits and burst regions they rest on."""
    valid = scale.stage(TL.excitation(P.valid_sentiment(posts).filter(P.has_author()), [key], kernel))
    fits = scale.stage(TL.hawkes_fit(valid, [key], kernel, bounded_mu=False))
    marked = scale.stage(TL.bursts(TL.spikes(valid, [key], fits, kernel), [key]))
    return fits, marked, TL.burst_regions(marked, [key])


def author_categories(posts: DataFrame, min_posts: int = 5, kernel: TL.Kernel = TL.PER_MINUTE) -> DataFrame:
    """Tone, platform, audience, tier, style and ratio of every author with more than ``min_posts`` valid posts."""
    fits, marked, regions = author_audit(posts, kernel=kernel)
    style = regions.groupBy("author").agg(F.count(F.lit(1)).alias("n_regions"), F.max("n_posts").alias("largest"))
    return (fits.filter(F.col("n") > min_posts)
            .join(_dominant(marked, C.tone("sentiment_score"), "dominant_tone"), "author")
            .join(_dominant(marked, F.col("platform"), "primary_platform"), "author").join(style, "author", "left")
            .select("author", C.audience_type("dominant_tone", "branching_ratio").alias("audience_classification"),
                    C.influence_tier("branching_ratio").alias("influence_tier"),
                    C.posting_style("n_regions", "largest").alias("posting_style"), "dominant_tone",
                    "primary_platform", C.round_half_up("branching_ratio", 4).alias("branching_ratio"),
                    F.col("n").alias("total_posts")))


def filter_authors(categories: DataFrame, min_posts: int = 5, **wanted) -> DataFrame:
    """AND of equality filters on the category columns; ``None`` means any."""
    out = categories.filter(F.col("total_posts") > min_posts)
    for column, value in wanted.items():
        if value is not None:
            out = out.filter(F.col(column) == value)
    return out


def distinct_values(categories: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct (column, value) pairs of all category columns in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"))
                                for c in columns])).alias("p")
    return categories.select(pairs).select("p.*").filter(F.col("value").isNotNull()).distinct()


def sentiment_distribution(posts: DataFrame, by: list[str]) -> DataFrame:
    """Share of each sentiment category per key, over posts with a non-zero score."""
    n = P.valid_sentiment(posts, ranged=False).filter(F.col("sentiment_category").isNotNull()).groupBy(
        *by, "sentiment_category").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(*by)))  # a few categories per key


def sentiment_stats(posts: DataFrame, key: str) -> DataFrame:
    """Tone counts, net tone, spread of score/100, and share of in-burst posts that are negative."""
    t = C.tone("sentiment_score")
    count = lambda cond: F.count(F.when(cond, 1))
    inside = F.col("burst") > 0
    out = posts.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), count(t == "positive").alias("positive"), count(t == "negative").alias("negative"),
        count(t == "neutral").alias("neutral"), F.stddev_pop(F.col("sentiment_score") / 100).alias("spread"),
        count(inside).alias("in_burst"), count(inside & (t == "negative")).alias("in_burst_negative"))
    return (out.withColumn("net", (F.col("positive") - F.col("negative")) / F.col("n"))
            .withColumn("burst_negative_share", F.when(F.col("in_burst") > 0, F.col("in_burst_negative") / F.col("in_burst"))
                        .otherwise(0.0)))


def celebrity_metrics(rows: DataFrame) -> DataFrame:
    """Ten bounded sub-scores and six indices from one aggregate row per entity.

    Input columns: reach, followers, branching_ratio, engagement, posts, net, spread, burst_negative_share,
    negative_share, advocates (share of positive authors), days.
    """
    c = F.col
    out = (rows.withColumn("s_reach", C.log_saturate("reach", 4)).withColumn("s_audience", C.log_saturate("followers", 2))
           .withColumn("s_virality", C.clamp("branching_ratio"))
           .withColumn("s_engagement", F.when(c("posts") > 0, C.log_saturate(c("engagement") / c("posts"), 2)).otherwise(0.0))
           .withColumn("s_per_follower", F.when(c("followers") > 0, C.log_saturate(c("engagement") / c("followers"), 2)).otherwise(0.0))
           .withColumn("s_repeat", F.when(c("followers") > 0, C.saturate(c("posts") / c("followers") - 1, 1)).otherwise(0.0))
           .withColumn("s_positive", C.clamp((c("net") + 1) / 2)).withColumn("s_volatility", C.clamp(2 * c("spread")))
           .withColumn("s_burst", C.clamp("burst_negative_share")).withColumn("s_negative", C.clamp("negative_share")))
    out = (out.withColumn("influence", 100 * (.5 * c("s_virality") + .3 * c("s_audience") + .2 * c("s_reach")))
           .withColumn("brand_power", 100 * (.3 * c("s_reach") + .2 * c("s_audience") + .2 * c("s_engagement")
                                             + .15 * c("s_virality") + .15 * c("s_positive")))
           .withColumn("loyalty", 100 * (.35 * c("s_repeat") + .3 * c("s_positive") + .2 * c("s_per_follower")
                                         + .15 * C.clamp("advocates")))
           .withColumn("controversy", 100 * (.5 * c("s_negative") + .3 * c("s_volatility") + .2 * c("s_burst"))))
    return (out.withColumn("endorsement", 100 * (.35 * c("s_reach") + .25 * c("s_positive") + .2 * c("loyalty") / 100
                                                 + .2 * c("influence") / 100) * (1 - .7 * c("controversy") / 100))
            .withColumn("brand_value", c("reach") / c("days") * 365 / 1000 * 22 * (.5 + 1.5 * c("brand_power") / 100)
                        * (1 - .5 * c("controversy") / 100)))
