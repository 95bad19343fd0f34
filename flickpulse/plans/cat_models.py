"""Queries over models, clusters, recommendations and composed reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from flickpulse.operators import engagement as E
from flickpulse.operators import graph as G
from flickpulse.operators import models as M
from flickpulse.operators import reports as R
from flickpulse.operators import scale
from flickpulse.operators import text as X
from flickpulse.operators import timeline as TL
from flickpulse.plans.cat_text import NOUNS
from flickpulse.plans.cat_timeline import AUDIT, LEVELS
from flickpulse.plans.registry import query
from flickpulse.sources import files as S


def frame(t):
    return scale.stage(M.model_frame(t.titles))


def disclosed(t):
    return scale.stage(M.model_frame(t.titles).filter("disclosed = 1"))


def disclosure(t):
    return M.disclosure_model(M.disclosure_frame(t.titles))


GUESS = """
    g AS (SELECT revenue, ln(revenue) AS y, ln(budget) - 0.3 AS p FROM titles WHERE budget > 0 AND revenue > 0),
    e AS (SELECT *, abs(exp(p) - revenue)/revenue AS err FROM g)"""


def guesses(t):
    """A fixed-share guess (revenue = 0.74 x budget) for every disclosed title, to exercise the accuracy measures."""
    return t.titles.filter("budget > 0 AND revenue > 0").select(
        "revenue", F.log("revenue").alias("ln_revenue"), (F.log("budget") - 0.3).alias("prediction"))


@query("regression_metrics", GUESS + """
    SELECT round(1 - sum((y-p)*(y-p))/(var_pop(y)*count(*)),6)+0.0 AS r2, round(avg(abs(y-p)),6) AS mae,
           round(100*avg(err),5) AS mape FROM e""")
def regression_metrics(t):
    return M.regression_metrics(guesses(t)).withColumn("mape", F.round("mape", 5))


@query("run_accuracy", GUESS + """
    SELECT count(*) AS n, round(100*avg((err <= .2)::int),6) AS within_20, round(100*avg((err <= .3)::int),6) AS within_30,
           round(100*avg((err <= .5)::int),6) AS within_50, round(100*median(err),6) AS median_error FROM e""")
def run_accuracy(t):
    return M.run_accuracy(guesses(t))


@query("oof_predict")
def oof_predict(t):
    return M.oof_predict(disclosed(t), M.FEATURES).select("title_id", "fold", "ln_revenue", "prediction")


@query("compare_models")
def compare_models(t):
    return M.compare_models(disclosed(t), M.FEATURES)


@query("market_comparison")
def market_comparison(t):
    return M.market_comparison(disclosed(t), M.FEATURES)


@query("disclosure_model")
def disclosure_model(t):
    return disclosure(t)


@query("ipw_weights", """
    p AS (SELECT title_id, CASE WHEN imdb_rating > 0 THEN imdb_rating/10 END AS p FROM titles)
    SELECT title_id, round(least(greatest(1/least(greatest(coalesce(p, (SELECT median(p) FROM p)), 1e-3), 1), 1), 20),6) AS weight
    FROM p""")
def ipw_weights(t):
    scored = t.titles.select("title_id", F.when(F.col("imdb_rating") > 0, F.col("imdb_rating") / 10).alias("p_disclosed"))
    return M.ipw_weights(scored).select("title_id", "weight")


@query("compare_weighting")
def compare_weighting(t):
    return M.compare_weighting(disclosed(t), M.ipw_weights(disclosure(t)), M.FEATURES)


@query("bootstrap_coefficients")
def bootstrap_coefficients(t):
    return M.bootstrap_coefficients(disclosed(t), M.FEATURES)


@query("confidence_band")
def confidence_band(t):
    return M.confidence_band(disclosed(t), disclosure(t), M.FEATURES, resampled="gbt_band_fast")


@query("partial_dependence")
def partial_dependence(t):
    f = disclosed(t)
    model = M.pipeline(M.FEATURES, M.regressor("gbt")).fit(f)
    return M.partial_dependence(f.select("title_id", *M.FEATURES), model, {"imdb_rating": (0.0, 10.0), "runtime_mins": (90.0, 230.0)})


@query("formula_reconstruct", """
    SELECT title_id, round(ln(budget) + ln(1 + 0.0 + least(greatest(imdb_rating/10 / 0.4, 0), 1)*(0.4*1.6))
           + ln(1 + -0.3*0.3 + least(greatest((least(greatest(runtime_mins-160,0),60)/-200 + 0.3)/0.3, 0), 1)*(0.3*0.3)),6) AS ln_prediction
    FROM titles WHERE budget > 0""")
def formula_reconstruct(t):
    over = F.least(F.greatest(F.col("runtime_mins") - 160, F.lit(0)), F.lit(60))
    rows = t.titles.filter("budget > 0").select("title_id", F.log("budget").alias("baseline"),
                                                (F.col("imdb_rating") / 10).alias("rating"), (over / -200).alias("excess"))
    return M.formula_reconstruct(rows, {"rating": (0.0, 0.4), "excess": (-0.3, 0.0)}, {"rating": 2.5, "excess": 0.1})


@query("predict_upcoming")
def predict_upcoming(t):
    f = frame(t)
    return M.predict_upcoming(f, f.filter("disclosed = 0"), M.FEATURES, S.shared_folder(t.spark))


@query("backtest_table", """
    SELECT o_orderkey AS title_id, year(o_orderdate) AS release_year, o_totalprice AS predicted, rev AS actual
    FROM orders JOIN title_rev ON l_orderkey = o_orderkey ORDER BY release_year DESC, title_id LIMIT 50 OFFSET 100""")
def backtest_table(t):
    rows = t.orders.join(t.title_rev, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_orderkey").alias("title_id"), F.year("o_orderdate").alias("release_year"),
        F.col("o_totalprice").alias("predicted"), F.col("rev").alias("actual"))
    return M.backtest_page(rows, 2, 50)


def persona(t):
    return E.moi(t.posts_bursty).join(TL.hawkes_fit(t.posts_bursty, ["author"], TL.HOURLY).select("author", "alpha"), "author")


@query("tribes")
def tribes(t):
    return M.tribes(persona(t), X.aspect_terms(t.posts, NOUNS)).select("author", "tribe", "moi", "alpha")


@query("tribe_summary")
def tribe_summary(t):
    return M.tribe_summary(M.tribes(persona(t), X.aspect_terms(t.posts, NOUNS)))


@query("persona_profiles")
def persona_profiles(t):
    p = R.persona_profiles(t.posts_bursty)
    return p.withColumn("by_platform", F.to_json("by_platform"))


@query("user_report", AUDIT + """,
    sx AS (SELECT author, count(*) FILTER (sentiment_score > 75) AS positive, count(*) FILTER (sentiment_score < 50) AS negative,
                  (count(*) FILTER (sentiment_score > 75) - count(*) FILTER (sentiment_score < 50))/count(*) AS net,
                  count(*) FILTER (burst > 0) AS in_burst FROM bur GROUP BY 1)
    SELECT f.author, f.n, round(alpha,5) AS alpha, round(branching_ratio,5) AS branching_ratio, positive, negative,
           round(net,6)+0.0 AS net, in_burst, n_regions, largest AS largest_burst, platform AS primary_platform,
           CASE WHEN net >= 0.3 THEN 'Predominantly Positive' WHEN net >= 0.05 THEN 'Leaning Positive'
                WHEN net > -0.05 THEN 'Mixed / Neutral' WHEN net > -0.3 THEN 'Leaning Negative'
                ELSE 'Predominantly Negative' END AS sentiment_label
    FROM fit f JOIN sx USING (author) JOIN pp USING (author) LEFT JOIN rg USING (author)""", recursive=True)
def user_report(t):
    return R.report(t.posts_bursty, "author").select(
        "author", "n", F.round("alpha", 5).alias("alpha"), F.round("branching_ratio", 5).alias("branching_ratio"), "positive",
        "negative", "net", "in_burst", "n_regions", "largest_burst", "primary_platform", "sentiment_label")


@query("user_report_topics", AUDIT + "," + LEVELS + """
    SELECT b.author, keyword, count(*) AS n, round(avg(sentiment_score),5) AS mean_sentiment,
           count(*) FILTER (burst > 0) AS in_burst, round(avg((sentiment_score > 75)::int),5) AS positive_share,
           round(avg(spike),4) AS mean_spike
    FROM bur b JOIN lv ON lv.author = b.author AND lv.post_id = b.post_id GROUP BY 1, 2""", recursive=True)
def user_report_topics(t):
    r = lambda c, d: F.round(c, d).alias(c)
    return R.topic_table(t.posts_bursty, "author").select(
        "author", "keyword", "n", r("mean_sentiment", 5), "in_burst", r("positive_share", 5), r("mean_spike", 4))


@query("user_report_flags")
def user_report_flags(t):
    return R.flags(R.report(t.posts_bursty, "author"))


@query("entity_report")
def entity_report(t):
    names = t.entity_keywords.join(t.entities.select("entity_id", "name"), "entity_id").select(
        F.lower("keyword").alias("kw"), "name").distinct()
    # a keyword's posts meet its names in many tasks: every name stands in each of ``parts`` shares of the posts
    parts = max(int(t.spark.conf.get("spark.sql.shuffle.partitions")), 3 * t.spark.sparkContext.defaultParallelism)
    shares = names.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    spread = t.posts_bursty.withColumns({"kw": F.lower("keyword"), "share": F.pmod(F.xxhash64("post_id"), F.lit(parts))})
    posts = (spread.repartition(parts, "kw", "share").join(shares, ["kw", "share"]).drop("kw", "share")
             .withColumnRenamed("name", "entity"))
    return R.report(posts, "entity")


@query("recommend_items")
def recommend_items(t):
    return M.recommend_items(M.preferences(t.posts_lean, t.identity_link), 5)


@query("untapped_audience")
def untapped_audience(t):
    users = G.resolve_authors(t.posts_lean, t.identity_link)
    reach = users.groupBy("global_user_id").agg(F.sum(F.when(F.col("platform") == "x", F.col("views")).otherwise(0)).alias("views"))
    activity = users.groupBy("global_user_id", "platform").agg(F.count(F.lit(1)).alias("n"))
    seeds = reach.orderBy(F.desc("views"), "global_user_id").limit(5).select("global_user_id")
    return M.untapped_audience(M.preferences(t.posts_lean, t.identity_link), seeds, reach, activity)
