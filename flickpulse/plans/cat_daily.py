"""Queries over entities and their daily series."""

from __future__ import annotations

from pyspark.sql import functions as F

from flickpulse.operators import daily as D
from flickpulse.operators import engagement as E
from flickpulse.plans.cat_posts import SCORE
from flickpulse.plans.registry import query

LINKED = f"""
    links AS (SELECT me.mention_id, me.managed_entity_id AS entity_id FROM mention_entities me
              JOIN entities e ON e.entity_id = me.managed_entity_id AND e.type = 'MOVIE'),
    linked AS (SELECT l.entity_id, p.us // 86400000000 AS day_no, p.platform, p.author, p.content_intent,
                      {SCORE.replace('platform', 'p.platform')} AS score
               FROM links l JOIN mentions m ON m.mention_id = l.mention_id
               JOIN posts_lean p ON p.platform = m.platform AND p.post_id = m.post_id)"""
VMI = LINKED + """,
    vol AS (SELECT entity_id, day_no, sum(score) AS volume FROM linked GROUP BY 1, 2),
    idx AS (SELECT v.*, day_no - min(day_no) OVER (PARTITION BY v.entity_id) AS day_index, e.industry, e.language
            FROM vol v JOIN entities e ON e.entity_id = v.entity_id),
    vmi AS (SELECT entity_id, day_index, day_no, volume,
                   CASE WHEN count(*) OVER c < 4 THEN NULL WHEN stddev_pop(volume) OVER c = 0 THEN 0
                        ELSE (volume - avg(volume) OVER c) / stddev_pop(volume) OVER c END AS cohort_zscore,
                   sum(volume) OVER (PARTITION BY entity_id ORDER BY day_index) AS cumulative
            FROM idx WINDOW c AS (PARTITION BY industry, language, day_index))"""
DAILY = """
    daily AS (SELECT l.entity_id, m.day_no, count(*) AS mentions, count(*) FILTER (sentiment='POSITIVE') AS positive,
                     count(*) FILTER (sentiment='NEGATIVE') AS negative
              FROM links l JOIN mentions m ON m.mention_id = l.mention_id GROUP BY 1, 2)"""
TRAIL = """
    trail AS (SELECT v.entity_id, v.day_no, v.day_index,
                     coalesce(sum(positive) FILTER (d.day_no BETWEEN v.day_no-6 AND v.day_no),0) AS p0,
                     coalesce(sum(negative) FILTER (d.day_no BETWEEN v.day_no-6 AND v.day_no),0) AS n0,
                     coalesce(sum(positive) FILTER (d.day_no BETWEEN v.day_no-7 AND v.day_no-1),0) AS p1,
                     coalesce(sum(negative) FILTER (d.day_no BETWEEN v.day_no-7 AND v.day_no-1),0) AS n1
              FROM vmi v LEFT JOIN daily d ON d.entity_id = v.entity_id AND d.day_no BETWEEN v.day_no-7 AND v.day_no
              GROUP BY 1, 2, 3),
    ratio AS (SELECT entity_id, day_no, day_index, CASE WHEN n0>0 THEN p0/n0 ELSE 0 END AS trailing_ratio,
                     CASE WHEN n0>0 THEN p0/n0 ELSE 0 END - CASE WHEN n1>0 THEN p1/n1 ELSE 0 END
                         AS net_sentiment_delta FROM trail)"""
FIT = """
    fit AS (SELECT v.entity_id, v.day_no, v.day_index, count(*) AS n_points, regr_slope(b.cumulative, b.day_index) AS slope,
                   regr_intercept(b.cumulative, b.day_index) AS intercept,
                   (regr_syy(b.cumulative, b.day_index) - regr_sxy(b.cumulative, b.day_index)
                    * regr_sxy(b.cumulative, b.day_index) / regr_sxx(b.cumulative, b.day_index)) / count(*) AS variance,
                   max(a.cumulative) AS actual_plus_3
            FROM vmi v JOIN vmi b ON b.entity_id = v.entity_id AND b.day_index BETWEEN v.day_index-7 AND v.day_index-1
            LEFT JOIN vmi a ON a.entity_id = v.entity_id AND a.day_index = v.day_index + 3
            GROUP BY 1, 2, 3 HAVING count(*) >= 2)"""
EVENTS = """
    thr AS (SELECT entity_id, quantile_cont(trailing_ratio, 0.75) AS threshold FROM ratio GROUP BY 1),
    events_ AS (SELECT r.entity_id, r.day_no, (actual_plus_3 - (intercept + slope*(r.day_index+3)))
                       / greatest(intercept + slope*(r.day_index+3), 1.0) AS lift, variance
                FROM ratio r JOIN thr USING (entity_id) JOIN fit f ON f.entity_id=r.entity_id AND f.day_no=r.day_no
                WHERE trailing_ratio >= threshold AND actual_plus_3 IS NOT NULL)"""


def linked(t):
    return D.movie_posts(t.mention_entities, t.mentions, t.entities, t.posts_lean)


def cube(t):
    return D.activity_cube(linked(t))


def vmi(t):
    return D.vmi_daily(D.daily_volume(linked(t)), t.entities)


def daily(t):
    return D.mention_daily(t.mention_entities, t.mentions, t.entities)


@query("mention_entity_post_join", LINKED + """
    SELECT entity_id, platform, count(*) AS n, count(DISTINCT author) AS n_authors, sum(score) AS score
    FROM linked GROUP BY 1, 2""")
def mention_entity_post_join(t):
    return linked(t).groupBy("entity_id", "platform").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("author").alias("n_authors"), F.sum("score").alias("score"))


@query("daily_volume", LINKED + "SELECT entity_id, day_no, sum(score) AS volume FROM linked GROUP BY 1, 2")
def daily_volume(t):
    return D.daily_volume(linked(t))


@query("day_index", VMI + "SELECT entity_id, day_no, day_index FROM vmi")
def day_index(t):
    return vmi(t).select("entity_id", "day_no", "day_index")


@query("cumulative_volume", VMI + "SELECT entity_id, day_index, cumulative FROM vmi")
def cumulative_volume(t):
    return vmi(t).select("entity_id", "day_index", "cumulative")


@query("cohort_zscore", VMI + "SELECT entity_id, day_index, round(cohort_zscore,6)+0.0 AS cohort_zscore FROM vmi")
def cohort_zscore(t):
    return vmi(t).select("entity_id", "day_index", "cohort_zscore")


@query("vmi_daily", VMI + """
    SELECT entity_id, day_index, day_no, volume, round(cohort_zscore,6)+0.0 AS cohort_zscore, cumulative FROM vmi""")
def vmi_daily(t):
    return vmi(t)


@query("vmi_peak_day", VMI + """
    SELECT entity_id, day_index AS peak_day_index, volume AS peak_volume FROM vmi
    QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY volume DESC, day_index) = 1""")
def vmi_peak_day(t):
    return D.peak_and_total(vmi(t)).select("entity_id", "peak_day_index", "peak_volume")


@query("vmi_to_date", VMI + """
    SELECT entity_id, max_by(cumulative, day_index) AS vmi_to_date FROM vmi GROUP BY 1""")
def vmi_to_date(t):
    return D.peak_and_total(vmi(t)).select("entity_id", "vmi_to_date")


@query("mention_daily", LINKED.split("linked AS")[0].rstrip().rstrip(",") + "," + DAILY + "SELECT * FROM daily")
def mention_daily(t):
    return daily(t)


@query("intent_mix", LINKED + """
    SELECT entity_id, day_no, string_agg(content_intent || '=' || n, ',' ORDER BY content_intent) AS mix
    FROM (SELECT entity_id, day_no, content_intent, count(*) AS n FROM linked GROUP BY 1, 2, 3) q GROUP BY 1, 2""")
def intent_mix(t):
    return D.intent_mix(cube(t)).select("entity_id", "day_no", mix_text().alias("mix"))


def mix_text():
    return F.array_join(F.transform(F.map_entries("intent_mix"), lambda e: F.concat(
        e["key"], F.lit("="), e["value"].cast("string"))), ",")


@query("trailing_sentiment", VMI + "," + DAILY + "," + TRAIL + """
    SELECT entity_id, day_no, round(trailing_ratio,6) AS trailing_ratio FROM ratio""")
def trailing_sentiment(t):
    return D.trailing_on_days(vmi(t), daily(t))


@query("sentiment_delta", VMI + "," + DAILY + "," + TRAIL + """
    SELECT entity_id, day_no, round(net_sentiment_delta,6)+0.0 AS net_sentiment_delta FROM ratio""")
def sentiment_delta(t):
    return D.trailing_sentiment(daily(t)).select("entity_id", "day_no", "net_sentiment_delta")


SPILL = """
    pv AS (SELECT entity_id, day_no, platform, sum(score) AS v FROM linked GROUP BY 1, 2, 3),
    sp AS (SELECT a.entity_id, a.day_no, a.platform, a.v / (sum(b.v)/7) AS r,
                  CASE a.platform WHEN 'x' THEN 0 WHEN 'youtube' THEN 1 WHEN 'reddit' THEN 2 ELSE 3 END AS i
           FROM pv a JOIN pv b ON b.entity_id=a.entity_id AND b.platform=a.platform
                AND b.day_no BETWEEN a.day_no-7 AND a.day_no-1 GROUP BY a.entity_id, a.day_no, a.platform, a.v
           HAVING sum(b.v) > 0),
    best AS (SELECT entity_id, day_no, platform AS spillover_event FROM sp WHERE r > 1.5
             QUALIFY row_number() OVER (PARTITION BY entity_id, day_no ORDER BY r DESC, i) = 1)"""


@query("spillover_event", VMI + "," + SPILL + """
    SELECT v.entity_id, v.day_no, spillover_event FROM vol v LEFT JOIN best USING (entity_id, day_no)""")
def spillover_event(t):
    return D.spillover(cube(t))


RATING = f"""
    raw AS (SELECT author, sum({SCORE}) AS s FROM posts_lean GROUP BY author),
    rating AS (SELECT author, 100.0*(rank() OVER (ORDER BY s) - 1 + count(*) OVER (PARTITION BY s)/2.0)
                      / count(*) OVER () AS r FROM raw)"""
SHARE = RATING + """,
    share AS (SELECT entity_id, day_no, CASE WHEN sum(score)>0 THEN
                     coalesce(sum(score) FILTER (r >= (SELECT quantile_cont(r, 0.9) FROM rating)),0)/sum(score) ELSE 0 END
                     AS spreader_tier_share FROM linked JOIN rating USING (author) GROUP BY 1, 2)"""


@query("spreader_share", LINKED + "," + SHARE + """
    SELECT entity_id, day_no, round(spreader_tier_share,6) AS spreader_tier_share FROM share""")
def spreader_share(t):
    return D.spreader_share(cube(t), E.rating(t.posts_lean))


DEGREES = """
    deg AS (SELECT regexp_extract(text, '^RT @(\\w+):', 1) AS handle, count(*) AS d FROM shared_posts
            WHERE regexp_matches(text, '^RT @\\w+:') GROUP BY 1),
    degrees AS (SELECT l.global_user_id, sum(d) AS in_degree FROM deg
                JOIN identity_link l ON l.normalized_author = regexp_replace(lower(handle), '[^a-z0-9]', '', 'g')
                GROUP BY 1)"""
CASC = DEGREES + """,
    casc AS (SELECT entity_id, day_no, avg(coalesce(in_degree, 0)) AS cascade_depth FROM (
               SELECT DISTINCT entity_id, day_no, author FROM linked) q
             JOIN identity_link l ON l.normalized_author = regexp_replace(lower(author), '[^a-z0-9]', '', 'g')
             LEFT JOIN degrees USING (global_user_id) GROUP BY 1, 2)"""


def degrees(t):
    from flickpulse.operators import graph as G
    return G.retweet_in_degree(t.shared_posts, t.identity_link)


@query("cascade_depth", LINKED + "," + CASC + """
    SELECT entity_id, day_no, round(cascade_depth,6) AS cascade_depth FROM casc""")
def cascade_depth(t):
    return D.cascade_depth(cube(t), t.identity_link, degrees(t))


@query("behavior_daily", VMI + "," + DAILY + "," + TRAIL + "," + SPILL + "," + SHARE + "," + CASC + """,
    mix AS (SELECT entity_id, day_no, string_agg(content_intent || '=' || n, ',' ORDER BY content_intent) AS intent_mix
            FROM (SELECT entity_id, day_no, content_intent, count(*) AS n FROM linked WHERE content_intent IS NOT NULL GROUP BY 1, 2, 3) q
            GROUP BY 1, 2)
    SELECT v.entity_id, v.day_no, v.day_index, coalesce(mentions, 0) AS comment_velocity,
           round(net_sentiment_delta,6)+0.0 AS net_sentiment_delta, round(coalesce(spreader_tier_share,0),6) AS spreader_tier_share,
           round(coalesce(cascade_depth,0),6) AS cascade_depth, spillover_event, intent_mix
    FROM vmi v LEFT JOIN daily USING (entity_id, day_no) LEFT JOIN ratio USING (entity_id, day_no)
         LEFT JOIN share USING (entity_id, day_no) LEFT JOIN casc USING (entity_id, day_no)
         LEFT JOIN best USING (entity_id, day_no) LEFT JOIN mix USING (entity_id, day_no)""")
def behavior_daily(t):
    from flickpulse.operators import scale
    c = scale.stage(cube(t))
    v = D.vmi_daily(D.daily_volume(c), t.entities)
    days = D.behavior_daily(v, c, daily(t), E.rating(t.posts_lean), t.identity_link, degrees(t))
    return days.withColumn("intent_mix", mix_text())


@query("own_threshold", VMI + "," + DAILY + "," + TRAIL + """
    SELECT entity_id, round(quantile_cont(trailing_ratio, 0.75),6) AS threshold FROM ratio GROUP BY 1""")
def own_threshold(t):
    return D.own_threshold(D.trailing_on_days(vmi(t), daily(t))).select("entity_id", "threshold").distinct()


@query("trend_fit", VMI + "," + FIT + """
    SELECT entity_id, day_index, n_points, round(slope,3)+0.0 AS slope, round(intercept,3)+0.0 AS intercept,
           round(ln(1 + greatest(variance, 0)),3)+0.0 AS ln_variance FROM fit""", digits=3)
def trend_fit(t):
    return D.trend_fit(vmi(t)).select("entity_id", "day_index", "n_points", "slope", "intercept",
                                   F.log1p(F.greatest("variance", F.lit(0.0))).alias("ln_variance"))


@query("value_at_plus_3", VMI + "," + FIT + "SELECT entity_id, day_index, actual_plus_3 FROM fit")
def value_at_plus_3(t):
    return D.trend_fit(vmi(t)).select("entity_id", "day_index", "actual_plus_3")


@query("lift_events", VMI + "," + DAILY + "," + TRAIL + "," + FIT + "," + EVENTS + """
    SELECT entity_id, day_no, round(lift,6)+0.0 AS lift FROM events_""")
def lift_events(t):
    return D.lift_events(vmi(t), daily(t)).select("entity_id", "day_no", "lift")


@query("causal_lift", VMI + "," + DAILY + "," + TRAIL + "," + FIT + "," + EVENTS + """,
    who AS (SELECT DISTINCT l.entity_id, m.day_no, i.global_user_id FROM links l
            JOIN mentions m ON m.mention_id = l.mention_id
            JOIN identity_link i ON i.normalized_author = regexp_replace(lower(m.author), '[^a-z0-9]', '', 'g'))
    SELECT global_user_id, count(*) AS n_events, round(CASE WHEN count(*) = 1 THEN max(lift) ELSE
           sum(lift/greatest(variance,1e-6))/sum(1/greatest(variance,1e-6)) END, 5)+0.0 AS causal_lift_score,
           CASE WHEN count(*) >= 3 THEN 'HIGH' ELSE 'LOW' END AS confidence
    FROM who JOIN events_ USING (entity_id, day_no) GROUP BY 1""", digits=5)
def causal_lift(t):
    from flickpulse.operators import scale
    v = scale.stage(vmi(t))
    authors = D.movie_links(t.mention_entities, t.entities).join(t.mentions, "mention_id")
    return D.causal_lift(D.lift_events(v, daily(t)), authors, t.identity_link)
