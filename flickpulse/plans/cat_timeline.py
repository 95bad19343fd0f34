"""Queries over posting timelines, spreaders and audiences."""

from __future__ import annotations

from pyspark.sql import functions as F

from flickpulse.functions import columns as C
from flickpulse.operators import audience as A
from flickpulse.operators import engagement as E
from flickpulse.operators import reach as R
from flickpulse.operators import scale
from flickpulse.operators import timeline as TL
from flickpulse.plans.cat_posts import REACH, SCORE
from flickpulse.plans.registry import query
from flickpulse.sources import posts as P


def excite_sql(source: str, beta: float, unit: str, us: str = "us", key: str = "author") -> str:
    """Brute-force excitation: every post against all earlier posts of the same key."""
    return f"""
    pv AS (SELECT *, {us} AS eus FROM {source}),
    ex AS (SELECT a.{key}, a.post_id, a.eus, coalesce(sum(exp(-{beta}*(a.eus-b.eus)/{unit})), 0) AS excite
           FROM pv a LEFT JOIN pv b ON b.{key} = a.{key}
                AND (b.eus < a.eus OR (b.eus = a.eus AND b.post_id < a.post_id)) GROUP BY 1, 2, 3)"""


def fit_sql(beta: float, unit: str, key: str = "author") -> str:
    """Bisection on alpha along mu = (n - alpha*mass)/span, one step per recursion, all keys at once."""
    return f"""
    st AS (SELECT {key}, count(*) AS n, (max(eus) - min(eus))/{unit} AS span,
                  (count(*) - arg_max(excite, (eus, post_id)) - 1)/{beta} AS mass, list(excite) AS xs
           FROM ex GROUP BY 1),
    bis AS (SELECT {key}, n, span, mass, xs, 0 AS step, 0.0::double AS lo,
                   least({beta} - 1e-9, (n - 1e-9*span)/mass) AS hi FROM st WHERE n >= 2 AND span > 1e-9
            UNION ALL
            SELECT {key}, n, span, mass, xs, step + 1,
                   CASE WHEN list_sum(list_transform(xs, lambda a: (a - mass/span)
                        / ((n - (lo+hi)/2*mass)/span + (lo+hi)/2*a))) > 0 THEN (lo+hi)/2 ELSE lo END,
                   CASE WHEN list_sum(list_transform(xs, lambda a: (a - mass/span)
                        / ((n - (lo+hi)/2*mass)/span + (lo+hi)/2*a))) > 0 THEN hi ELSE (lo+hi)/2 END
            FROM bis WHERE step < 60),
    fit AS (SELECT {key}, n, span, (n - lo*mass)/span AS mu, lo AS alpha, lo/{beta} AS branching_ratio
            FROM bis WHERE step = 60)"""


HOURLY_SQL = excite_sql("posts_bursty", 3.0, "3600000000.0", "us - us % 1000000") + "," + fit_sql(3.0, "3600000000.0")
MINUTE_SQL = (excite_sql("(SELECT * FROM posts_bursty WHERE sentiment_score BETWEEN 1 AND 100)", 0.1, "60000000.0")
              + "," + fit_sql(0.1, "60000000.0"))


def valid_bursty(t):
    return P.valid_sentiment(t.posts_bursty)


@query("hawkes_fit", HOURLY_SQL + """
    SELECT author, n, round(span,5) AS span, round(mu,5) AS mu, round(alpha,5) AS alpha,
           round(branching_ratio,5) AS branching_ratio FROM fit""", recursive=True, digits=5)
def hawkes_fit(t):
    return TL.hawkes_fit(t.posts_bursty, ["author"], TL.HOURLY)


@query("branching_ratio", MINUTE_SQL + """
    SELECT author, n, round(alpha,5) AS alpha, round(branching_ratio,5) AS branching_ratio FROM fit""",
       recursive=True, digits=5)
def branching_ratio(t):
    return TL.hawkes_fit(valid_bursty(t), ["author"], TL.PER_MINUTE, bounded_mu=False).select(
        "author", "n", "alpha", "branching_ratio")


@query("super_spreader", HOURLY_SQL + """
    SELECT author, round(alpha,5) AS alpha, alpha > 1.5 AS super_spreader FROM fit""", recursive=True, digits=5)
def super_spreader(t):
    fits = TL.hawkes_fit(t.posts_bursty, ["author"], TL.HOURLY)
    return TL.super_spreader(fits, 1.5).select("author", "alpha", "super_spreader")


@query("excitation_spikes", excite_sql("posts_bursty", 0.1, "60000000.0") + """
    SELECT author, post_id, round(excite,6) AS excite FROM ex""")
def excitation_spikes(t):
    return TL.excitation(t.posts_bursty, ["author"], TL.PER_MINUTE).select("author", "post_id", "excite")


LEVELS = """
    lv AS (SELECT ex.author, ex.post_id, ex.eus, alpha*excite AS spike, mu + alpha*excite AS intensity, alpha, excite
           FROM ex JOIN fit USING (author))"""


@query("temporal_audit", MINUTE_SQL + "," + LEVELS + """
    SELECT author, post_id, eus - min(eus) OVER (PARTITION BY author) AS since_start_us,
           round(spike,4) AS spike, round(intensity,4) AS intensity,
           eus - lag(eus) OVER (PARTITION BY author ORDER BY eus, post_id) AS gap_us
    FROM lv""", recursive=True)
def temporal_audit(t):
    v = valid_bursty(t)
    fits = TL.hawkes_fit(v, ["author"], TL.PER_MINUTE, bounded_mu=False)
    s = TL.spikes(TL.interarrival(v, ["author"]), ["author"], fits, TL.PER_MINUTE)
    first = v.groupBy("author").agg(F.min("us").alias("first_us"))
    return s.join(first, "author").select(
        "author", "post_id", (F.col("us") - F.col("first_us")).alias("since_start_us"),
        F.round("spike", 4).alias("spike"), F.round("intensity", 4).alias("intensity"),
        (F.col("us") - F.col("previous_us")).alias("gap_us"))


@query("excitation_level", MINUTE_SQL + "," + LEVELS + """
    SELECT author, CASE WHEN alpha <= 1e-12 THEN 'NONE' WHEN excite >= 0.7 THEN 'HIGH' WHEN excite >= 0.3 THEN 'MEDIUM'
           WHEN excite > 0 THEN 'LOW' ELSE 'NONE' END AS level, count(*) AS n FROM lv GROUP BY 1, 2""", recursive=True)
def excitation_level(t):
    v = valid_bursty(t)
    fits = TL.hawkes_fit(v, ["author"], TL.PER_MINUTE, bounded_mu=False)
    return TL.spikes(v, ["author"], fits, TL.PER_MINUTE).groupBy("author", "level").agg(F.count(F.lit(1)).alias("n"))


@query("interarrival", """
    SELECT author, post_id, us - lag(us) OVER (PARTITION BY author ORDER BY us, post_id) AS gap_us
    FROM posts_lean""")
def interarrival(t):
    return TL.interarrival(t.posts_lean, ["author"]).select("author", "post_id",
                                                            (F.col("us") - F.col("previous_us")).alias("gap_us"))


VALID = "(SELECT * FROM posts_bursty WHERE sentiment_score BETWEEN 1 AND 100)"
BURST = """
    num AS (SELECT *, row_number() OVER (PARTITION BY author ORDER BY us, post_id) AS i FROM posts_bursty),
    cnt AS (SELECT a.author, a.i, a.us, count(*) AS c FROM num a JOIN num b
            ON b.author = a.author AND b.i >= a.i AND b.us - a.us <= 600000000
            WHERE a.keyword <> '' GROUP BY 1, 2, 3 HAVING count(*) >= 3),
    bur AS (SELECT n.author, n.post_id, n.us, n.keyword, n.sentiment_score, n.i, coalesce(max(c.c), 0) AS burst
            FROM num n LEFT JOIN cnt c ON c.author = n.author AND c.i <= n.i AND n.us - c.us <= 600000000
            GROUP BY 1, 2, 3, 4, 5, 6)"""


@query("burst_detect", BURST + "SELECT author, post_id, burst FROM bur")
def burst_detect(t):
    return TL.bursts(t.posts_bursty, ["author"]).select("author", "post_id", "burst")


@query("burst_regions", BURST + """,
    lagged AS (SELECT *, CASE WHEN burst > 0 AND coalesce(lag(burst) OVER (PARTITION BY author ORDER BY i), 0) = 0
                    THEN 1 ELSE 0 END AS starts FROM bur),
    grp AS (SELECT *, sum(starts) OVER (PARTITION BY author ORDER BY i) AS g FROM lagged)
    SELECT author, min(us) AS start_us, max(us) AS end_us, count(*) AS n_posts, max(burst) AS peak,
           arg_min(keyword, i) AS keyword, round((max(us)-min(us))/60000000.0,6) AS minutes
    FROM grp WHERE burst > 0 GROUP BY author, g""")
def burst_regions(t):
    return TL.burst_regions(TL.bursts(t.posts_bursty, ["author"]), ["author"])


REGIONS = """
    lagged AS (SELECT *, CASE WHEN burst > 0 AND coalesce(lag(burst) OVER (PARTITION BY author ORDER BY i), 0) = 0
                    THEN 1 ELSE 0 END AS starts FROM bur),
    grp AS (SELECT *, sum(starts) OVER (PARTITION BY author ORDER BY i) AS g FROM lagged),
    reg AS (SELECT author, g, count(*) AS n FROM grp WHERE burst > 0 GROUP BY 1, 2),
    rg AS (SELECT author, count(*) AS n_regions, max(n) AS largest FROM reg GROUP BY 1),
    tn AS (SELECT author, tone, count(*) AS n FROM (SELECT author, CASE WHEN sentiment_score < 50 THEN 'negative'
             WHEN sentiment_score > 75 THEN 'positive' ELSE 'neutral' END AS tone FROM pv) q GROUP BY 1, 2
           QUALIFY row_number() OVER (PARTITION BY author ORDER BY count(*) DESC, tone) = 1),
    pp AS (SELECT author, platform, count(*) AS n FROM pv GROUP BY 1, 2
           QUALIFY row_number() OVER (PARTITION BY author ORDER BY count(*) DESC, platform) = 1)"""
AUDIT = MINUTE_SQL + "," + BURST.replace("FROM posts_bursty", "FROM " + VALID) + "," + REGIONS


@query("author_categories", AUDIT + """
    SELECT f.author, CASE WHEN tone = 'negative' AND branching_ratio >= 0.7 THEN 'Critical Power Influencer'
             WHEN tone = 'negative' THEN 'Active Critic' WHEN tone = 'positive' AND branching_ratio >= 0.7 THEN 'Movie Buff'
             WHEN tone = 'positive' THEN 'Positive Engager' ELSE 'Neutral Informer' END AS audience_classification,
           CASE WHEN branching_ratio >= 0.8 THEN 'Viral Node' WHEN branching_ratio >= 0.6 THEN 'Amplifier'
                WHEN branching_ratio >= 0.3 THEN 'Participant' ELSE 'Observer' END AS influence_tier,
           CASE WHEN n_regions IS NULL THEN 'Steady Poster' WHEN largest >= 10 THEN 'Power Burst Poster'
                WHEN n_regions >= 2 THEN 'Burst Poster' ELSE 'Reactive Poster' END AS posting_style,
           tone AS dominant_tone, platform AS primary_platform, floor(branching_ratio*10000+0.5)/10000 AS branching_ratio,
           f.n AS total_posts
    FROM fit f JOIN tn USING (author) JOIN pp USING (author) LEFT JOIN rg USING (author) WHERE f.n > 5""", recursive=True)
def author_categories(t):
    return A.author_categories(t.posts_bursty)


@query("author_filter", """
    SELECT author, audience_classification, posting_style, total_posts FROM author_stats
    WHERE total_posts > 5 AND posting_style = 'Steady Poster'""")
def author_filter(t):
    return A.filter_authors(t.author_stats, posting_style="Steady Poster", audience_classification=None).select(
        "author", "audience_classification", "posting_style", "total_posts")


@query("distinct_category_values", """
    SELECT DISTINCT 'audience_classification' AS column_name, audience_classification AS value FROM author_stats
    UNION ALL SELECT DISTINCT 'posting_style', posting_style FROM author_stats""")
def distinct_category_values(t):
    return A.distinct_values(t.author_stats, ["audience_classification", "posting_style"])


@query("stale_purge", "SELECT author, total_posts FROM author_stats WHERE total_posts > 65")
def stale_purge(t):
    return A.filter_authors(t.author_stats, min_posts=65).select("author", "total_posts")


@query("uncategorized_anti", f"""
    u AS (SELECT author, count(*) AS post_count, sum({REACH}) AS total_engagement,
                 avg(sentiment_score) FILTER (sentiment_score BETWEEN 1 AND 100) AS s FROM posts_lean GROUP BY author)
    SELECT author AS global_user_id, post_count, total_engagement FROM u
    WHERE s > 48 AND author NOT IN (SELECT author FROM author_stats)""")
def uncategorized_anti(t):
    return A.uncategorized(t.posts_lean, t.author_stats, tone_floor=48.0).drop("avg_sentiment")


@query("movie_buffs", f"""
    u AS (SELECT author, count(*) AS post_count, sum({REACH}) AS total_engagement,
                 avg(sentiment_score) FILTER (sentiment_score BETWEEN 1 AND 100) AS s
          FROM posts_lean WHERE lower(keyword) IN (SELECT lower(b.keyword) FROM entity_keywords a
               JOIN entity_keywords b ON b.entity_id = a.entity_id WHERE lower(a.keyword) = 'kw3') GROUP BY author)
    SELECT u.author AS global_user_id, post_count, total_engagement, a.branching_ratio,
           a.author IS NOT NULL AS categorized,
           coalesce(posting_style = 'Power Burst Poster' AND branching_ratio >= 0.99
                    AND total_engagement/post_count < 20, false) AS suspected_bot
    FROM u LEFT JOIN author_stats a ON a.author = u.author
    WHERE a.audience_classification = 'Movie Buff' OR (a.author IS NULL AND s > 55)""")
def movie_buffs(t):
    wanted = t.entity_keywords.filter("lower(keyword) = 'kw3'").select("keyword").distinct()
    variants = R.keyword_variants(t.entity_keywords, wanted)
    hits = A.posts_of_keywords(t.posts_lean, variants)
    return A.movie_buffs(hits, t.author_stats, tone_floor=55.0).select(
        "global_user_id", "post_count", "total_engagement", "branching_ratio", "categorized", "suspected_bot")


@query("audience_size", """
    SELECT lower(keyword) AS keyword, count(DISTINCT author) AS audience_size FROM posts_lean
    WHERE sentiment_score BETWEEN 1 AND 100 GROUP BY 1""")
def audience_size(t):
    return P.valid_sentiment(t.posts_lean).groupBy(F.lower("keyword").alias("keyword")).agg(
        F.countDistinct("author").alias("audience_size"))


AFF = f"""
    u AS (SELECT author AS global_user_id, count(*) AS post_count, sum({REACH}) AS total_engagement
          FROM posts_lean WHERE lower(keyword) = 'kw5' GROUP BY 1),
    f AS (SELECT u.*, p.influence_rank, p.moi_score, p.tribe_label,
                 (post_count + log10(1.0+total_engagement))/(post_count + log10(1.0+total_engagement)+5) AS a
          FROM u JOIN profiles p USING (global_user_id))"""


@query("audience_affinity", AFF + """
    SELECT global_user_id, post_count, total_engagement, round(influence_rank,6) AS influence_rank, round(a,6) AS affinity_score,
           round(1/(1+exp(-a*influence_rank)),6) AS p_conv FROM f""")
def audience_affinity(t):
    return A.affinity(P.for_keyword(t.posts_lean, "kw5"), t.profiles).select(
        "global_user_id", "post_count", "total_engagement", "influence_rank", "affinity_score", "p_conv")


@query("keyword_spreaders", AFF + """
    SELECT global_user_id, post_count, total_engagement, round(influence_rank,6) AS influence_rank FROM f
    ORDER BY influence_rank DESC, global_user_id LIMIT 20""")
def keyword_spreaders(t):
    return A.keyword_spreaders(P.for_keyword(t.posts_lean, "kw5"), t.profiles, 20).select(
        "global_user_id", "post_count", "total_engagement", "influence_rank")


@query("entity_spreaders", """
    u AS (SELECT author AS global_user_id, count(*) AS post_count, sum(likes) AS total_likes,
                 sum(comments) AS total_comments, sum(views) AS total_views, sum(likes+comments) AS total_engagement
          FROM posts_lean WHERE lower(keyword) IN (SELECT lower(keyword) FROM entity_keywords WHERE entity_id = 4)
               AND sentiment_score BETWEEN 1 AND 100 GROUP BY 1)
    SELECT u.*, floor(total_engagement/post_count + 0.5) AS engagement_per_post,
           round(influence_rank,6) AS influence_rank FROM u JOIN profiles p USING (global_user_id)
    ORDER BY total_engagement DESC, influence_rank DESC, global_user_id LIMIT 25""")
def entity_spreaders(t):
    kws = t.entity_keywords.filter("entity_id = 4").select(F.col("keyword").alias("variant"))
    return A.entity_spreaders(A.posts_of_keywords(t.posts_lean, kws), t.profiles, 25).select(
        "global_user_id", "post_count", "total_likes", "total_comments", "total_views", "total_engagement",
        "engagement_per_post", "influence_rank")


@query("keyword_author_semi", """
    SELECT global_user_id, total_posts FROM profiles
    WHERE global_user_id IN (SELECT author FROM posts_lean WHERE contains(lower(keyword), 'kw2'))""")
def keyword_author_semi(t):
    return t.profiles.join(A.keyword_authors(t.posts_lean, "KW2"), "global_user_id", "left_semi").select(
        "global_user_id", "total_posts")


TOP = excite_sql("(SELECT * FROM posts_bursty WHERE (platform <> 'x' OR views > 0) AND sentiment_score BETWEEN 1 AND 100"
                 " AND contains(lower(keyword), 'kw1') AND us >= (SELECT max(us) FROM posts_bursty) - 90*86400000000)",
                 3.0, "3600000000.0", "us - us % 1000000") + "," + fit_sql(3.0, "3600000000.0")


@query("top_spreaders", TOP + """,
    a AS (SELECT author, count(*) AS n_posts, sum(likes) AS total_likes, sum(comments) AS total_comments,
                 sum(views) AS total_views, avg(sentiment_score) AS m FROM pv GROUP BY author HAVING count(*) >= 2),
    s AS (SELECT a.*, coalesce(alpha, 0) AS alpha, total_likes + 3.0*total_comments AS e,
                 CASE WHEN total_views > 0 THEN 1 + log10(1.0+total_views)/10 ELSE 1 END AS rm
          FROM a LEFT JOIN fit USING (author))
    SELECT author, total_likes, total_comments, total_views, round(m,6) AS mean_sentiment,
           round(e*(1+alpha)*rm,3) AS viral_potential_score, round(rm,6) AS reach_multiplier
    FROM s WHERE e*(1+alpha)*rm > 0 ORDER BY e*(1+alpha)*rm DESC, total_views DESC, author LIMIT 50""",
       recursive=True)
def top_spreaders(t):
    as_of = t.posts_bursty.agg(F.max("us").alias("m")).scalar()
    hits = P.recent(t.posts_bursty.filter(C.contains_text("keyword", F.lit("kw1"))), as_of)
    fits = TL.hawkes_fit(hits, ["author"], TL.HOURLY)
    return A.top_spreaders(hits, fits).select(
        "author", "total_likes", "total_comments", "total_views", "mean_sentiment",
        F.round("viral_potential_score", 3).alias("viral_potential_score"), "reach_multiplier")


REACH4 = """
    rc AS (SELECT author AS global_user_id, coalesce(sum(views) FILTER (platform='x'),0) AS x_views,
                  coalesce(sum(likes) FILTER (platform='instagram'),0) AS instagram_likes,
                  coalesce(sum(likes) FILTER (platform='reddit'),0) AS reddit_score,
                  count(*) FILTER (platform='youtube') AS youtube_comments FROM posts_lean GROUP BY 1),
    rt AS (SELECT *, x_views + instagram_likes + reddit_score + youtube_comments AS total_reach FROM rc),
    wt AS (SELECT (SELECT quantile_cont(influence_rank, 0.9) FROM profiles WHERE influence_rank > 0
                   AND influence_rank < 0.99) AS alpha_p90,
                  (SELECT quantile_cont(moi_score, 0.9) FROM profiles WHERE moi_score > 0) AS moi_p90,
                  (SELECT quantile_cont(ln(1+total_reach), 0.9) FROM rt WHERE total_reach > 0) AS log_reach_p90),
    w AS (SELECT *, least(greatest(alpha_p90/moi_p90, 0.1), 100.0) AS w_moi,
                 least(greatest(alpha_p90/log_reach_p90, 1e-4), 1.0) AS w_reach FROM wt)"""


@query("seed_weights", REACH4 + """
    SELECT round(alpha_p90,6) AS alpha_p90, round(moi_p90,6) AS moi_p90, round(log_reach_p90,6) AS log_reach_p90,
           round(w_moi,6) AS w_moi, round(w_reach,6) AS w_reach FROM w""")
def seed_weights(t):
    return A.seed_weights(t.profiles, A.seed_reach(t.posts_lean))


@query("viral_seeds", REACH4 + """,
    cand AS (SELECT * FROM profiles WHERE global_user_id IN (
               SELECT author FROM posts_lean WHERE contains(lower(keyword), 'kw2'))
             ORDER BY influence_rank DESC, global_user_id LIMIT 200),
    sc AS (SELECT c.global_user_id, x_views, total_reach, influence_rank + w_moi*moi_score + w_reach*ln(1+total_reach) AS s,
                  w_moi*moi_score AS mt, w_reach*ln(1+total_reach) AS r_t,
                  CASE WHEN x_views >= greatest(instagram_likes, reddit_score, youtube_comments) THEN 'x'
                       WHEN instagram_likes >= greatest(reddit_score, youtube_comments) THEN 'instagram'
                       WHEN reddit_score >= youtube_comments THEN 'reddit' ELSE 'youtube' END AS primary_platform
           FROM cand c JOIN rt USING (global_user_id), w WHERE total_reach > 0)
    SELECT global_user_id, total_reach, primary_platform, round(s,6) AS seed_score, round(mt,6) AS moi_term,
           round(r_t,6) AS reach_term, row_number() OVER (ORDER BY s DESC, global_user_id) AS place
    FROM sc ORDER BY s DESC, global_user_id LIMIT 50""")
def viral_seeds(t):
    reach = A.seed_reach(t.posts_lean)
    return A.viral_seeds(t.profiles, t.posts_lean, "kw2", A.seed_weights(t.profiles, reach), reach).select(
        "global_user_id", "total_reach", "primary_platform", "seed_score", "moi_term", "reach_term", "place")


@query("targets_filter", """
    SELECT global_user_id, tribe_label, round(influence_rank,6) AS influence_rank FROM profiles
    WHERE influence_rank >= 0.6 AND contains(lower(tribe_label), 'tribe 1')
      AND global_user_id IN (SELECT author FROM posts_lean WHERE platform = 'reddit')""")
def targets_filter(t):
    prof = t.profiles.join(E.handle_maps(t.posts_lean).withColumnRenamed("author", "global_user_id"), "global_user_id")
    return prof.filter((F.col("influence_rank") >= 0.6) & C.contains_text("tribe_label", F.lit("Tribe 1"))
                       & F.map_contains_key("by_platform", F.lit("reddit"))).select(
        "global_user_id", "tribe_label", "influence_rank")


@query("profile_left_join", """
    SELECT a.author, p.tribe_label, round(p.influence_rank,6) AS influence_rank
    FROM (SELECT author FROM posts_lean GROUP BY author) a
    LEFT JOIN profiles p ON p.global_user_id = a.author AND p.influence_rank >= 0.7""")
def profile_left_join(t):
    prof = t.profiles.filter("influence_rank >= 0.7").withColumnRenamed("global_user_id", "author")
    return t.posts_lean.select("author").distinct().join(prof, "author", "left").select(
        "author", "tribe_label", "influence_rank")


@query("sentiment_distribution", """
    n AS (SELECT author, platform, sentiment_category, count(*) AS n FROM posts_lean WHERE sentiment_score <> 0
          GROUP BY 1, 2, 3)
    SELECT *, round(n / sum(n) OVER (PARTITION BY author, platform), 6) AS share FROM n""")
def sentiment_distribution(t):
    return A.sentiment_distribution(t.posts_lean, ["author", "platform"])


STATS = BURST + """,
    ss AS (SELECT keyword, count(*) AS n, count(*) FILTER (sentiment_score > 75) AS positive,
              count(*) FILTER (sentiment_score < 50) AS negative,
              count(*) FILTER (sentiment_score BETWEEN 50 AND 75) AS neutral, stddev_pop(sentiment_score/100) AS spread,
              count(*) FILTER (burst > 0) AS in_burst,
              count(*) FILTER (burst > 0 AND sentiment_score < 50) AS in_burst_negative,
              count(DISTINCT author) AS followers,
              count(DISTINCT author) FILTER (sentiment_score > 75) AS fans, min(us) AS u0, max(us) AS u1
           FROM bur WHERE sentiment_score BETWEEN 1 AND 100 GROUP BY 1)"""


@query("sentiment_stats", STATS + """
    SELECT keyword, n, positive, negative, neutral, round(spread,6) AS spread, in_burst, in_burst_negative,
           round((positive-negative)/n,6)+0.0 AS net,
           round(CASE WHEN in_burst>0 THEN in_burst_negative/in_burst ELSE 0 END,6) AS burst_negative_share FROM ss""")
def sentiment_stats(t):
    marked = P.valid_sentiment(TL.bursts(t.posts_bursty, ["author"]))
    return A.sentiment_stats(marked, "keyword")


@query("celebrity_metrics", STATS + f""",
    agg AS (SELECT keyword, sum({REACH}) AS reach, sum(likes+comments) AS engagement FROM posts_bursty
            WHERE sentiment_score BETWEEN 1 AND 100 GROUP BY 1),
    r AS (SELECT keyword, reach, engagement, n AS posts, followers, spread, (positive-negative)/n AS net,
                 negative/n AS neg, fans/followers AS adv, 0.5 AS br,
                 CASE WHEN in_burst>0 THEN in_burst_negative/in_burst ELSE 0 END AS bur_, 
                 greatest((u1-u0)/86400000000.0, 1) AS days FROM ss JOIN agg USING (keyword)),
    q AS (SELECT *, log10(1+reach)/(log10(1+reach)+4) AS s1, log10(1.0+followers)/(log10(1.0+followers)+2) AS s2, br AS s3,
                 log10(1+engagement/posts)/(log10(1+engagement/posts)+2) AS s4,
                 log10(1+engagement/followers)/(log10(1+engagement/followers)+2) AS s5,
                 greatest(posts/followers-1,0)/(greatest(posts/followers-1,0)+1) AS s6, (net+1)/2 AS s7,
                 least(2*spread,1) AS s8 FROM r),
    i AS (SELECT *, 100*(.5*s3+.3*s2+.2*s1) AS influence, 100*(.3*s1+.2*s2+.2*s4+.15*s3+.15*s7) AS brand_power,
                 100*(.35*s6+.3*s7+.2*s5+.15*adv) AS loyalty, 100*(.5*neg+.3*s8+.2*bur_) AS controversy FROM q)
    SELECT keyword, round(influence,6) AS influence, round(brand_power,6) AS brand_power, round(loyalty,6) AS loyalty,
           round(controversy,6) AS controversy,
           round(100*(.35*s1+.25*s7+.2*loyalty/100+.2*influence/100)*(1-.7*controversy/100),6) AS endorsement,
           round(reach/days*365/1000*22*(.5+1.5*brand_power/100)*(1-.5*controversy/100),6) AS brand_value FROM i""")
def celebrity_metrics(t):
    marked = P.valid_sentiment(TL.bursts(t.posts_bursty, ["author"]))
    stats = A.sentiment_stats(marked, "keyword")
    fans = F.countDistinct(F.when(F.col("sentiment_score") > 75, F.col("author")))
    agg = marked.groupBy("keyword").agg(
        F.sum(E.reach()).alias("reach"), F.sum(F.col("likes") + F.col("comments")).alias("engagement"),
        F.countDistinct("author").alias("followers"), fans.alias("fans"),
        F.greatest((F.max("us") - F.min("us")) / 86_400_000_000.0, F.lit(1.0)).alias("days"))
    rows = stats.join(agg, "keyword").select(
        "keyword", "reach", "engagement", "followers", F.col("n").alias("posts"), "net", "spread",
        "burst_negative_share", (F.col("negative") / F.col("n")).alias("negative_share"),
        (F.col("fans") / F.col("followers")).alias("advocates"), F.lit(0.5).alias("branching_ratio"), "days")
    return A.celebrity_metrics(rows).select("keyword", "influence", "brand_power", "loyalty", "controversy",
                                            "endorsement", "brand_value")


GAPS = """
    g AS (SELECT author, (us - lag(us) OVER (PARTITION BY author ORDER BY us, post_id))/60000000.0 AS gap
          FROM posts_lean),
    o AS (SELECT author, gap, row_number() OVER (PARTITION BY author ORDER BY gap) AS i,
                 count(*) OVER (PARTITION BY author) AS n FROM g WHERE gap IS NOT NULL),
    wf AS (SELECT author, max(n) AS n, regr_slope(ln(-ln(1-(i-0.3)/(n+0.4))), ln(gap)) AS shape,
                  regr_intercept(ln(-ln(1-(i-0.3)/(n+0.4))), ln(gap)) AS c FROM o WHERE gap > 0 GROUP BY author)"""


@query("weibull_fit", GAPS + """
    SELECT author, n, round(shape,5) AS shape, round(exp(-c/shape),3) AS scale FROM wf""")
def weibull_fit(t):
    fits = TL.weibull_fit(TL.interarrival(t.posts_lean, ["author"]), ["author"], "gap_minutes")
    return fits.select("author", "n", F.round("shape", 5).alias("shape"), F.round("scale", 3).alias("scale"))


@query("shelf_life", GAPS + """,
    w2 AS (SELECT author, shape AS k, exp(-c/shape) AS lam FROM wf),
    w3 AS (SELECT *, pow((k-1)/k, 1/k) AS m, greatest(0.1, lam/1000)/lam AS st FROM w2 WHERE k > 1),
    grid AS (SELECT author, k, lam, m + j*st AS u, m FROM w3, range(0, 20000) r(j)),
    hit AS (SELECT author, min(u) AS u FROM grid
            WHERE k*pow(u,k-1)*exp(-pow(u,k)) <= 0.1*k*pow(m,k-1)*exp(-pow(m,k)) GROUP BY author)
    SELECT w2.author, round(u*lam,2) AS shelf_life FROM w2 LEFT JOIN hit USING (author)""")
def shelf_life(t):
    fits = TL.weibull_fit(TL.interarrival(t.posts_lean, ["author"]), ["author"], "gap_minutes")
    s = TL.shelf_life(fits)
    return s.select("author", F.round(F.when(F.col("shelf_life") < float("inf"), F.col("shelf_life")), 2)
                    .alias("shelf_life"))
