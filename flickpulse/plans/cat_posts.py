"""Queries over the unified posts: scans, predicates, engagement, reach, audience."""

from __future__ import annotations

from pyspark.sql import functions as F

from flickpulse.functions import columns as C
from flickpulse.operators import engagement as E
from flickpulse.operators import reach as R
from flickpulse.plans.registry import query
from flickpulse.sources import posts as P

SCORE = ("(3e0*coalesce(comments,0) + CASE WHEN platform='x' THEN 2e0*coalesce(shares,0) ELSE 0 END "
         "+ 15e-1*coalesce(likes,0) + CASE WHEN platform='x' THEN 1e0*coalesce(views,0) ELSE 0 END)")
REACH = "(CASE platform WHEN 'x' THEN views WHEN 'reddit' THEN comments ELSE likes END)"


def platform_tables(t):
    """The physical tables of the four platforms, as a reader would get them."""
    p = t.posts
    common = ["keyword", "sentiment_category", "sentiment_score", "permalink", "author", "content_intent", "text",
              "title", "media_type"]
    pick = lambda name, **ren: p.filter(F.col("platform") == name).select(
        F.col("post_id").alias("id"), *common, *[F.col(v).alias(k) for k, v in ren.items()])
    return (pick("x", created_at="ts", likes_count="likes", comment_count="comments", views_count="views",
                 shares_count="shares"),
            pick("youtube", published_at="ts", likes_count="likes", reply_count="comments"),
            pick("reddit", created_at="ts", score="likes", num_comments="comments"),
            pick("instagram", timestamp="ts", like_count="likes", comments_count="comments"))


@query("posts_unified", """
    SELECT CAST(post_id AS STRING) AS post_id, platform, us, likes, comments,
           CASE WHEN platform='x' THEN views END AS views, shares, author, keyword, content_intent,
           md5(CASE WHEN platform='reddit' THEN trim(title || ' ' || text) ELSE text END) AS content_md5
    FROM posts""")
def posts_unified(t):
    u = P.unify(*platform_tables(t))
    return u.select("post_id", "platform", F.unix_micros("ts").alias("us"), "likes", "comments", "views", "shares",
                    "author", "keyword", "content_intent", F.md5("content").alias("content_md5"))


@query("posts_valid", """
    SELECT 'range' AS rule, platform, count(*) AS n, sum(sentiment_score) AS s FROM posts_lean
    WHERE sentiment_score BETWEEN 1 AND 100 GROUP BY platform
    UNION ALL
    SELECT 'nonzero', platform, count(*), sum(sentiment_score) FROM posts_lean
    WHERE sentiment_score <> 0 GROUP BY platform""")
def posts_valid(t):
    def part(rule, df):
        return (df.groupBy("platform").agg(F.count(F.lit(1)).alias("n"), F.sum("sentiment_score").alias("s"))
                .select(F.lit(rule).alias("rule"), "platform", "n", "s"))
    return part("range", P.valid_sentiment(t.posts_lean)).unionByName(
        part("nonzero", P.valid_sentiment(t.posts_lean, ranged=False)))


@query("posts_for_keyword", """
    SELECT post_id, author, platform, us, count(*) OVER () AS total FROM posts_lean WHERE lower(keyword) = 'kw7'
    ORDER BY us DESC NULLS LAST, post_id LIMIT 20 OFFSET 20""")
def posts_for_keyword(t):
    hits = P.for_keyword(t.posts_lean, "KW7")
    return P.page_with_total(hits, 1, 20).select("post_id", "author", "platform", "us", "total")


@query("normalize_author", """
    SELECT normalized, count(*) AS n_raw, sum(n) AS n_posts FROM (
      SELECT author, regexp_replace(lower(author), '[^a-z0-9]', '', 'g') AS normalized, count(*) AS n
      FROM posts_lean GROUP BY author) q WHERE normalized <> '' GROUP BY normalized""")
def normalize_author(t):
    return (t.posts_lean.groupBy("author").agg(F.count(F.lit(1)).alias("n"))
            .withColumn("normalized", C.normalize_author("author")).filter(F.col("normalized").isNotNull())
            .groupBy("normalized").agg(F.count(F.lit(1)).alias("n_raw"), F.sum("n").alias("n_posts")))


@query("tone", """
    SELECT post_id, CASE WHEN sentiment_score < 50 THEN 'negative' WHEN sentiment_score > 75 THEN 'positive'
           ELSE 'neutral' END AS tone FROM posts_lean""")
def tone(t):
    return t.posts_lean.select("post_id", C.tone("sentiment_score").alias("tone"))


@query("keyword_match_exact", """
    SELECT k.entity_id, count(DISTINCT k.keyword) AS n_kw, sum(p.n) AS n_posts
    FROM entity_keywords k JOIN (SELECT keyword, count(*) AS n FROM posts_lean GROUP BY keyword) p
         ON lower(k.keyword) = lower(p.keyword) GROUP BY k.entity_id""")
def keyword_match_exact(t):
    per = t.posts_lean.groupBy("keyword").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("keyword", "pk")
    return (t.entity_keywords.join(per, C.same_text("keyword", "pk")).groupBy("entity_id")
            .agg(F.countDistinct("keyword").alias("n_kw"), F.sum("n").alias("n_posts")))


@query("keyword_match_substr", """
    SELECT platform, count(*) AS n FROM posts_lean WHERE contains(lower(keyword), 'kw1') GROUP BY platform""")
def keyword_match_substr(t):
    return (t.posts_lean.filter(C.contains_text("keyword", F.lit("KW1"))).groupBy("platform")
            .agg(F.count(F.lit(1)).alias("n")))


@query("recent_window_filter", """
    SELECT post_id, platform, us FROM posts_lean
    WHERE us >= (SELECT max(us) FROM posts_lean) - 10*86400000000 AND (platform <> 'x' OR views > 0)
      AND sentiment_score BETWEEN 1 AND 100""")
def recent_window_filter(t):
    as_of = t.posts_lean.agg(F.max("us").alias("m")).scalar()
    return P.recent(t.posts_lean, as_of, days=10).select("post_id", "platform", "us")


@query("engagement_score", f"SELECT post_id, {SCORE} AS score FROM posts_lean")
def engagement_score(t):
    return t.posts_lean.select("post_id", E.score().alias("score"))


MOI_SQL = ("sqrt(avg(CASE WHEN views>0 THEN ((likes+comments)*1.0::double/views)*((likes+comments)*1.0::double/views)"
           " ELSE 0 END))")


@query("moi", f"SELECT author, round({MOI_SQL},6) AS moi, count(*) AS n_posts FROM posts_lean GROUP BY author")
def moi(t):
    return E.moi(t.posts_lean)


@query("moi_by_platform", f"""
    SELECT author, 'all' AS platform, round({MOI_SQL},6) AS moi, count(*) AS n_posts FROM posts_lean GROUP BY author
    UNION ALL
    SELECT author, platform, round({MOI_SQL},6), count(*) FROM posts_lean WHERE platform <> 'youtube'
    GROUP BY author, platform""")
def moi_by_platform(t):
    return E.moi_by_platform(t.posts_lean)


@query("ranked_moi", f"""
    m AS (SELECT author, {MOI_SQL} AS moi, count(*) AS n_posts FROM posts_lean GROUP BY author)
    SELECT author, round(moi,6) AS moi, n_posts, rank() OVER (ORDER BY moi DESC) AS place FROM m""")
def ranked_moi(t):
    return E.ranked_moi(t.posts_lean)


@query("engagement_rating", f"""
    r AS (SELECT author, sum({SCORE}) AS engagement_score_raw FROM posts_lean GROUP BY author)
    SELECT author, round(engagement_score_raw,6) AS engagement_score_raw,
           round(100.0*(rank() OVER (ORDER BY engagement_score_raw) - 1
             + count(*) OVER (PARTITION BY engagement_score_raw)/2.0) / count(*) OVER (),6) AS engagement_rating
    FROM r""")
def engagement_rating(t):
    return E.rating(t.posts_lean)


@query("user_platform_stats", """
    s AS (SELECT regexp_replace(lower(author), '[^a-z0-9]', '', 'g') AS normalized_author,
           coalesce(sum(likes) FILTER (platform='x'),0) AS x_likes,
           coalesce(sum(views) FILTER (platform='x'),0) AS x_views, count(*) FILTER (platform='x') AS x_posts,
           coalesce(sum(comments) FILTER (platform='youtube'),0) AS youtube_replies,
           count(*) FILTER (platform='youtube') AS youtube_comments,
           coalesce(sum(likes) FILTER (platform='reddit'),0) AS reddit_score,
           round(coalesce(avg(likes) FILTER (platform='reddit'),0),6) AS reddit_avg_score,
           count(*) FILTER (platform='reddit') AS reddit_posts,
           count(*) FILTER (platform='instagram' AND media_type='CAROUSEL_ALBUM') AS instagram_carousel_album,
           count(*) FILTER (platform='instagram' AND media_type='IMAGE') AS instagram_image,
           count(*) FILTER (platform='instagram' AND media_type='VIDEO') AS instagram_video
      FROM posts_lean GROUP BY 1)
    SELECT *, CASE WHEN instagram_carousel_album = 0 AND instagram_image = 0 AND instagram_video = 0 THEN NULL
                   WHEN instagram_carousel_album >= instagram_image AND instagram_carousel_album >= instagram_video
                   THEN 'CAROUSEL_ALBUM' WHEN instagram_image >= instagram_video THEN 'IMAGE' ELSE 'VIDEO' END
              AS instagram_preferred FROM s WHERE normalized_author <> ''""")
def user_platform_stats(t):
    return E.platform_stats(t.posts_lean)


@query("platform_handles", """
    h AS (SELECT author, platform, arg_max(permalink, us::hugeint*1000000000 + post_id) AS sample_post_url,
                 count(*) AS post_count, sum(likes) AS total_likes, sum(comments) AS total_comments,
                 sum(views) AS total_views FROM posts_lean GROUP BY author, platform)
    SELECT *, CASE platform WHEN 'x' THEN 'https://twitter.com/' || lower(author)
                            WHEN 'youtube' THEN 'https://www.youtube.com/@' || author
                            WHEN 'reddit' THEN 'https://reddit.com/user/' || author
                            ELSE 'https://www.instagram.com/' || author || '/' END AS profile_url,
           floor((total_likes+total_comments)*100.0::double/post_count + 0.5)/100 AS avg_engagement_per_post,
           first_value(platform) OVER (PARTITION BY author ORDER BY post_count DESC, platform) AS primary_platform
    FROM h""")
def platform_handles(t):
    return E.handles(t.posts_lean)


@query("platform_handles_map", """
    h AS (SELECT author, platform, arg_max(permalink, us::hugeint*1000000000 + post_id) AS url, count(*) AS n,
                 sum(likes)::BIGINT AS likes, sum(comments)::BIGINT AS comments, sum(views)::BIGINT AS views FROM posts_lean GROUP BY author, platform),
    e AS (SELECT author, platform, n, concat_ws(';', CASE platform WHEN 'x' THEN 'https://twitter.com/' || lower(author)
                            WHEN 'youtube' THEN 'https://www.youtube.com/@' || author
                            WHEN 'reddit' THEN 'https://reddit.com/user/' || author
                            ELSE 'https://www.instagram.com/' || author || '/' END, url, n, likes, comments, views,
                          floor((likes+comments)*100.0::double/n + 0.5)::BIGINT) AS entry FROM h)
    SELECT author, arg_min(platform, (-n, platform)) AS primary_platform,
           string_agg(platform || '=' || entry, ',' ORDER BY platform) AS by_platform FROM e GROUP BY author""")
def platform_handles_map(t):
    whole = lambda c: c.cast("long").cast("string")
    m = E.handle_maps(t.posts_lean)
    texts = F.transform(F.map_entries("by_platform"), lambda e: F.concat(e["key"], F.lit("="), F.concat_ws(
        ";", e["value"]["profile_url"], e["value"]["sample_post_url"],
        *[whole(e["value"][c]) for c in ("post_count", "total_likes", "total_comments", "total_views")],
        whole(F.round(e["value"]["avg_engagement_per_post"] * 100)))))
    return m.select("author", "primary_platform", F.array_join(F.array_sort(texts), ",").alias("by_platform"))


@query("peak_activity", """
    SELECT author, floor(1000.0::double*count(*) FILTER (h>=6 AND h<12)/count(*)+0.5)/1000 AS morning,
           floor(1000.0::double*count(*) FILTER (h>=12 AND h<18)/count(*)+0.5)/1000 AS afternoon,
           floor(1000.0::double*count(*) FILTER (h>=18 AND h<22)/count(*)+0.5)/1000 AS evening,
           floor(1000.0::double*count(*) FILTER (h>=22 OR h<6)/count(*)+0.5)/1000 AS night
    FROM (SELECT author, hour(ts) AS h FROM posts_lean) q GROUP BY author""")
def peak_activity(t):
    return E.peak_activity(t.posts_lean)


@query("hour_dow_histogram", """
    l AS (SELECT author, us + 19800000000 AS lus FROM posts_lean),
    c AS (SELECT author, 'hour' AS kind, hour(make_timestamp(lus)) AS slot, count(*) AS n FROM l GROUP BY 1,3
          UNION ALL
          SELECT author, 'weekday', isodow(make_timestamp(lus)) - 1, count(*) FROM l GROUP BY 1,3)
    SELECT author, kind, slot, n, row_number() OVER (PARTITION BY author, kind ORDER BY n DESC, slot) AS place FROM c
    """)
def hour_dow_histogram(t):
    return E.hour_weekday(t.posts_lean)


@query("keyword_reach", f"""
    SELECT lower(keyword) AS keyword, platform, sum({REACH}) AS total_reach, count(*) AS post_count
    FROM posts_lean GROUP BY 1, 2""")
def keyword_reach(t):
    return R.keyword_reach(t.posts_lean)


@query("channel_strategy", f"""
    k AS (SELECT lower(keyword) AS keyword, platform, sum({REACH}) AS r FROM posts_lean GROUP BY 1, 2),
    g AS (SELECT keyword, p.platform, p.i, coalesce(r, 0) AS reach FROM (SELECT DISTINCT keyword FROM k) q
          CROSS JOIN (VALUES ('x',0),('youtube',1),('reddit',2),('instagram',3)) p(platform,i)
          LEFT JOIN k USING (keyword, platform)),
    o AS (SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY reach DESC, i) AS rn FROM g),
    b AS (SELECT keyword, max(platform) FILTER (rn=1) AS top_channel, max(reach) FILTER (rn=1) AS r1,
                 max(reach) FILTER (rn=2) AS r2 FROM o GROUP BY keyword)
    SELECT keyword, platform, reach, top_channel, round(CASE WHEN r1>0 THEN reach/r1 ELSE 0 END,6) AS relative,
           round(CASE WHEN r2>0 THEN r1/r2 END,6) AS headline_ratio FROM g JOIN b USING (keyword)""")
def channel_strategy(t):
    return R.channel_strategy(R.keyword_reach(t.posts_lean), "keyword")


@query("keyword_variants", """
    a AS (SELECT DISTINCT lower(keyword) AS keyword FROM posts_lean),
    e AS (SELECT DISTINCT entity_id, lower(keyword) AS variant FROM entity_keywords),
    f AS (SELECT DISTINCT a.keyword, e2.variant FROM a JOIN e e1 ON e1.variant = a.keyword
          JOIN e e2 ON e2.entity_id = e1.entity_id)
    SELECT a.keyword, coalesce(f.variant, a.keyword) AS variant FROM a LEFT JOIN f USING (keyword)""")
def keyword_variants(t):
    return R.keyword_variants(t.entity_keywords, t.posts_lean)


@query("platform_breakdown", f"""
    s AS (SELECT lower(keyword) AS v, platform, sum({REACH}) AS m, count(*) AS n FROM posts_lean GROUP BY 1, 2),
    e AS (SELECT DISTINCT entity_id, lower(keyword) AS v FROM entity_keywords),
    p AS (SELECT entity_id, platform, sum(m) AS measure, sum(n) AS post_count FROM e JOIN s USING (v) GROUP BY 1, 2)
    SELECT *, round(CASE WHEN sum(measure) OVER (PARTITION BY entity_id) > 0
                    THEN measure / sum(measure) OVER (PARTITION BY entity_id) ELSE 0 END, 6) AS share FROM p""")
def platform_breakdown(t):
    return R.platform_breakdown(t.posts_lean, t.entity_keywords)


@query("latest_n_per_keyword", """
    SELECT keyword, platform, post_id, rn FROM (
      SELECT *, row_number() OVER (PARTITION BY keyword, platform ORDER BY us DESC NULLS LAST, post_id) AS rn
      FROM posts_lean) q WHERE rn <= 50""")
def latest_n_per_keyword(t):
    return P.newest_per(t.posts_lean, ["keyword", "platform"], 50).select("keyword", "platform", "post_id", "rn")


@query("union_all_platforms", """
    SELECT author, count(*) AS n, min(us) AS first_us, max(us) AS last_us FROM posts_lean GROUP BY author""")
def union_all_platforms(t):
    parts = [t.posts_lean.filter(F.col("platform") == p).select("author", "us")
             for p in ("x", "youtube", "reddit", "instagram")]
    u = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return u.groupBy("author").agg(F.count(F.lit(1)).alias("n"), F.min("us").alias("first_us"),
                                   F.max("us").alias("last_us"))


@query("distinct_authors", """
    SELECT DISTINCT author FROM posts_lean WHERE sentiment_score BETWEEN 1 AND 100 AND trim(author) <> ''""")
def distinct_authors(t):
    return P.valid_sentiment(t.posts_lean).filter(P.has_author()).select("author").distinct()
