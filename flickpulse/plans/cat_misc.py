"""Queries over entities, formulas, policies, files, sinks and streams."""

from __future__ import annotations



from pyspark.sql import functions as F

from flickpulse.functions import columns as C

from flickpulse.operators import engagement as E
from flickpulse.operators import entities as N
from flickpulse.operators import formulas as M
from flickpulse.operators import timeline as TL
from flickpulse.plans.cat_posts import REACH
from flickpulse.plans.cat_timeline import excite_sql
from flickpulse.plans.registry import query
from flickpulse.plans.views import Tables
from flickpulse.sources import files as S
from flickpulse.streaming import streams as X


@query("entity_catalog", """
    SELECT e.entity_id, e.name, k.keyword, max(k.genre) AS grouping FROM entities e JOIN entity_keywords k USING (entity_id)
    WHERE category = 'media.celebrity' GROUP BY 1, 2, 3""")
def entity_catalog(t):
    return N.entity_catalog(t.entities, t.entity_keywords, "media.celebrity")


@query("posts_for_language", """
    SELECT DISTINCT m.mention_id, e.name AS movie, m.platform, m.author, m.us, m.sentiment_score
    FROM mentions m JOIN mention_entities me ON me.mention_id = m.mention_id
    JOIN entities e ON e.entity_id = me.managed_entity_id WHERE e.type = 'MOVIE' AND lower(e.language) = 'l0'
    ORDER BY us DESC NULLS LAST, mention_id, movie LIMIT 50 OFFSET 50""")
def posts_for_language(t):
    return N.posts_for_language(t.entities, t.mention_entities, t.mentions, "L0", 1, 50)


@query("language_audience", """
    r AS (SELECT DISTINCT i.global_user_id, m.mention_id, me.managed_entity_id, m.sentiment_score FROM mentions m
          JOIN mention_entities me ON me.mention_id = m.mention_id JOIN entities e ON e.entity_id = me.managed_entity_id
          JOIN identity_link i ON i.normalized_author = regexp_replace(lower(m.author), '[^a-z0-9]', '', 'g')
          WHERE e.type = 'MOVIE' AND lower(e.language) = 'l1'),
    p AS (SELECT DISTINCT global_user_id, mention_id, sentiment_score FROM r)
    SELECT global_user_id, count(*) AS mention_count,
           floor(avg(sentiment_score) FILTER (sentiment_score BETWEEN 1 AND 100)*10+0.5)/10 AS average_sentiment,
           (SELECT count(DISTINCT managed_entity_id) FROM r WHERE r.global_user_id = p.global_user_id) AS distinct_movies
    FROM p GROUP BY 1""")
def language_audience(t):
    return N.language_audience(t.entities, t.mention_entities, t.mentions, t.identity_link, "l1")


@query("cross_platform_variance", """
    m AS (SELECT i.global_user_id, platform, avg(sentiment_score/100) AS a FROM posts_lean p
          JOIN identity_link i ON i.normalized_author = regexp_replace(lower(p.author), '[^a-z0-9]', '', 'g')
          WHERE sentiment_score <> 0 GROUP BY 1, 2)
    SELECT global_user_id, round(var_pop(a),6) AS variance, count(*) AS n_platforms,
           CASE WHEN var_pop(a) < 0.1 THEN 'evangelist' ELSE 'critic' END AS segment FROM m GROUP BY 1""")
def cross_platform_variance(t):
    return N.cross_platform_variance(t.posts_lean, t.identity_link)


@query("resolve_handle", """
    SELECT 'USER_' || user_id AS handle, 'User_' || user_id AS user FROM (SELECT DISTINCT user_id FROM events) q""")
def resolve_handle(t):
    prof = E.handle_maps(t.posts_lean).withColumnRenamed("author", "user")
    wanted = t.events.select(F.concat(F.lit("USER_"), F.col("user_id").cast("string")).alias("handle")).distinct()
    return N.resolve_handle(prof, wanted)


@query("resolve_seed", """
    s AS (SELECT DISTINCT 'user ' || user_id AS seed, user_id FROM events UNION ALL
          SELECT DISTINCT 'nobody ' || user_id, NULL FROM events)
    SELECT seed, CASE WHEN user_id IS NULL THEN 'unknown' ELSE 'normalized' END AS outcome,
           CASE WHEN user_id IS NOT NULL THEN 'User_' || user_id END AS user FROM s""")
def resolve_seed(t):
    ids = t.events.select(F.col("user_id").cast("string").alias("u")).distinct()
    wanted = ids.select(F.concat(F.lit("user "), "u").alias("seed")).union(ids.select(F.concat(F.lit("nobody "), "u")))
    return N.resolve_seed(t.profiles.withColumnRenamed("global_user_id", "user"), wanted)


@query("chain_evidence", """
    own AS (SELECT DISTINCT r_name AS cohort FROM region WHERE r_name < 'B'),
    st AS (SELECT cohort, p_type AS a, p_brand AS b, p_size % 4 AS lag, count(*) AS score FROM part
           CROSS JOIN (SELECT cohort FROM own UNION ALL SELECT 'ALL') c GROUP BY 1, 2, 3, 4),
    sup AS (SELECT p_type AS a, p_brand AS b, p_size % 4 AS lag, count(*) AS n FROM part WHERE p_size > 25 GROUP BY 1, 2, 3)
    SELECT e.entity_id, st.cohort AS resolved, e.industry NOT IN (SELECT cohort FROM own) AS pooled, st.a AS from_series,
           st.b AS to_series, st.lag AS lag_days, st.score AS path_score, sup.n AS n_entities_supporting
    FROM entities e JOIN st ON st.cohort = CASE WHEN e.industry IN (SELECT cohort FROM own) THEN e.industry ELSE 'ALL' END
    LEFT JOIN sup ON sup.a = st.a AND sup.b = st.b AND sup.lag = st.lag""")
def chain_evidence(t):
    steps = t.part.groupBy("p_type", "p_brand", (F.col("p_size") % 4).alias("lag")).agg(F.count(F.lit(1)).alias("score"))
    cohorts = t.region.filter("r_name < 'B'").select(F.col("r_name").alias("cohort"))
    cohort_list = F.array(*[F.lit(r["cohort"]) for r in cohorts.collect()], F.lit("ALL"))
    chains = steps.select(F.explode(cohort_list).alias("cohort"), F.xxhash64("p_type", "p_brand", "lag").alias("chain_id"),
                          F.col("score").alias("path_score"), F.to_json(F.array(F.struct(
                              F.col("p_type").alias("from"), F.col("p_brand").alias("to"), "lag", F.lit(0.01).alias("q"),
                              F.lit(0.2).alias("effectSize")))).alias("chain_json"))
    edges = (t.part.filter("p_size > 25").groupBy("p_type", "p_brand", (F.col("p_size") % 4).alias("lag_days"))
             .agg(F.count(F.lit(1)).alias("n_entities_supporting"))
             .withColumnRenamed("p_type", "from_series").withColumnRenamed("p_brand", "to_series")
             .withColumn("cohort", F.explode(cohort_list)))
    ents = t.entities.select("entity_id", F.col("industry").alias("cohort"))
    return N.chain_evidence(ents, chains, edges).select("entity_id", "resolved", "pooled", "from_series", "to_series",
                                                        "lag_days", "path_score", "n_entities_supporting")


@query("federated_collate", """
    SELECT 'posts' AS source, platform AS posts_platform, count(*) AS posts_n, NULL AS titles_status, NULL AS titles_n
    FROM posts_lean GROUP BY platform
    UNION ALL SELECT 'titles', NULL, NULL, o_orderstatus, count(*) FROM orders GROUP BY o_orderstatus""")
def federated_collate(t):
    return N.collate({"posts": t.posts_lean.groupBy("platform").agg(F.count(F.lit(1)).alias("n")),
                      "titles": t.orders.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))})


MASK = ("CASE WHEN {c} IS NULL THEN NULL WHEN length({c}) <= 2 THEN '**' WHEN length({c}) <= 4 THEN substr({c},1,1) || '***'"
        " ELSE substr({c},1,1) || '***' || right({c},1) END")


@query("column_policy_projection", f"""
    SELECT c_custkey, {MASK.format(c='c_name')} AS c_name, {MASK.format(c='CAST(c_nationkey AS VARCHAR)')} AS c_nationkey,
           c_mktsegment FROM customer""")
def column_policy_projection(t):
    return N.column_policy(t.customer, "public.customer", skip=["customer.c_acctbal"],
                           mask=["c_name", "public.customer.c_nationkey", "c_acctbal"])


@query("mask_values", f"""
    SELECT DISTINCT p_name, {MASK.format(c='p_name')} AS name_masked, {MASK.format(c='CAST(p_size AS VARCHAR)')} AS size_masked
    FROM part""")
def mask_values(t):
    return t.part.select("p_name", C.mask_value("p_name").alias("name_masked"),
                         C.mask_value("p_size").alias("size_masked")).distinct()


PCT = """
    o AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) AS i, count(*) OVER () AS n FROM orders),
    pos AS (SELECT name, least(greatest((n+1)*p, 1), n) AS h FROM (VALUES ('median', 0.5), ('p95', 0.95)) q(name, p),
            (SELECT max(n) AS n FROM o) z),
    pc AS (SELECT name, (SELECT v FROM o WHERE i = floor(h)) + (h - floor(h)) * ((SELECT v FROM o WHERE i = ceil(h))
               - (SELECT v FROM o WHERE i = floor(h))) AS value FROM pos)"""


@query("formula_statistics", PCT + """
    SELECT formula, CASE formula WHEN 'variance' THEN round(value / 1e4) * 1e4 ELSE round(value, 3) END AS value,
           NULL::VARCHAR AS issue FROM (
      SELECT unnest(['count','sum','mean','min','max','std_dev','variance']) AS formula,
             unnest([count(*)::double, sum(o_totalprice), avg(o_totalprice), min(o_totalprice), max(o_totalprice),
                     stddev_samp(o_totalprice), var_samp(o_totalprice)]) AS value FROM orders
      UNION ALL SELECT name, value FROM pc) q""", digits=3)
def formula_statistics(t):
    wide = F.round(F.col("value") / 1e4) * 1e4  # sums of squares differ in their last digits
    return M.statistics(t.orders, "o_totalprice", {"p95": 0.95}).withColumn(
        "value", F.when(F.col("formula") == "variance", wide).otherwise(F.round("value", 3)))


@query("formula_paired", """
    SELECT unnest(['regression_slope','regression_intercept','correlation','weighted_average','growth_rate','cagr']) AS formula,
           unnest([round(regr_slope(l_extendedprice, l_quantity),4), round(regr_intercept(l_extendedprice, l_quantity),4),
                   round(corr(l_extendedprice, l_quantity),4), round(sum(l_extendedprice*l_quantity)/sum(l_quantity),4),
                   round(arg_max(l_quantity, (l_orderkey, l_partkey, l_linenumber, l_extendedprice))
                     / arg_min(l_quantity, (l_orderkey, l_partkey, l_linenumber, l_extendedprice)) - 1, 4),
                   round(pow(arg_max(l_quantity, (l_orderkey, l_partkey, l_linenumber, l_extendedprice))
                     / arg_min(l_quantity, (l_orderkey, l_partkey, l_linenumber, l_extendedprice)), 1/10.0) - 1, 4)]) AS value,
           NULL::VARCHAR AS issue FROM lineitem""", digits=4)
def formula_paired(t):
    li = t.lineitem
    order = ["l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice"]
    return (M.paired(li, "l_quantity", "l_extendedprice").unionByName(M.weighted_average(li, "l_extendedprice", "l_quantity"))
            .unionByName(M.growth(li, "l_quantity", order, periods=10)))


@query("formula_expression", """
    SELECT 'spread' AS formula, round((max(o_totalprice) - min(o_totalprice)) / avg(o_totalprice),6) AS value, NULL::VARCHAR AS issue
    FROM orders""")
def formula_expression(t):
    return M.expression(M.statistics(t.orders, "o_totalprice"), "spread", "(max - min) / mean")


@query("scalar_functions", """
    SELECT post_id, round(1/(1+exp(-(sentiment_score-50)/10)),6) AS sig, round(likes/(likes+5),6) AS sat,
           round(log10(1+views)/(log10(1+views)+4),6) AS logsat, floor((sentiment_score-50)*1.5+0.5)+0.0 AS half_up,
           least(greatest(sentiment_score/50,0),1) AS clamped,
           CASE WHEN sentiment_score >= 80 THEN 'Very High' WHEN sentiment_score >= 60 THEN 'High' WHEN sentiment_score >= 40
                THEN 'Moderate' WHEN sentiment_score >= 20 THEN 'Low' ELSE 'Very Low' END AS band,
           CASE WHEN views > 10000 THEN 'LURKER_' ELSE '' END ||
           CASE WHEN views > 10000 AND comments = 0 THEN 'LURKER' WHEN views < 1000 AND comments < 100 THEN 'LOW_ACTIVITY'
                ELSE 'UNKNOWN' END AS activity,
           CASE WHEN platform = 'x' THEN split_part(permalink, '/', 4) END AS handle
    FROM posts_lean""")
def scalar_functions(t):
    s = F.col("sentiment_score")
    return t.posts_lean.select(
        "post_id", C.sigmoid((s - 50) / 10).alias("sig"), C.saturate("likes", 5).alias("sat"),
        C.log_saturate("views", 4).alias("logsat"), C.round_half_up((s - 50) * 1.5, 0).alias("half_up"),
        C.clamp(s / 50).alias("clamped"), C.band("sentiment_score").alias("band"),
        F.concat(F.when(F.col("views") > 10000, "LURKER_").otherwise(""), C.activity_class("views", "comments")).alias("activity"),
        C.x_handle("permalink").alias("handle"))


@query("vector_functions", """
    SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x*x))),6) AS norm,
           round(list_cosine_similarity(embedding::DOUBLE[], list_reverse(embedding)::DOUBLE[]),6)+0.0 AS self_reverse
    FROM embeddings""")
def vector_functions(t):
    return t.embeddings.select("vec_id", C.l2_norm("embedding").alias("norm"),
                               C.cosine("embedding", F.reverse("embedding")).alias("self_reverse"))


# ---- files ---------------------------------------------------------------------------------------------------------
@query("read_json_mapped", """
    SELECT event_id, json_extract_string(props, '$.k') AS k FROM events""")
def read_json_mapped(t):
    return S.json_fields(t.events, "props", {"k": "k"}).select("event_id", "k")


@query("read_csv_mapped", "SELECT p_partkey::varchar AS part_id, p_name AS title FROM part")
def read_csv_mapped(t):
    path = S.shared_folder(t.spark)
    t.part.write.option("header", True).option("sep", "\t").option("compression", "gzip").csv(path)
    return S.read_csv_mapped(t.spark, path, {"p_partkey": "part_id", "p_name": "title", "absent": "x"}, sep="\t")


@query("extract_html_fields", r"""
    x AS (SELECT page_id, regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title\s*>', 1) AS t,
                 regexp_extract(html, '(?is)<h1\b[^>]*>(.*?)</h1\s*>', 1) AS h FROM pages)
    SELECT page_id, nullif(trim(regexp_replace(regexp_replace(t, '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')), '') AS title,
           nullif(trim(regexp_replace(regexp_replace(h, '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')), '') AS heading FROM x""")
def extract_html_fields(t):
    return S.html_fields(t.pages, {"title": "title", "heading": "h1"}).select("page_id", "title", "heading")


@query("append_posts", """
    SELECT platform, 2*count(*) AS n FROM posts_lean GROUP BY platform""")
def append_posts(t):
    path = S.shared_folder(t.spark)
    rows = t.posts_lean.select("platform", "post_id", "author", "us")
    S.append_checked(rows, path)
    S.append_checked(rows, path)
    return t.spark.read.parquet(path).groupBy("platform").agg(F.count(F.lit(1)).alias("n"))


@query("upsert_by_key", """
    SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'NEW' ELSE c_mktsegment END AS segment FROM customer""")
def upsert_by_key(t):
    old = t.customer.select("c_custkey", F.col("c_mktsegment").alias("segment"))
    new = t.customer.filter("c_acctbal < 0").select("c_custkey", F.lit("NEW").alias("segment"))
    return S.upsert(S.upsert(old, new, ["c_custkey"]), new, ["c_custkey"])


@query("fill_null_merge", """
    SELECT t.title_id, coalesce(t.gdp_usd_billions, o.o_totalprice) AS gdp_usd_billions, t.inflation_rate_pct
    FROM titles t JOIN orders o ON o.o_orderkey = t.title_id""")
def fill_null_merge(t):
    source = t.orders.select(F.col("o_orderkey").alias("title_id"), F.col("o_totalprice").alias("gdp_usd_billions"))
    target = t.titles.select("title_id", "gdp_usd_billions", "inflation_rate_pct")
    return S.fill_nulls(target, source, ["title_id"], ["gdp_usd_billions"])


@query("overwrite_atomic", f"""
    SELECT lower(keyword) AS keyword, platform, sum({REACH}) AS total_reach, count(*) AS post_count FROM posts_lean GROUP BY 1, 2""")
def overwrite_atomic(t):
    from flickpulse.operators import reach as R
    path = S.shared_folder(t.spark)
    S.publish(R.keyword_reach(t.posts_lean).filter("platform = 'x'"), path)
    S.publish(R.keyword_reach(t.posts_lean), path)
    return S.read_published(t.spark, path)


@query("append_run_history", """
    SELECT run_id, n FROM (SELECT 'run-1' AS run_id, count(*) AS n FROM orders UNION ALL
                           SELECT 'run-2', count(*) FROM lineitem) q""")
def append_run_history(t):
    path = S.shared_folder(t.spark)
    S.append_run(t.orders.agg(F.count(F.lit(1)).alias("n")), path, "run-1")
    S.append_run(t.lineitem.agg(F.count(F.lit(1)).alias("n")), path, "run-2")
    return t.spark.read.parquet(path).select("run_id", "n")


@query("fetch_log", """
    SELECT CASE WHEN length(html) > 0 THEN 'success' ELSE 'failure' END AS status, count(*) AS n FROM pages GROUP BY 1""")
def fetch_log(t):
    path = S.shared_folder(t.spark)
    S.log_fetches(t.pages.select(F.col("url").alias("source"), F.when(F.length("html") > 0, "success").otherwise("failure")
                                 .alias("status"), F.col("html").alias("payload")), path)
    return t.spark.read.parquet(path).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("sink_csv_json_report", "SELECT n_name, n_regionkey::varchar AS n_regionkey FROM nation")
def sink_csv_json_report(t):
    path = S.shared_folder(t.spark)
    S.write_report(t.nation.select("n_name", "n_regionkey"), path)
    csv = t.spark.read.option("header", True).csv(path + "/csv")
    js = t.spark.read.json(path + "/json").select("n_name", F.col("n_regionkey").cast("string"))
    return csv.intersect(js)


# ---- streams -------------------------------------------------------------------------------------------------------
CLOSED = "(SELECT max(us) FROM posts_lean) - 86400000000"


def live(t):
    """The posts view over `events` read as a stream."""
    return Tables(t.spark, t.sf_dir, streamed="events")


@query("stream_reach_tumbling", f"""
    SELECT us//86400000000*86400000000 AS day_us, lower(keyword) AS keyword, platform, sum({REACH}) AS total_reach,
           count(*) AS post_count FROM posts_lean WHERE us//86400000000*86400000000 + 86400000000 <= {CLOSED} GROUP BY 1, 2, 3""")
def stream_reach_tumbling(t):
    return X.run_to_table(X.daily_reach(live(t).posts_lean), t.spark)


@query("stream_volume_sliding", f"""
    SELECT (us//86400000000 - d)*86400000000 AS start_us, platform, count(*) FILTER (sentiment_score > 75) AS positive,
           count(*) FILTER (sentiment_score < 50) AS negative FROM posts_lean, range(0, 7) r(d)
    WHERE sentiment_score <> 0 AND (us//86400000000 - d + 7)*86400000000 <=
          (SELECT max(us) FROM posts_lean WHERE sentiment_score <> 0) - 86400000000 GROUP BY 1, 2""")
def stream_volume_sliding(t):
    return X.run_to_table(X.sliding_tone(live(t).posts_lean), t.spark)


@query("stream_burst_sessions", """
    l AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY author ORDER BY us) < 600000000 THEN 0 ELSE 1 END AS s FROM posts_bursty),
    g AS (SELECT *, sum(s) OVER (PARTITION BY author ORDER BY us ROWS UNBOUNDED PRECEDING) AS g FROM l)
    SELECT author, min(us) AS start_us, count(*) AS n_posts FROM g GROUP BY author, g
    HAVING count(*) >= 3 AND max(us) + 600000000 <= (SELECT max(us) FROM posts_bursty) - 86400000000""")
def stream_burst_sessions(t):
    return X.run_to_table(X.burst_sessions(live(t).posts_bursty), t.spark)


@query("stream_dedupe", "SELECT platform, count(*) AS n FROM posts_lean GROUP BY 1")
def stream_dedupe(t):
    once, again = live(t).posts_lean, live(t).posts_lean
    cols = ["platform", "post_id", "ts"]
    kept = X.run_to_table(X.dedupe(once.select(*cols).unionByName(again.select(*cols))), t.spark)
    return kept.groupBy("platform").agg(F.count(F.lit(1)).alias("n"))


@query("stream_profile_upsert", f"""
    SELECT author, count(*) AS n_posts, sum({REACH}) AS total_reach FROM posts_lean GROUP BY 1""")
def stream_profile_upsert(t):
    path = X.run_for_each_batch(live(t).posts_lean, t.spark, X.upsert_totals)
    return S.read_published(t.spark, path).select("author", "n_posts", "total_reach")


@query("stream_excitation", excite_sql("posts_bursty", 0.1, "60000000.0") + """
    SELECT author, post_id, round(excite,6) AS excite FROM ex""")
def stream_excitation(t):
    return X.run_to_table(X.excitation(live(t).posts_bursty, TL.PER_MINUTE), t.spark)



