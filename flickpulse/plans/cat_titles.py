"""Queries over titles and credits."""

from __future__ import annotations

from pyspark.sql import functions as F

from flickpulse.functions import columns as C
from flickpulse.functions import vocab
from flickpulse.operators import scale
from flickpulse.operators import titles as T
from flickpulse.plans.registry import query

_q = lambda s: "'" + s.replace("'", "''") + "'"
HOME_RE = r"'(?i)\b(" + "|".join(vocab.HOME_LANGUAGES) + r")\b'"
CL = rf"""
    cl AS (SELECT *, CAST(substr(release_date, 1, 4) AS INT) AS release_year,
              CASE WHEN length(release_date) = 10 THEN CAST(release_date AS DATE) END AS release_day,
              lower(trim(movie_name)) || '|' || substr(release_date, 1, 4) AS movie_key,
              lower(trim(split_part(genre, ',', 1))) AS primary_genre,
              CASE WHEN regexp_matches(language, {HOME_RE}) OR trim(country) = 'India' THEN 1 ELSE 0 END AS market_is_home,
              coalesce(budget > 0 AND revenue > 0, false) AS has_financials FROM titles)"""
ROWF = CL + """,
    rf AS (SELECT * FROM cl WHERE release_year > 1900 AND budget > 10000 AND revenue >= 10000)"""
DD = ROWF + """,
    dd AS (SELECT * FROM rf QUALIFY row_number() OVER (PARTITION BY movie_key ORDER BY
             (conflict_balance_score IS NOT NULL)::int + (release_day IS NOT NULL)::int + (length(directors) > 0)::int DESC,
             coalesce(revenue, -1e300) DESC, title_id) = 1)"""
FIN = """
    fin AS (SELECT movie_key, arg_min(budget, title_id) AS own_budget, arg_min(revenue, title_id) AS own_revenue
            FROM cl WHERE has_financials GROUP BY 1)"""
CR = CL + "," + FIN + """,
    cr AS (SELECT c.*, CAST(substr(c.release_date, 1, 4) AS INT) AS year, lower(trim(actor_name)) AS actor_key,
                  lower(trim(director)) AS director_key, lower(trim(c.movie_name)) || '|' || substr(c.release_date, 1, 4) AS movie_key,
                  CASE WHEN role_position = 1 THEN 1.0 WHEN role_position = 2 THEN 0.4 ELSE 0.15 END AS role_wt,
                  title_id * 1000000 + credit_seq AS credit_order FROM credits c),
    crf AS (SELECT cr.*, own_revenue/own_budget AS ratio, CASE WHEN own_revenue/own_budget >= 1.5 THEN 1.0
                   WHEN own_revenue/own_budget IS NOT NULL THEN 0.0 END AS hit FROM cr LEFT JOIN fin USING (movie_key))"""


def cleaned(t):
    return T.clean(t.titles)


def deduped(t):
    return scale.stage(T.dedupe(T.row_filter(cleaned(t), min_year=1900)))


def credits(t, financials: bool = True):
    c = t.credits.withColumn("credit_order", F.col("title_id") * 1_000_000 + F.col("credit_seq"))
    return T.clean_credits(c, T.prior_financials(cleaned(t)) if financials else None)


@query("title_row_filter", CL + """
    SELECT title_id, movie_key, release_year FROM cl WHERE release_year > 1995 AND budget > 10000 AND revenue >= 10000
    AND market_is_home = 1""")
def title_row_filter(t):
    return T.row_filter(cleaned(t), min_year=1995, home_only=True).select("title_id", "movie_key", "release_year")


@query("market_tag", CL + "SELECT language, country, market_is_home, count(*) AS n FROM cl GROUP BY 1, 2, 3")
def market_tag(t):
    return cleaned(t).groupBy("language", "country", "market_is_home").agg(F.count(F.lit(1)).alias("n"))


@query("has_financials", CL + "SELECT title_id, has_financials FROM cl")
def has_financials(t):
    return cleaned(t).select("title_id", "has_financials")


@query("foreign_production_filter", CL + rf"""
    SELECT title_id FROM cl WHERE regexp_matches(language, {HOME_RE}) OR lower(trim(directors)) IN (
      SELECT lower(trim(director)) FROM credits WHERE regexp_matches(language, {HOME_RE}))""")
def foreign_production_filter(t):
    return T.foreign_production_filter(cleaned(t), t.credits).select("title_id")


@query("ratings_join_filter", """
    SELECT o_orderkey AS title_id, n AS votes, o_totalprice AS rating FROM orders
    JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) r ON l_orderkey = o_orderkey
    WHERE o_orderstatus = 'F' AND n >= 4""")
def ratings_join_filter(t):
    ratings = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("votes"))
    return t.orders.filter("o_orderstatus = 'F'").join(ratings.filter("votes >= 4"), "o_orderkey").select(
        F.col("o_orderkey").alias("title_id"), "votes", F.col("o_totalprice").alias("rating"))


@query("dedupe_titles", DD + "SELECT title_id, movie_key, revenue FROM dd")
def dedupe_titles(t):
    return deduped(t).select("title_id", "movie_key", "revenue")


@query("prior_financials", CL + "," + FIN + "SELECT * FROM fin")
def prior_financials(t):
    return T.prior_financials(cleaned(t))


@query("dubbing_breadth", CL + """
    SELECT title_id, n AS dubbing_breadth FROM cl JOIN (SELECT lower(trim(movie_name)) AS k, release_date AS rd,
      count(DISTINCT language) AS n FROM cl GROUP BY 1, 2) q ON k = lower(trim(movie_name)) AND rd = release_date""")
def dubbing_breadth(t):
    return T.dubbing_breadth(cleaned(t)).select("title_id", "dubbing_breadth")


FB = CR + """,
    fb AS (SELECT *, rank() OVER (PARTITION BY actor_key ORDER BY year, credit_order) - 1 AS films_before FROM cr),
    pop AS (SELECT *, CASE WHEN films_before <= 2 THEN 0.10+films_before*0.075 WHEN films_before <= 14
              THEN 0.25+(films_before-2)*(0.45/12) WHEN films_before <= 15 THEN 0.70+(films_before-14)*0.05
              WHEN films_before <= 35 THEN 0.75+(films_before-15)*0.012 ELSE 0.99 END AS popularity FROM fb),
    star AS (SELECT movie_key, sum(role_wt*popularity)/sum(role_wt) AS r_star, count(*) AS n_cast FROM pop GROUP BY 1)"""


@query("films_before", FB + "SELECT actor_key, credit_order, films_before FROM fb")
def films_before(t):
    rows = credits(t, False).select("actor_key", "credit_order", "year")
    return T.films_before(rows, "credit_order").select("actor_key", "credit_order", "films_before")


@query("credit_features", FB + "SELECT movie_key, n_cast, round(ln(r_star),6) AS ln_r_star FROM star")
def credit_features(t):
    return T.star_strength(credits(t, False), "credit_order").select("movie_key", "n_cast",
                                                                     F.log("r_star").alias("ln_r_star"))


@query("overexposure", CR + """,
    leads AS (SELECT * FROM cr QUALIFY role_wt >= 0.4 OR count(*) FILTER (role_wt >= 0.4) OVER (PARTITION BY movie_key) = 0),
    ay AS (SELECT actor_key, year, movie_key, count(*) AS n FROM cr GROUP BY 1, 2, 3),
    oc AS (SELECT l.movie_key, l.credit_order, l.actor_key, coalesce(sum(n), 0) AS c FROM leads l LEFT JOIN ay a
           ON a.actor_key = l.actor_key AND a.movie_key <> l.movie_key AND a.year BETWEEN l.year-1 AND l.year GROUP BY 1, 2, 3)
    SELECT movie_key, round(avg(c),6) AS overexposure FROM oc GROUP BY 1""")
def overexposure(t):
    return T.overexposure(credits(t, False))


LEAD = """
    lead_ AS (SELECT movie_key, actor_key AS lead_key, year FROM cr WHERE role_position IS NOT NULL
              QUALIFY row_number() OVER (PARTITION BY movie_key ORDER BY role_position, actor_key) = 1)"""


@query("lead_actor", CR + "," + LEAD + "SELECT movie_key, lead_key FROM lead_")
def lead_actor(t):
    return T.lead_actor(credits(t, False)).select("movie_key", "lead_key")


@query("strictly_prior_join", CR + """,
    y AS (SELECT actor_key, year, count(*) AS n FROM cr GROUP BY 1, 2)
    SELECT a.actor_key, a.year, coalesce(sum(b.n), 0) AS prior_films FROM y a LEFT JOIN y b
    ON b.actor_key = a.actor_key AND b.year < a.year GROUP BY 1, 2""")
def strictly_prior_join(t):
    c = credits(t, False)
    return T.prior_sums(c.select("actor_key", "year", F.lit(1).alias("n")), c, "actor_key", ["n"]).select(
        "actor_key", "year", F.col("prior_n").alias("prior_films"))


@query("track_record", CR + "," + LEAD + ", " + DD[len(CL) + 1:] + """,
    ay AS (SELECT actor_key, year, count(*) AS n, coalesce(sum(hit),0) AS h, count(hit) AS k, coalesce(sum(ratio),0) AS r
           FROM crf GROUP BY 1, 2),
    ap AS (SELECT *, coalesce(sum(n) OVER w, 0) AS pn, sum(h) OVER w AS ph, sum(k) OVER w AS pk,
              lag(CASE WHEN k>0 THEN h/k END) OVER (PARTITION BY actor_key ORDER BY year) AS lh,
              lag(CASE WHEN k>0 THEN r/k END) OVER (PARTITION BY actor_key ORDER BY year) AS lr
           FROM ay WINDOW w AS (PARTITION BY actor_key ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    le AS (SELECT movie_key, pn, lh, lr FROM lead_ l JOIN ap ON ap.actor_key = l.lead_key AND ap.year = l.year),
    en AS (SELECT movie_key, sum(role_wt*ph/pk)/sum(role_wt) AS e FROM cr JOIN ap USING (actor_key, year) WHERE pk > 0 GROUP BY 1),
    df AS (SELECT director_key, movie_key, year, max(hit) AS hit FROM crf GROUP BY 1, 2, 3),
    di AS (SELECT d.movie_key, count(f.movie_key) AS dn, sum(f.hit)/nullif(count(f.hit),0) AS dh FROM dd d
           LEFT JOIN df f ON f.director_key = lower(trim(d.directors)) AND f.year < d.release_year GROUP BY 1)
    SELECT d.movie_key, le.pn AS lead_prior_films, round(lh,6) AS lead_last_hit, round(lr,6) AS lead_last_ratio,
           dn AS director_prior_films, round(dh,6) AS director_hit_rate, round(e,6) AS ensemble_hit_rate
    FROM dd d LEFT JOIN le USING (movie_key) LEFT JOIN en USING (movie_key) LEFT JOIN di USING (movie_key)""")
def track_record(t):
    return T.track_record(deduped(t), credits(t))


@query("director_prior_releases", DD + """,
    k AS (SELECT title_id, lower(trim(split_part(directors, ',', 1))) AS director_key, release_year FROM dd)
    SELECT a.title_id, a.director_key, count(b.title_id) AS director_prior_releases FROM k a LEFT JOIN k b
    ON b.director_key = a.director_key AND b.release_year < a.release_year GROUP BY 1, 2""")
def director_prior_releases(t):
    return T.director_prior_releases(deduped(t))


def anchor_sql(col: str, name: str) -> str:
    return f"""
    {name}_m AS (SELECT a.title_id, avg(ln(b.revenue)) AS m FROM dd a LEFT JOIN dd b ON b.{col} = a.{col}
                 AND b.release_year < a.release_year GROUP BY 1),
    {name}_r AS (SELECT title_id, (rank() OVER (ORDER BY round(m,9)) - 1 + (count(*) OVER (PARTITION BY round(m,9)) + 1)/2.0)
                        / count(*) OVER () AS p FROM {name}_m WHERE m IS NOT NULL),
    {name} AS (SELECT m.title_id, coalesce(p, (SELECT median(p) FROM {name}_r)) AS {name} FROM {name}_m m
               LEFT JOIN {name}_r USING (title_id))"""


@query("historical_anchor", DD + "," + anchor_sql("directors", "r_director") + """
    SELECT title_id, round(r_director,4) AS r_director FROM r_director""", digits=4)
def historical_anchor(t):
    d = deduped(t).withColumn("director_key", F.lower(F.trim("directors")))
    return T.historical_anchor(d, "director_key", "r_director")


BE = DD + """,
    ry AS (SELECT max(release_year) AS y FROM dd),
    gr AS (SELECT median(gdp_usd_billions) AS g FROM dd, ry WHERE release_year >= y-2 AND gdp_usd_billions > 0),
    be AS (SELECT title_id, budget * pow(1 + least(greatest(coalesce(inflation_rate_pct,0),-20),50)/100, greatest(y-release_year,0))
                  * CASE WHEN gdp_usd_billions > 0 THEN g/gdp_usd_billions ELSE 1 END
                  * CASE WHEN trailer_days_to_release IS NOT NULL THEN 1 ELSE 0.775 END AS b FROM dd, ry, gr)"""


@query("budget_effective", BE + "SELECT title_id, round(ln(b),6) AS ln_budget_effective FROM be")
def budget_effective(t):
    return T.budget_effective(deduped(t)).select("title_id", F.log("budget_effective").alias("ln_budget_effective"))


TS = DD + """,
    vp AS (SELECT title_id, (rank() OVER (ORDER BY coalesce(trailer_views,0)) - 1
              + (count(*) OVER (PARTITION BY coalesce(trailer_views,0)) + 1)/2.0)/count(*) OVER () AS p FROM dd),
    ts AS (SELECT title_id, CASE WHEN d < 14 THEN -1.0 WHEN d < 30 THEN -1+(d-14)/16*2 WHEN d <= 45 THEN 1.0
              WHEN d <= 90 THEN 1-(d-45)/45 WHEN d > 90 THEN -0.4 END + (p-0.5)*0.5 AS trailer_timing,
              CASE WHEN s < 21 THEN -0.5 WHEN s < 42 THEN -0.5+(s-21)/21*1.5 WHEN s <= 56 THEN 1.0
              ELSE CASE WHEN s IS NOT NULL THEN 1-(least(s,120)-56)/64*1.2 END END AS song_timing,
              least(greatest(runtime_mins-160,0),60) AS excess_runtime
           FROM (SELECT *, trailer_days_to_release AS d, song_days_to_release AS s FROM dd) q JOIN vp USING (title_id))"""


@query("timing_scores", TS + """
    SELECT title_id, round(trailer_timing,5)+0.0 AS trailer_timing, round(song_timing,5)+0.0 AS song_timing, excess_runtime FROM ts""",
       digits=5)
def timing_scores(t):
    return T.timing_scores(deduped(t)).select("title_id", "trailer_timing", "song_timing", "excess_runtime")


FEST = " OR ".join(f"month(release_day)*100+day(release_day) BETWEEN {a*100+b} AND {c*100+d}"
                   for a, b, c, d in vocab.FESTIVE_WINDOWS)


@query("calendar_flags", CL + f"""
    SELECT title_id, CASE WHEN ok THEN ({FEST})::int END AS festive,
           CASE WHEN ok THEN (month(release_day) IN (2,3,4))::int END AS exam_season,
           CASE WHEN ok THEN (month(release_day) IN (3,4,5))::int END AS league_season,
           CASE WHEN ok THEN (month(release_day) IN (4,5,6))::int END AS summer
    FROM (SELECT *, market_is_home = 1 AND release_day IS NOT NULL AS ok FROM cl) q""")
def calendar_flags(t):
    return T.calendar_flags(cleaned(t)).select("title_id", "festive", "exam_season", "league_season", "summer")


@query("release_clash_count", CL + """,
    n AS (SELECT language, release_day AS d, count(*) AS n FROM cl WHERE release_day IS NOT NULL GROUP BY 1, 2)
    SELECT title_id, sum(n) - 1 AS clashes FROM cl JOIN n ON n.language = cl.language
    AND n.d BETWEEN release_day - 3 AND release_day + 3 GROUP BY 1""")
def release_clash_count(t):
    return T.release_clashes(cleaned(t)).select("title_id", "clashes")


@query("asof_prior_close", CL + """
    SELECT title_id, close FROM (SELECT title_id, release_day FROM cl WHERE release_day IS NOT NULL) a
    ASOF LEFT JOIN market_index m ON a.release_day >= m.trade_date""")
def asof_prior_close(t):
    rows = cleaned(t).select("title_id", "release_day", F.lit("COMPOSITE").alias("index_name"))
    return T.prior_close(rows, t.market_index, "release_day", "close").select("title_id", "close")


@query("index_momentum", CL + """,
    h AS (SELECT title_id, release_day, release_day - 90 AS e FROM cl WHERE release_day IS NOT NULL AND market_is_home = 1),
    a AS (SELECT h.*, m.close AS c1 FROM h ASOF LEFT JOIN market_index m ON h.release_day >= m.trade_date),
    b AS (SELECT a.*, m.close AS c0 FROM a ASOF LEFT JOIN market_index m ON a.e >= m.trade_date)
    SELECT title_id, c1 AS close_now, round(CASE WHEN c0 <> 0 THEN 100*(c1-c0)/c0 END,6)+0.0 AS change_pct FROM b""")
def index_momentum(t):
    return T.index_momentum(cleaned(t), t.market_index, "COMPOSITE")


@query("price_interval_join", CL + rf""",
    ti AS (SELECT title_id, release_day, CASE WHEN market_is_home = 1 THEN CASE WHEN lower(trim(language)) IN ('hindi','english')
             THEN 'tier_1' WHEN regexp_matches(language, {HOME_RE}) THEN 'tier_2_3' ELSE 'national_average' END END AS city_tier FROM cl)
    SELECT title_id, ti.city_tier, atp_usd FROM ti JOIN ticket_prices p ON p.city_tier = ti.city_tier
    AND release_day BETWEEN period_start AND period_end
    QUALIFY row_number() OVER (PARTITION BY title_id ORDER BY period_start, period_end, atp_usd) = 1""")
def price_interval_join(t):
    return T.price_interval_join(cleaned(t), t.ticket_prices)


@query("macro_fill_join", CL + """,
    c AS (SELECT *, CASE trim(split_part(country, ',', 1)) WHEN 'India' THEN 'IND' WHEN 'USA' THEN 'USA'
                    WHEN 'South Korea' THEN 'KOR' END AS iso3 FROM cl)
    SELECT title_id, c.iso3, coalesce(c.gdp_usd_billions, m.gdp_usd_billions) AS gdp_usd_billions,
           coalesce(c.inflation_rate_pct, m.inflation_rate_pct) AS inflation_rate_pct,
           CASE WHEN c.gdp_usd_billions IS NOT NULL AND c.inflation_rate_pct IS NOT NULL THEN 'complete'
                WHEN c.iso3 IS NULL THEN 'unmapped country' WHEN m.iso3 IS NULL THEN 'no data' ELSE 'filled' END AS macro_status
    FROM c LEFT JOIN macro m ON m.iso3 = c.iso3 AND m.year = c.release_year""")
def macro_fill_join(t):
    return T.macro_fill(cleaned(t), t.macro).select("title_id", "iso3", "gdp_usd_billions", "inflation_rate_pct",
                                                    "macro_status")


@query("news_event_flag", CL + r""",
    ph(cls, p) AS (VALUES """ + ", ".join(f"({_q(k)}, {_q(p)})" for k, ps in vocab.EVENT_PHRASES.items() for p in ps) + r"""),
    w AS (SELECT doc_id, pub_date, lower(text) AS lt,
                 ' ' || array_to_string(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> ''), ' ') || ' ' AS nt
          FROM articles),
    ac AS (SELECT DISTINCT doc_id, pub_date, nt, cls FROM w JOIN ph ON contains(lt, p)),
    tt AS (SELECT title_id, release_day, ' ' || array_to_string(list_filter(regexp_split_to_array(lower(movie_name),
                  '[^\p{L}\p{N}]+'), lambda x: x <> ''), ' ') || ' ' AS nm FROM cl WHERE release_day IS NOT NULL),
    hit AS (SELECT DISTINCT title_id, cls FROM tt JOIN ac
            ON pub_date BETWEEN release_day - 45 AND release_day + 45 AND contains(nt, nm))
    SELECT title_id, c.cls AS event_class, (hit.cls IS NOT NULL)::int AS flag
    FROM cl CROSS JOIN (SELECT DISTINCT cls FROM ph) c LEFT JOIN hit USING (title_id, cls)""")
def news_event_flag(t):
    return T.news_event_flags(cleaned(t), t.articles)


@query("peer_budget_rank", DD + """
    SELECT title_id, round(1 - (rank() OVER (PARTITION BY primary_genre, release_year ORDER BY budget) - 1
       + (count(*) OVER (PARTITION BY primary_genre, release_year, budget) + 1)/2.0)
       / count(*) OVER (PARTITION BY primary_genre, release_year), 6)+0.0 AS peer_budget_efficiency FROM dd""")
def peer_budget_rank(t):
    return T.peer_budget_rank(deduped(t)).select("title_id", "peer_budget_efficiency")


FACTS = TS + r""",
    fl AS (SELECT title_id, 'joint_production_partnerships' AS factor, len(string_split(production_companies, ','))::double AS value FROM dd
           UNION ALL SELECT title_id, 'certificate', CASE upper(regexp_replace(cbfc_rating, '[\s/\-]', '', 'g'))
                     WHEN 'U' THEN 2.0 WHEN 'UA' THEN 1.0 WHEN 'S' THEN 1.0 WHEN 'A' THEN 0.0 END FROM dd
           UNION ALL SELECT title_id, 'remake_rights', CASE WHEN overview IS NOT NULL THEN
                     contains(lower(overview), 'official remake of')::int END FROM dd
           UNION ALL SELECT title_id, 'excess_runtime', -excess_runtime FROM ts
           UNION ALL SELECT title_id, 'trailer_timing', round(trailer_timing,9) FROM ts
           UNION ALL SELECT title_id, 'song_timing', round(song_timing,9) FROM ts
           UNION ALL SELECT title_id, 'rating', imdb_rating FROM dd
           UNION ALL SELECT d.title_id, k.k, value_numeric FROM dd d CROSS JOIN (VALUES ('shipping_pace'),('priority_level')) k(k)
                     LEFT JOIN factor_values v ON v.title_id = d.title_id AND v.factor_key = k.k),
    fb2(factor, lo, hi) AS (VALUES ('joint_production_partnerships', 0.0, 0.2), ('certificate', -0.3, 0.3),
           ('remake_rights', -0.2, 0.1), ('excess_runtime', -0.3, 0.0), ('trailer_timing', -0.2, 0.3),
           ('song_timing', -0.1, 0.2), ('rating', 0.0, 0.4), ('shipping_pace', 0.0, 0.2), ('priority_level', 0.0, 0.2)),
    fr AS (SELECT title_id, factor, (rank() OVER (PARTITION BY factor ORDER BY value) - 1
                  + (count(*) OVER (PARTITION BY factor, value) + 1)/2.0)/count(*) OVER (PARTITION BY factor) AS p
           FROM fl WHERE value IS NOT NULL),
    bd AS (SELECT title_id, factor, lo + coalesce(p, 0.5)*(hi-lo) AS banded FROM fl LEFT JOIN fr USING (title_id, factor)
           JOIN fb2 USING (factor))"""


def factor_inputs(t):
    base = scale.stage(T.timing_scores(deduped(t)))
    registry = T.registry_of_titles() + [
        {"factor_key": k, "computation": "value_table", "source": k, "lo": 0.0, "hi": 0.2, "direction": "Positive"}
        for k in ("shipping_pace", "priority_level")]
    return base, registry


@query("band_rescale", FACTS + """
    SELECT title_id, factor, round(banded,5)+0.0 AS banded FROM bd WHERE factor IN ('rating', 'certificate', 'excess_runtime')""",
       digits=5)
def band_rescale(t):
    d = T.timing_scores(deduped(t))
    long = T.long_factors(d, "title_id", {"rating": F.col("imdb_rating"), "certificate": C.certificate_ordinal("cbfc_rating"),
                                          "excess_runtime": F.col("excess_runtime")})
    return T.band_rescale(long, "title_id", {"rating": (0, .4), "certificate": (-.3, .3), "excess_runtime": (-.3, 0)},
                          {"excess_runtime"})


@query("registry_features", FACTS + """
    SELECT title_id, """ + ", ".join(
    f"round(max(banded) FILTER (factor = '{n}'),4)+0.0 AS {n}" for n in (
        "joint_production_partnerships", "certificate", "remake_rights", "excess_runtime", "trailer_timing",
        "song_timing", "rating", "shipping_pace", "priority_level")) + " FROM bd GROUP BY 1", digits=4)
def registry_features(t):
    base, registry = factor_inputs(t)
    return T.registry_features(base, "title_id", registry, t.factor_values)


@query("coverage_report", FACTS + """
    SELECT factor, count(value) AS n_known, round(100.0*count(value)/count(*),6) AS coverage_pct,
           round(corr(CASE WHEN factor = 'excess_runtime' THEN -value ELSE value END, ln(revenue)),6)+0.0 AS corr_ln_revenue
    FROM fl JOIN dd USING (title_id) WHERE factor NOT IN ('shipping_pace', 'priority_level') GROUP BY 1""")
def coverage_report(t):
    base, registry = factor_inputs(t)
    direct = {r["factor_key"]: F.col(r["source"]) if isinstance(r["source"], str) else r["source"] for r in registry
              if r["computation"] != "value_table"}
    return T.coverage_report(T.long_factors(base, "title_id", direct),
                             base.select("title_id", F.log("revenue").alias("ln_revenue")), "title_id")


@query("factor_status_counts", """
    SELECT factor_key, count(*) AS n, count(value_numeric) AS n_known FROM factor_values GROUP BY 1""")
def factor_status_counts(t):
    return t.factor_values.groupBy("factor_key").agg(F.count(F.lit(1)).alias("n"),
                                                     F.count("value_numeric").alias("n_known"))


@query("corr_validation", CL + """
    SELECT round(corr(imdb_rating, revenue),6)+0.0 AS corr_revenue, round(corr(imdb_rating, runtime_mins),6)+0.0 AS corr_runtime,
           count(DISTINCT imdb_rating) AS distinct_values FROM cl WHERE revenue > 0""")
def corr_validation(t):
    return cleaned(t).filter("revenue > 0").agg(
        F.corr("imdb_rating", "revenue").alias("corr_revenue"), F.corr("imdb_rating", "runtime_mins").alias("corr_runtime"),
        F.countDistinct("imdb_rating").alias("distinct_values"))


@query("top_k_bucket", DD + """,
    k AS (SELECT directors FROM dd GROUP BY 1 ORDER BY count(*) DESC, directors LIMIT 20)
    SELECT title_id, CASE WHEN directors IN (SELECT directors FROM k) THEN directors ELSE 'other' END AS bucket FROM dd""")
def top_k_bucket(t):
    return T.top_k_bucket(deduped(t), "directors", 20, "bucket").select("title_id", "bucket")


@query("time_split", DD + """,
    y AS (SELECT release_year, row_number() OVER (ORDER BY release_year) AS p, count(*) OVER () AS n
          FROM (SELECT DISTINCT release_year FROM dd) q)
    SELECT title_id, p > floor(n*0.82) AS is_test FROM dd JOIN y USING (release_year)""")
def time_split(t):
    return T.time_split(deduped(t)).select("title_id", "is_test")


@query("title_functions", CL + r"""
    SELECT title_id, lower(trim(regexp_replace(regexp_replace(regexp_replace(trim(movie_name),
               '(?i)\s*[:\-–]?\s*(part|chapter|vol\.?|volume|book)\s+[ivxlcdm0-9]+\s*$', ''),
               '(?i)\s+[ivxlcdm]{1,6}\s*$', ''), '\s+[0-9]{1,2}\s*$', ''))) AS stem, primary_genre,
           CASE WHEN production_companies IS NOT NULL THEN len(string_split(production_companies, ','))::double END AS companies,
           trim(split_part(country, ',', 1)) AS first_country, release_year, CAST(release_day AS STRING) AS release_day
    FROM cl""")
def title_functions(t):
    return cleaned(t).select("title_id", C.franchise_stem("movie_name").alias("stem"), "primary_genre",
                             C.company_count("production_companies").alias("companies"),
                             C.first_country("country").alias("first_country"), "release_year", "release_day")


BANDED = ["rating", "joint_production_partnerships", "certificate", "remake_rights", "excess_runtime", "trailer_timing",
          "song_timing", "shipping_pace", "priority_level"]


@query("feature_frame", FACTS + "," + CR[len(CL) + 1:] + "," + FB[len(CR) + 1:] + "," + BE[len(DD) + 1:] + ","
       + anchor_sql("directors", "r_director") + "," + anchor_sql("primary_genre", "r_concept") + """
    SELECT title_id, movie_key, release_year, market_is_home, primary_genre, round(ln(revenue),4) AS ln_revenue,
           round(ln(greatest(b,1)),4) AS ln_budget_effective,
           round(ln(coalesce(r_star, (SELECT median(r_star) FROM dd JOIN star USING (movie_key)))),4) AS ln_r_star,
           round(r_director,3) AS r_director, round(r_concept,3) AS r_concept,
           """ + ", ".join(f"round(max(banded) FILTER (factor = '{k}'),4) AS {k}" for k in BANDED) + """
    FROM dd JOIN be USING (title_id) LEFT JOIN star USING (movie_key) JOIN r_director USING (title_id)
         JOIN r_concept USING (title_id) JOIN bd USING (title_id)
    GROUP BY ALL""")
def feature_frame(t):
    c = t.credits.withColumn("credit_order", F.col("title_id") * 1_000_000 + F.col("credit_seq"))
    f = T.feature_frame(t.titles, c, t.factor_values)
    r = lambda n, d: F.round(n, d).alias(n)
    return f.select("title_id", "movie_key", "release_year", "market_is_home", "primary_genre", r("ln_revenue", 4),
                    r("ln_budget_effective", 4), F.round(F.log("r_star"), 4).alias("ln_r_star"), r("r_director", 3), r("r_concept", 3),
                    *[r(k, 4) for k in BANDED])
